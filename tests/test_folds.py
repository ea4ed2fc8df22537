"""Folds fitted together equal folds fitted one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.plans import training
from hydrolens.plans.folds import block_statistics, fit_prefixes, prefix_starts


def rows(spark, n=600, blocks=5, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rng.gauss(40, 9), rng.random()
        out.append((i % blocks, x, z, 7.0, int(rng.random() < 1 / (1 + math.exp(-(x - 45) / 6 + z)))))
    return spark.createDataFrame(out, "block int, x double, z double, same double, target_label int").repartition(4)


def test_equal_to_single_fits(spark):
    df = rows(spark)
    names = ["x", "z", "same"]
    together = fit_prefixes(df, "block", [1, 3, 5], names, positive_scale=0.75)
    for fold, a in together.items():
        alone = training.fit_logistic(df.where(F.col("block") < fold), names, positive_scale=0.75)
        assert a["mean"] == pytest.approx(alone["mean"], abs=1e-9) and a["scale"] == pytest.approx(alone["scale"], abs=1e-9)
        assert a["coefficients"] == pytest.approx(alone["coefficients"], abs=1e-6)
        assert a["intercept"] == pytest.approx(alone["intercept"], abs=1e-6)


def test_gradient_is_zero_on_separable_rows(spark):
    df = spark.createDataFrame([(0, float(i), int(i >= 30)) for i in range(40)], "block int, x double, target_label int")
    a = fit_prefixes(df, "block", [1], ["x"], l2=1e-4)[1]
    weights = {1: 40 / 20, 0: 40 / 60}
    gradient = [0.0, 0.0]
    for i in range(40):
        u = (i - a["mean"][0]) / a["scale"][0]
        d = weights[int(i >= 30)] * (1 / (1 + math.exp(-(a["intercept"] + u * a["coefficients"][0]))) - int(i >= 30)) / 40
        gradient = [gradient[0] + d * u, gradient[1] + d]
    assert gradient[0] + 1e-4 * a["coefficients"][0] == pytest.approx(0, abs=1e-7) and gradient[1] == pytest.approx(0, abs=1e-7)


def test_folds_of_one_class_are_left_out_and_gaps_are_errors(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (0, 2.0, 0), (1, 3.0, 1), (1, 0.5, 0)], "block int, x double, target_label int")
    assert list(fit_prefixes(df, "block", [0, 1, 2], ["x"])) == [2]
    assert fit_prefixes(df.where("false"), "block", [1], ["x"]) == {}
    with pytest.raises(ValueError, match="block 1"):
        fit_prefixes(df.union(df.sparkSession.createDataFrame([(1, None, 1)], df.schema)), "block", [2], ["x"])
    with pytest.raises(ValueError, match="scale"):
        fit_prefixes(df, "block", [2], ["x"], positive_scale=0)


def test_prefix_statistics(spark):
    df = rows(spark, 97, 4)
    stats = prefix_starts(block_statistics(df, "block", ["x"], "target_label"), [3], 1.0)[3]
    plain = df.where("block < 3").agg(F.avg("x"), F.stddev_pop("x"), F.count("x")).first()
    assert (stats["mean"][0], stats["scale"][0], stats["rows"]) == (pytest.approx(plain[0]), pytest.approx(plain[1]), plain[2])
