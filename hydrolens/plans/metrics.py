"""Classification metrics, threshold search, calibration and ranking as grouped DataFrame plans.

Inputs are tables with a ``label`` (0/1), a score and a unique row key. Groups may be of any size: scores are
pre-aggregated or range-ordered (``operators.ranking``), never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import scalars as S
from hydrolens.operators.aggregates import ratio
from hydrolens.operators.ranking import running_totals, top_fraction

SWEEP_START, SWEEP_END, SWEEP_COUNT = 0.05, 0.95, 91
_STEP = (SWEEP_END - SWEEP_START) / (SWEEP_COUNT - 1)
SWEEP = [SWEEP_START + k * _STEP for k in range(SWEEP_COUNT - 1)] + [SWEEP_END]


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def score_groups(df: DataFrame, keys: Sequence[str], score: str, label: str, key: str) -> DataFrame:
    """One row per distinct score and group with what every metric needs.

    ``n`` rows and ``positives`` at this score, ``rank_end`` and ``tp_end`` counted from the best score down,
    and ``ap``: the sum of precision over the positives of the score.
    """
    keys = list(keys)
    ranked = running_totals(
        df.select(*keys, F.col(score).alias("__p"), F.col(label).cast("bigint").alias("__y"), key),
        [("__p", False), (key, True)], keys, ["__y"],
    )
    return ranked.groupBy(*keys, "__p").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("positives"), F.max("row_rank").alias("rank_end"),
        F.max("__y_running").alias("tp_end"), F.sum(F.col("__y") * F.col("__y_running") / F.col("row_rank")).alias("ap"),
    )


def evaluate(df: DataFrame, keys: Sequence[str] = (), threshold: float | Column = 0.5, score: str = "probability",
             label: str = "label", key: str = "row_key", digits: int | None = 4) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, ROC-AUC, average precision, Brier score and confusion.

    ``threshold`` may be a literal column of the grouped frame. Order among equal scores follows ``key``.
    """
    keys = list(keys)
    groups = score_groups(df, keys, score, label, key)
    totals = groups.groupBy(*keys).agg(F.sum("n").alias("__n"), F.sum("positives").alias("__pos"))
    joined = groups.join(totals, keys) if keys else groups.crossJoin(F.broadcast(totals))  # one row
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    p, n, pos = F.col("__p"), F.col("n"), F.col("positives")
    neg = n - pos
    flag = p >= cut
    below = (F.col("__n") - F.col("__pos")) - (F.col("rank_end") - F.col("tp_end"))  # negatives with a lower score
    sums = joined.groupBy(*keys).agg(
        F.sum(n).alias("rows"), F.sum(pos).alias("positives"), F.sum(neg).alias("negatives"),
        F.sum(F.when(flag, pos).otherwise(0)).alias("tp"), F.sum(F.when(flag, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(flag, 0).otherwise(pos)).alias("fn"), F.sum(F.when(flag, 0).otherwise(neg)).alias("tn"),
        F.sum(pos * (below + neg / 2)).alias("__auc"), F.sum("ap").alias("__ap"),
        F.sum(pos * F.pow(p - 1, F.lit(2)) + neg * F.pow(p, F.lit(2))).alias("__brier"),
    )
    return _finish(sums, keys, digits)


def _finish(sums: DataFrame, keys: Sequence[str], digits: int | None) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    measures = {
        "accuracy": ratio(tp + tn, F.col("rows")),
        "precision": precision,
        "recall": recall,
        "f1": _f1(precision, recall),
        "roc_auc": ratio(F.col("__auc"), F.col("positives") * F.col("negatives").cast("double")),
        "pr_auc": ratio(F.col("__ap"), F.col("positives")),
        "brier_score": ratio(F.col("__brier"), F.col("rows")),
    }
    shown = {k: (S.round_exact(v, digits) if digits is not None else v) for k, v in measures.items()}
    return sums.select(*keys, "rows", "positives", "negatives", *[v.alias(k) for k, v in shown.items()], "tn", "fp", "fn", "tp")


def roc_auc(df: DataFrame, keys: Sequence[str] = (), **names: str) -> DataFrame:
    return evaluate(df, keys, digits=None, **names).select(*keys, "roc_auc")


def average_precision(df: DataFrame, keys: Sequence[str] = (), **names: str) -> DataFrame:
    return evaluate(df, keys, digits=None, **names).select(*keys, F.col("pr_auc").alias("average_precision"))


# --- thresholds ---------------------------------------------------------------------------


def sweep_index(score: Column) -> Column:
    """Number of sweep thresholds at or below the score (0-91), by arithmetic and one comparison each way."""
    thresholds = F.array(*[F.lit(t) for t in SWEEP])
    guess = F.greatest(F.lit(0), F.least(F.lit(SWEEP_COUNT), F.floor((score - SWEEP_START) / _STEP).cast("int") + 1))
    lower = F.when((guess > 0) & (F.get(thresholds, guess - 1) > score), guess - 1).otherwise(guess)
    return F.when((lower < SWEEP_COUNT) & (F.get(thresholds, lower) <= score), lower + 1).otherwise(lower)


def threshold_sweep(df: DataFrame, keys: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    """Confusion and rounded precision, recall and F1 at each of the 91 thresholds.

    Rows collapse to at most 92 counts per group before any shuffle; the rest is a sum over those counts.
    """
    keys = list(keys)
    y = F.col(label).cast("bigint")
    counts = df.groupBy(*keys, sweep_index(F.col(score)).alias("__i")).agg(F.sum(y).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__pos").alias("positives"), F.sum("__n").alias("rows"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(SWEEP)])
    grid = totals.withColumn("__s", F.explode(steps)).select(*keys, "positives", "rows", "__s.*")
    filled = grid.join(counts.withColumnRenamed("__i", "k"), [*keys, "k"], "left")
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("k").desc())  # 91 rows per group
    tp = F.sum(F.coalesce("__pos", F.lit(0))).over(window)
    flagged = F.sum(F.coalesce("__n", F.lit(0))).over(window)
    swept = filled.withColumn("tp", tp).withColumn("fp", flagged - F.col("tp"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("positives"))
    return swept.select(
        *keys, "threshold", F.col("k").alias("step"), "rows", "positives", "tp", "fp",
        (F.col("positives") - F.col("tp")).alias("fn"), (F.col("rows") - F.col("positives") - F.col("fp")).alias("tn"),
        S.round_exact(precision, 4).alias("precision"), S.round_exact(recall, 4).alias("recall"),
        S.round_exact(_f1(precision, recall), 4).alias("f1"),
    )


_PICKED = ("threshold", "step", "precision", "recall", "f1", "tp", "fp", "fn", "tn")


def _best(swept: DataFrame, keys: Sequence[str], eligible: Column, *rank: Column) -> DataFrame:
    row = F.struct(*_PICKED)
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate((*rank, -F.col("step")))])  # the first wins ties
    return swept.where(eligible).groupBy(*keys).agg(F.max_by(row, order).alias("pick"))


def _balanced(swept: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _best(swept, keys, F.lit(True), F.col("f1"), F.col("precision"), -F.abs(F.col("threshold") - 0.5))


def pick_threshold(swept: DataFrame, mode: str, keys: Sequence[str] = (), minimum_precision: float = 0.10,
                   minimum_recall: float = 0.20) -> DataFrame:
    """The operating threshold of a mode per group, from a sweep; falls back to the balanced pick."""
    keys = list(keys)
    flags = F.col("tp") + F.col("fp") > 0
    balanced = _balanced(swept, keys)
    if mode == "conservative":
        wanted = _best(swept, keys, flags & (F.col("recall") >= minimum_recall), F.col("precision"), F.col("f1"), F.col("threshold"))
    elif mode == "screening":
        wanted = _best(swept, keys, flags & (F.col("precision") >= minimum_precision), F.col("recall"), F.col("f1"), -F.col("threshold"))
    elif mode == "balanced":
        wanted = None
    else:
        raise ValueError(f"unknown threshold mode: {mode}")
    if wanted is not None:
        b, w = balanced.withColumnRenamed("pick", "__b"), wanted.withColumnRenamed("pick", "__w")
        joined = b.join(w, keys, "left") if keys else b.crossJoin(F.broadcast(w))  # one row each
        balanced = joined.select(*keys, F.coalesce("__w", "__b").alias("pick"))
    return balanced.select(
        *keys, S.round_exact("pick.threshold", 4).alias("threshold"),
        *[F.col(f"pick.{c}").alias(c) for c in _PICKED if c not in ("threshold", "step")],
    )


def tempered(df: DataFrame, score: str = "probability", water: str = "surface_water") -> DataFrame:
    """Every row under each water-temper candidate. Use it right before an aggregate."""
    betas = F.array(*[F.lit(b) for b in K.WATER_TEMPER_CANDIDATES])
    return df.withColumn("beta", F.explode(betas)).withColumn("tempered", S.temper(score, water, F.col("beta")))


def select_profile(df: DataFrame, mode: str, keys: Sequence[str] = (), score: str = "probability", label: str = "label",
                   water: str = "surface_water", minimum_precision: float = 0.10, minimum_recall: float = 0.20) -> DataFrame:
    """Threshold and water temper chosen together per group."""
    keys = list(keys)
    copies = tempered(df.select(*keys, score, label, water), score, water)
    swept = threshold_sweep(copies, [*keys, "beta"], "tempered", label)
    picks = pick_threshold(swept, mode, [*keys, "beta"], minimum_precision, minimum_recall)
    beta = F.col("beta")
    rank = {
        "screening": (F.col("recall"), F.col("f1"), F.col("precision"), -beta),
        "conservative": (F.col("precision"), F.col("f1"), F.col("recall"), beta),
        "balanced": (F.col("f1"), F.col("precision"), F.col("recall"), -F.abs(beta - 0.3)),
    }[mode]
    order = F.struct(*[r.alias(f"r{i}") for i, r in enumerate((*rank, -beta))])  # the smallest beta wins ties
    fields = ("threshold", "beta", "precision", "recall", "f1", "tp", "fp", "fn", "tn")
    best = picks.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("b"))
    return best.select(
        *keys, F.lit(mode).alias("mode"), F.col("b.threshold").alias("threshold"), F.col("b.beta").alias("water_temper_beta"),
        *[F.col(f"b.{c}").alias(c) for c in fields[2:]],
    )


def select_profiles(df: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    result = None
    for mode in K.THRESHOLD_MODES:
        one = select_profile(df, mode, keys, **options)
        result = one if result is None else result.unionByName(one)
    return result


# --- calibration, ranking, events ---------------------------------------------------------


def reliability_curve(df: DataFrame, bins: int = 10, keys: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    """Per equal-width bin (the last one closed): rows, mean score, observed rate and gap."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    index = F.size(F.filter(edges, lambda edge: edge <= F.col(score)))
    grouped = df.where(F.col(score).between(0, 1)).groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(score).alias("mean_probability"), F.avg(label).alias("observed_rate")
    )
    return grouped.select(
        *keys, "bin", (F.col("bin") / bins).alias("bin_lower"), ((F.col("bin") + 1) / bins).alias("bin_upper"), "count",
        "mean_probability", "observed_rate", (F.col("mean_probability") - F.col("observed_rate")).alias("gap"),
    )


def calibration(df: DataFrame, bins: int = 10, keys: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    """Expected and maximum calibration error with the base rate, one row per group."""
    curve = reliability_curve(df, bins, keys, score, label)
    gap, n = F.abs(F.col("gap")), F.col("count")
    positives = F.col("observed_rate") * n
    return curve.groupBy(*keys).agg(
        F.sum(n).alias("rows"), F.round(F.sum(positives)).cast("bigint").alias("positives"),
        (F.sum(positives) / F.sum(n)).alias("base_rate"),
        (F.sum(n * gap) / F.sum(n)).alias("expected_calibration_error"), F.max(gap).alias("maximum_calibration_error"),
    )


def ranking(df: DataFrame, fractions: Sequence[float] = (0.01, 0.05, 0.10), keys: Sequence[str] = (), score: str = "probability",
            label: str = "label", key: str = "row_key") -> DataFrame:
    top = top_fraction(df, score, label, key, fractions, keys)
    return top.withColumns({c: S.round_exact(c, 4) for c in ("precision", "recall")})


def event_metrics(df: DataFrame, threshold: float, event: str = "event_id", **names: str) -> DataFrame:
    """Metrics of every event and the error of its predicted area in cells."""
    return evaluate(df, [event], threshold, **names).withColumn(
        "predicted_area_error_cells", F.col("tp") + F.col("fp") - F.col("positives")
    )


def false_positives(df: DataFrame, threshold: float, n: int = 50, key: str = "row_key") -> DataFrame:
    from hydrolens.operators.relational import top_false_positives

    return top_false_positives(df, threshold, n, key)
