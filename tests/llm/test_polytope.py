"""Near vectors against all pairs."""

import math

import numpy as np
import pytest

from hydrolens.llm import polytope
from hydrolens.llm.polytope import codes, hadamard, near_vectors, plan, unit


def brute(rows, similarity):
    """(n_links, component_id) of each row."""
    def fine(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])

    x = [unit([r[1]])[0] if fine(r) else None for r in rows]
    links = [[j for j, s in enumerate(rows) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == s[2] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= similarity] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def planted(rng, dim=64, groups=12, size=25, alone=300):
    rows, at = [], 0
    for g in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size if g else 3 * size):
            rows.append((at, (centre + rng.standard_normal(dim) * rng.uniform(0.02, 0.42)).tolist(), int(g % 3)))
            at += 1
    for _ in range(alone):
        rows.append((at, rng.standard_normal(dim).tolist(), int(rng.integers(3))))
        at += 1
    return [rows[i] for i in rng.permutation(len(rows))]


SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, class string"


def check(spark, rows, similarity=0.93):
    frame = spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA)
    got = near_vectors(frame, similarity=similarity)
    assert got.columns == ["vec_id", "embedding", "label", "class", "n_links", "component_id", "kept"]
    got = got.collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows, similarity), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_planted_groups(spark, monkeypatch):
    """Near copies at all distances, in buckets of several blocks; every link is found at recall 0.9995."""
    monkeypatch.setattr(polytope, "BLOCK", 16)
    monkeypatch.setattr(polytope, "STRIP", 7)
    monkeypatch.setattr(polytope, "FEW", 9)
    rng = np.random.default_rng(4)
    rows = planted(rng)
    found = brute(rows, 0.93)
    assert sum(r[1] for r in found) > 3000 and len({r[1] for r in found}) > 20
    check(spark, rows)


def test_defined_cases(spark):
    rng = np.random.default_rng(5)
    v, w = rng.standard_normal(5).tolist(), rng.standard_normal(5).tolist()
    nan = float("nan")
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, [2 * c for c in v], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0] * 5, 0), (9, [nan] * 5, 0),
        (10, [None, 1.0, 1.0, 1.0, 1.0], 0), (11, [float("inf")] * 5, 0), (12, w, 0), (13, [-c for c in w], 0), (14, v[:4], 0), (15, [1e300 * c for c in v], 0), (16, [1e-300 * c for c in v], 0),
        (17, [1.0, 0.0], 2), (18, [1.0, -0.0], 2), (19, [3.0], 2), (20, [5.0], 2), (21, [-5.0], 2), (12, v, 0)]
    check(spark, rows)
    got = near_vectors(spark.createDataFrame([(None, v, 0, "", ""), (None, w, 1, "", "")], SCHEMA)).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(0, None, True)] * 2
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).standard_normal((7, 32))
    matrix = hadamard(np.eye(32))
    assert np.allclose(hadamard(x), x @ matrix) and np.allclose(matrix @ matrix.T, np.eye(32))


def test_probes_are_distinct_and_begin_with_the_own_bucket():
    x = unit(np.random.default_rng(2).standard_normal((50, 24)))
    many = codes(x, 3, 2, 8)
    assert many.shape == (50, 3, 8) and (many[:, :, 0] == codes(x, 3, 2, 1)[:, :, 0]).all()
    assert all(len(set(row)) == 8 for row in many.reshape(-1, 8).tolist())


@pytest.mark.parametrize("rows", [100, 10_000, 10_000_000])
def test_plan_reaches_its_recall(rows):
    """On other pairs of the threshold's cosine than those that the plan was made on."""
    width, tables = plan(rows, 64)
    rng = np.random.default_rng(99)
    u = unit(rng.standard_normal((2000, 64)))
    v = rng.standard_normal((2000, 64))
    v = unit(v - (u * v).sum(1, keepdims=True) * u)
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * v
    a, b = codes(u, tables, width), codes(v, tables, width)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2))
    assert 128**width >= rows and met.mean() >= 0.998
