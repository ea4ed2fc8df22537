"""Logistic models of many nested folds at once: every Newton step of all folds is one pass over the rows.

Rows carry a block number, and fold ``f`` trains on the rows of the blocks below ``f``. Each task sums the loss, gradient and Hessian of
every fold that is still moving, with numpy on Arrow batches; the shuffle and the driver see (folds x features squared) numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_statistics(data: DataFrame, block: str, features: Sequence[str], label: str) -> list[tuple]:
    """(block, rows, positives, means, sums of squared deviations) of each block, in order: one aggregation."""
    rows = data.groupBy(block).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("p"),
        F.array(*[F.avg(F.col(f).cast("double")) for f in features]).alias("m"), F.array(*[F.var_pop(F.col(f).cast("double")) for f in features]).alias("v"),
        F.count(F.when(F.greatest(*[F.isnull(f).cast("int") for f in (*features, label)], F.lit(0)) == 1, 1)).alias("gaps"),
    ).orderBy(block).collect()  # one row per block
    for r in rows:
        if r["gaps"] or not np.isfinite(np.array(r["m"], dtype=float)).all():
            raise ValueError(f"block {r[block]} has a missing or non-finite feature or label")
    return [(r[block], r["n"], r["p"], np.array(r["m"], dtype=float), np.array(r["v"], dtype=float) * r["n"]) for r in rows]


def prefix_starts(stats: list[tuple], folds: Sequence[int], positive_scale: float) -> dict[int, dict]:
    """Mean, scale and class weights of each fold from the blocks before it; folds without both classes are left out."""
    if positive_scale <= 0:
        raise ValueError("positive weight scale must be > 0")
    starts = {}
    for fold in folds:
        n, p, mean, spread = 0, 0.0, 0.0, 0.0
        for block, rows, positives, m, s in stats:
            if block < fold:
                gap = m - mean
                mean, spread = mean + gap * rows / (n + rows), spread + s + gap * gap * n * rows / (n + rows)
                n, p = n + rows, p + positives
        if 0 < p < n:
            deviation = np.sqrt(spread / n)
            starts[fold] = {"mean": mean, "scale": np.where(deviation < 1e-9, 1.0, deviation), "weights": (n / (2 * p) * positive_scale, n / (2 * (n - p))),
                            "total": n / 2 * positive_scale + n / 2, "rows": n}
    return starts


def _sums(data: DataFrame, block: str, label: str, features: Sequence[str], at: dict[int, dict]) -> dict[int, np.ndarray]:
    """Loss, gradient and Hessian of every fold in ``at``, as one flat array each: one pass."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            blocks, y, x = columns[0], columns[1], np.column_stack(columns[2:])
            for fold, f in at.items():
                own = blocks < fold
                if not own.any():
                    continue
                z = np.column_stack([(x[own] - f["mean"]) / f["scale"], np.ones(int(own.sum()))])
                logit, hit = z @ f["beta"], y[own] == 1
                w = np.where(hit, *f["weights"])
                chance = 0.5 * (1 + np.tanh(0.5 * logit))
                loss = (w * (np.logaddexp(0, logit) - hit * logit)).sum()
                curve = (z * (w * chance * (1 - chance))[:, None]).T @ z
                totals[fold] = totals.get(fold, 0) + np.concatenate([[loss], z.T @ (w * (chance - hit)), curve.ravel()])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["fold", "parts"])

    narrow = data.select(F.col(block).cast("int"), F.col(label).cast("double"), *[F.col(f).cast("double") for f in features])
    parts = narrow.toDF(*[f"c{i}" for i in range(len(features) + 2)]).mapInArrow(run, "fold int, parts array<double>")
    summed = parts.select("fold", F.posexplode("parts")).groupBy("fold", "pos").agg(F.sum("col").alias("v"))
    size = len(features) + 1
    out = {fold: np.zeros(1 + size + size * size) for fold in at}
    for r in summed.collect():  # folds x (features + 1) squared numbers
        out[r["fold"]][r["pos"]] = r["v"]
    return out


def fit_prefixes(data: DataFrame, block: str, folds: Sequence[int], features: Sequence[str], label: str = "target_label", l2: float = 0.01,
                 positive_scale: float = 1.0, max_steps: int = 60) -> dict[int, dict]:
    """Artifacts by fold, each the balanced, L2-regularised model of the rows whose block lies below the fold.

    The objective is that of ``training.fit_logistic``. A step that raises the loss of a fold is halved; a fold stops
    taking part when its Newton decrement is negligible. ``data`` should be stored, since each step reads it once.
    """
    state = prefix_starts(block_statistics(data, block, features, label), folds, positive_scale)
    size = len(features) + 1
    penalty = np.append(np.full(size - 1, float(l2)), 0.0)
    for f in state.values():
        f.update(beta=np.zeros(size), best=None, loss=np.inf, done=False)
    for _ in range(max_steps):
        moving = {k: f for k, f in state.items() if not f["done"]}
        if not moving:
            break
        keep = ("mean", "scale", "weights", "beta")
        for fold, sums in _sums(data, block, label, features, {k: {c: f[c] for c in keep} for k, f in moving.items()}).items():
            f, total = state[fold], state[fold]["total"]
            beta = f["beta"]
            loss = sums[0] / total + 0.5 * (penalty * beta * beta).sum()
            if loss > f["loss"] + 1e-12:
                f["beta"] = 0.5 * (beta + f["best"])
                continue
            gradient = sums[1:1 + size] / total + penalty * beta
            step = np.linalg.lstsq(sums[1 + size:].reshape(size, size) / total + np.diag(penalty), gradient, rcond=None)[0]
            f.update(best=beta, loss=loss, beta=beta - step, done=bool(gradient @ step < 1e-16))
    late = [k for k, f in state.items() if not f["done"]]
    if late:
        raise RuntimeError(f"folds {late} did not converge in {max_steps} steps")
    return {k: {"feature_names": list(features), "mean": f["mean"].tolist(), "scale": f["scale"].tolist(), "coefficients": f["beta"][:-1].tolist(),
                "intercept": float(f["beta"][-1])} for k, f in state.items()}
