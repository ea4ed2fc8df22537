"""Global order at scale: running totals, percent ranks and top fractions without a one-task window.

An ordered window without a partition key (or with a hot key) runs in one task. Here the rows are range
partitioned on the full sort order, stored once, and each range gets the totals of the ranges before it,
so no task ever holds more than one range. Ranges split hot keys and, because the order ends in a unique
column, hot ties as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.session import materialize

_RANGE = "__range"


def _sort(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in order]


def running_totals(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    keys: Sequence[str] = (),
    sums: Sequence[str] = (),
    rank: str = "row_rank",
) -> DataFrame:
    """Add ``rank`` (1-based row number) and ``<c>_running`` for every column of ``sums``.

    ``order`` is a list of (column, ascending) and should end in a unique column. The totals restart for
    every combination of ``keys``.
    """
    keys = list(keys)
    sorted_by = _sort(order)
    ranged = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *sorted_by).withColumn(_RANGE, F.spark_partition_id())
    )
    # one row per (range, key): at most the number of ranges plus the number of keys
    totals = ranged.groupBy(_RANGE, *keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(f"__sum_{c}") for c in sums]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(_RANGE).alias("__at"),
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
    )
    condition = F.col(_RANGE) == F.col("__at")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    joined = ranged.join(offsets, condition)
    within = Window.partitionBy(_RANGE, *keys).orderBy(*sorted_by)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *df.columns,
        (F.col("__rows_before") + F.row_number().over(within)).alias(rank),
        *[(F.col(f"__before_{c}") + F.sum(c).over(upto)).alias(f"{c}_running") for c in sums],
    )


def value_ranks(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value and key: ``n`` rows hold it, ``n_before`` are smaller, ``n_total`` exist.

    Counting before ordering collapses hot values to one row.
    """
    keys = list(keys)
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    ordered = running_totals(counts, [(column, True)], keys, ["n"])
    totals = ordered.groupBy(*keys).agg(F.max("n_running").alias("n_total"))
    ranked = ordered.join(totals, keys) if keys else ordered.crossJoin(F.broadcast(totals))  # one row
    return ranked.select(*keys, column, "n", (F.col("n_running") - F.col("n")).alias("n_before"), "n_total")


def with_percentile(
    df: DataFrame, column: str, keys: Sequence[str] = (), name: str | None = None, scale: float = 100.0
) -> DataFrame:
    """``percent_rank() * scale`` of ``column`` within ``keys``; rows with a null value get null."""
    keys = list(keys)
    name = name or f"{column}_percentile"
    ranks = value_ranks(df, column, keys).select(
        *keys,
        column,
        F.when(F.col("n_total") > 1, F.col("n_before") / (F.col("n_total") - 1)).otherwise(0.0).alias("__rank"),
    )
    return (
        df.join(ranks, [*keys, column], "left").withColumn(name, F.col("__rank") * scale).select(*df.columns, name)
    )


def top_fraction(
    df: DataFrame, score: str, label: str, key: str, fractions: Sequence[float] = (0.01, 0.05, 0.10),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Precision and recall of the best ``ceil(n * f)`` rows for each fraction."""
    keys = list(keys)
    ranked = running_totals(df.select(*keys, score, label, key), [(score, False), (key, True)], keys, [label])
    totals = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(label).cast("bigint").alias("__positives")
    )
    cuts = totals.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn(
        "cells", F.greatest(F.lit(1), F.ceil(F.col("__rows") * F.col("fraction"))).cast("bigint")
    )
    # the cut row carries the true positives so far: an equi-join on the rank
    at = ranked.select(*keys, F.col("row_rank").alias("cells"), F.col(f"{label}_running").alias("__tp"))
    tp = F.col("__tp").cast("bigint")
    return cuts.join(at, [*keys, "cells"]).select(
        *keys,
        "fraction",
        "cells",
        tp.alias("true_positive_cells"),
        (tp / F.col("cells")).alias("precision"),
        (tp / F.greatest(F.lit(1), F.col("__positives"))).alias("recall"),
    )


def cumulative_precision(df: DataFrame, score: str, label: str, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision after each row in rank order (score descending, key ascending)."""
    ranked = running_totals(df.select(*keys, key, score, label), [(score, False), (key, True)], keys, [label])
    return ranked.withColumn("cumulative_precision", F.col(f"{label}_running") / F.col("row_rank"))
