"""Helpers of the text operators: tables, stored intermediate results, row columns, array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.session import scratch_path

#: White space between words: the blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``__row``, so that no name of an input column can clash with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame, *results: str) -> DataFrame:
    """The input columns followed by ``results``; a result replaces an input column of its name."""
    own = [f.name for f in df.schema["__row"].dataType.fields if f.name not in results]
    return df.select(*[F.col("__row").getField(c).alias(c) for c in own], *results)


def text_of(column: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_array(values: Column, combine) -> Column:
    """Running ``combine`` over an array by doubling steps: n log n work, whatever the length."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))

    def step(acc: Column, t: Column) -> Column:
        back = F.expr("1").cast("int") * F.pow(F.lit(2), t).cast("int")
        return let(back, lambda b: F.transform(acc, lambda x, i: F.when(i >= b, combine(x, F.get(acc, i - b))).otherwise(x)))

    return F.aggregate(steps, values, step)
