"""Registered queries: a Spark plan over the adapter views and, where SQL can say it, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.adapters import Views, with_views


@dataclass(frozen=True)
class Entry:
    plan: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.plan(Views(spark, directory))


REGISTRY: dict[str, Entry] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a plan under an inventory name. ``views`` are the adapter views that ``sql`` reads."""

    def register(plan: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(plan, with_views(tuple(views), sql) if sql else None)
        return plan

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns so that the order of floating-point sums does not show."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def r6(column) -> Column:
    return F.round(column if isinstance(column, Column) else F.col(column), 6)


NUDGE = 1.000000000001


def nudged(df: DataFrame, **digits: int) -> DataFrame:
    """Round after a tiny push away from zero, for values that may sit exactly on a rounding tie."""
    return df.withColumns({c: F.round(F.col(c) * NUDGE, d) for c, d in digits.items()})


def near(expression: str, digits: int = 6) -> str:
    """SQL twin of ``nudged``."""
    return f"ROUND(({expression}) * {NUDGE!r}e0, {digits})"
