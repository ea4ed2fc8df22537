"""Large GeoJSON feature collections, read by many tasks.

A collection is one JSON document, but Spark's text source can split it at a separator of one byte. The closing brace is taken: every row is then
the text up to a brace, and a feature ends only where a row ends. Whether a row lies inside a string, and how deep, is known only from all
rows before it, so the file is read twice: the first pass sums up each split for both cases (begins inside a string or not), running sums over the
splits of a file give the state at which each begins, and the second pass cuts features out. Only features that lie across splits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrolens.session import scratch_path

ESCAPE = re.compile(r"\\.", re.DOTALL)
NO_BRACKET = re.compile(r"[^][{}]+")
TOKEN = re.compile(r'"[^"]*("?)|[][{}]')  # the last string of a row may stay open
MEMBER = re.compile(r'"type"\s*:\s*"FeatureCollection"|"features"\s*:\s*\[\s*(\]?)')

_SPLIT = "file string, block bigint"
_SUMMARY = (
    f"{_SPLIT}, quotes bigint, cases array<struct<depth:bigint,low:bigint,typed:array<bigint>,empty:array<bigint>,opened:array<bigint>,closed:array<bigint>>>"
)
_PIECE = f"{_SPLIT}, origin bigint, value string"


def _plain(text: str) -> str:
    """Same length, but without escapes, so that every quote left opens or closes a string."""
    return ESCAPE.sub("__", text) if "\\" in text else text


def _outside(plain: str, quoted: bool) -> str:
    """The brackets outside strings, with pairs that close at once taken out."""
    parts = plain.split('"')[1 if quoted else 0 :: 2]
    left, before = NO_BRACKET.sub("", "".join(parts)), -1
    while len(left) != before:
        before = len(left)
        left = left.replace("[]", "").replace("{}", "")
    return left


class _Case:
    """A split as it reads if it begins inside (or outside) a string; depths are relative to its begin."""

    def __init__(self, quoted: bool):
        self.quoted, self.depth, self.low = quoted, 0, 0
        self.typed: set[int] = set()
        self.empty: set[int] = set()
        self.opened: dict[int, bool] = {}  # depth at a "features" key -> closed again

    def step(self, bracket: str) -> None:
        if bracket in "[{":
            self.depth += 1
        else:
            self.depth -= 1
            self.low = min(self.low, self.depth)
            if self.opened.get(self.depth) is False:
                self.opened[self.depth] = True

    def add(self, plain: str, quotes: int) -> None:
        if MEMBER.search(plain):
            self._members(plain)
        else:
            for bracket in _outside(plain, self.quoted):
                self.step(bracket)
        self.quoted ^= bool(quotes & 1)
        if not self.quoted:
            self.step("}")

    def _members(self, plain: str) -> None:
        begin = plain.find('"') + 1 if self.quoted else 0
        if self.quoted and not begin:
            return
        for token in TOKEN.finditer(plain, begin):
            if token[0][0] != '"':
                self.step(token[0])
                continue
            member = MEMBER.match(plain, token.start())
            if member is None:
                continue
            if member[1] is None:
                self.typed.add(self.depth)
            else:
                self.opened.setdefault(self.depth, False)
                if member[1]:
                    self.empty.add(self.depth)

    def row(self) -> dict:
        closed = sorted(d for d, shut in self.opened.items() if shut)
        return {"depth": self.depth, "low": self.low, "typed": sorted(self.typed), "empty": sorted(self.empty), "opened": sorted(self.opened), "closed": closed}


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, bool, pd.DataFrame]]:
    """Rows of one split come together; tells where a new one begins."""
    current = None
    for batch in batches:
        for key, rows in batch.groupby(["file", "block"], sort=False):
            yield key, key != current, rows
            current = key


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, quotes, cases = None, 0, []

    def done():
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "quotes": [quotes], "cases": [[c.row() for c in cases]]})

    for split, new, rows in _by_split(batches):
        if new:
            if key is not None:
                yield done()
            key, quotes, cases = split, 0, [_Case(False), _Case(True)]
        for text in rows["value"]:
            plain = _plain(text)
            count = plain.count('"')
            for case in cases:
                case.add(plain, count)
            quotes += count
    if key is not None:
        yield done()


class _Cutter:
    """Cuts features out of a split whose begin is known."""

    def __init__(self, quoted: bool, depth: int, listed: bool):
        self.quoted, self.depth, self.listed = quoted, depth, listed
        self.parts: list[str] = []

    def add(self, text: str) -> str | None:
        """The feature that ends with this row, if one does."""
        plain = _plain(text)
        begin = 0
        if not (self.listed and self.depth > 2):
            found = self._search(plain)
            if found is None:
                return None
            begin = found
        for bracket in _outside(plain[begin:], self.quoted):
            self.depth += 1 if bracket in "[{" else -1
        self.quoted ^= bool(plain.count('"', begin) & 1)
        self.depth -= not self.quoted
        self.parts += [text[begin:], "}"]
        return self.taken() if self.depth == 2 else None

    def taken(self) -> str:
        feature, self.parts = "".join(self.parts), []
        return feature

    def _search(self, plain: str) -> int | None:
        """Where a feature begins in this row; without one the whole row is passed over."""
        begin = 0
        if self.quoted:
            begin = plain.find('"') + 1
            if not begin:
                return None
            self.quoted = False
        for token in TOKEN.finditer(plain, begin):
            sign = token[0][0]
            if sign == '"':
                self.quoted = not token[1]
                member = MEMBER.match(plain, token.start())
                if member and member[1] is not None and self.depth == 1:
                    self.listed = True
            elif sign in "[{":
                if sign == "{" and self.listed and self.depth == 2:
                    return token.start()
                self.depth += 1
            else:
                self.depth -= 1
                self.listed = self.listed and self.depth > 1
        if self.quoted:
            return None
        self.depth -= 1
        self.listed = self.listed and self.depth > 1
        return None


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, block, origin, value): whole features without an origin; parts of others with the split in which the feature begins."""
    key, cutter, origin, head = None, None, None, False

    def left_open() -> list[tuple]:
        if cutter is None or not cutter.parts:
            return []
        return [(*key, origin if head else key[1], cutter.taken())]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file", "block", "origin", "value"]).astype({"origin": "Int64"})

    for split, new, rows in _by_split(batches):
        out = []
        if new:
            out = left_open()
            first = rows.iloc[0]
            if pd.isna(first["depth"]):
                raise ValueError("the file changed between two passes")
            key, cutter = split, _Cutter(bool(first["quoted"]), int(first["depth"]), bool(first["listed"]))
            head = cutter.listed and cutter.depth > 2
            origin = int(first["origin"]) if head else None
        for text in rows["value"]:
            feature = cutter.add(text)
            if feature is not None:
                out.append((*key, origin if head else None, feature))
                head = False
        if out:
            yield frame(out)
    if cutter is not None and cutter.parts:
        yield frame(left_open())


def _states(summaries: DataFrame) -> DataFrame:
    """One row per split: how it begins, and the split in which a feature that is open at its begin began."""
    order = Window.partitionBy("file").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    s = summaries.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    s = s.withColumn("c", F.get("cases", F.col("quoted").cast("int")))
    s = s.withColumn("depth", F.coalesce(F.sum("c.depth").over(before), F.lit(0)))
    level = 1 - F.col("depth")
    opens = F.array_contains("c.opened", level)
    # the last split that opened the list or came below it tells whether it is open
    mark = F.when(opens, ~F.array_contains("c.closed", level)).when(F.col("depth") + F.col("c.low") < 2, F.lit(False))
    s = s.withColumns({"__mark": mark, "__through": F.col("depth") + F.col("c.low") > 2})
    s = s.withColumns({
        "listed": F.coalesce(F.last("__mark", True).over(before), F.lit(False)),
        "origin": F.max(F.when(~F.col("__through"), F.col("block"))).over(before),
        "__typed": F.max(F.array_contains("c.typed", level)).over(whole),
        "__listed": F.max(opens).over(whole),
        "__empty": F.max(F.array_contains("c.empty", level)).over(whole),
        "__end": F.sum("c.depth").over(whole),
    })
    # a last row without a brace of its own counts as one brace too many
    fault = (
        F.when(~F.col("__typed"), "input must be a GeoJSON FeatureCollection")
        .when(~F.col("__listed") | F.col("__empty"), "feature collection has no features")
        .when(~F.col("__end").isin(0, -1), "feature collection is cut off")
    )
    return s.select("file", "block", F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.col("quoted")).alias("quoted"), "depth", "listed", "origin")


def _pinned(spark: SparkSession) -> SparkSession:
    """A session that plans the same splits each time, also where executors come and go between two passes."""
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return own


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """The JSON text of every feature of the collections below ``path``: (file, value), in no order.

    Splits follow ``spark.sql.files.maxPartitionBytes``. Memory in a task is one batch of rows and the open feature. A document that is no
    FeatureCollection, has no features or is cut off fails at once. The states of the splits (one short row each) and the features are stored in the
    shared checkpoint folder. The join with the states is left to Spark; rows are put in order within tasks, whichever way it takes.
    """
    own = _pinned(spark)
    rows = own.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    begins, stored = scratch_path(spark, "splits"), scratch_path(spark, "features")
    _states(rows.select("file", "block", "value").mapInPandas(_summaries, _SUMMARY)).write.parquet(begins)
    placed = rows.join(own.read.parquet(begins), ["file", "block"], "left").sortWithinPartitions("file", "block", "id")
    placed.select("file", "block", "quoted", "depth", "listed", "origin", "value").mapInPandas(_cut, _PIECE).write.parquet(stored)
    pieces = spark.read.parquet(stored)
    whole = pieces.where("origin IS NULL").select("file", "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts")
    split = pieces.where("origin IS NOT NULL").groupBy("file", "origin").agg(parts)
    return whole.unionByName(split.select("file", F.array_join("parts.value", "").alias("value")))
