"""Removal of repeated substrings by seed and extend, without pairs.

Every window of ``WINDOW`` words picks one anchor: the word n-gram of minimal hash inside it (the leftmost on ties), as in
winnowing. Equal windows pick anchors of equal hash at equal places, so windows are only compared under their anchor.

1. Seed: anchors are joined with all anchors of their hash through counts. An anchor whose hash occurs once has no repeat.
2. Extend, whole: the windows of one anchor cover a span around it. A span that occurs twice repeats with all its windows.
3. Extend, part: a span that occurs once but whose seed is shared is cut into its windows, and these are compared with the
   windows of one representative of every other span of the seed. So left and right extensions are found to the word.

Adjacent repeated windows join into maximal repeats. Groups of thousands of copies only ever meet in counts, so there are no
pairs. Equality is by two independent 64-bit hashes of the words of a span or window.

Defined cases: null text has no words, texts shorter than a window keep all words, repeated rows repeat each other, a null key is
a key of its own, an empty table gives an empty table. Words are kept as they are and joined by one blank.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, packed, stored, text_of, unpacked

WINDOW, SEED = 35, 8
WORDS = re.compile(WORD)
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[str]:
    return WORDS.findall(text)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """Two 64-bit hashes per word, remembered for words seen before."""

    def __init__(self, limit: int = 1 << 18):
        self.memo, self.limit = {}, limit

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > self.limit:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype="<u8").reshape(-1, 2)


def prefix_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of all prefixes, H[i + 1] = H[i] * M + h[i], as a sum of h[i] times powers of the inverse of M."""
    m = _M[lane]
    inverse = np.uint64(pow(int(m), -1, 1 << 64))
    powers = np.cumprod(np.full(len(hashes), inverse, dtype=np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, lane] * powers, dtype=np.uint64)])


def ranges(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of words first..last-1, the same wherever they stand."""
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(prefix) - 1, _M[lane], dtype=np.uint64)]))
    return mixed((prefix[last] - prefix[first]) * powers[first])


def anchors(hashes: np.ndarray, window: int, seed: int):
    """Per anchor: its place, its seed hash, and the first and last start of the windows that picked it."""
    n = len(hashes)
    p = prefix_hashes(hashes, 0)
    at = np.arange(n - seed + 1)
    grams = ranges(p, at, at + seed, 0)
    span = window - seed + 1
    picked = at[: n - window + 1] + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    cuts = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    ends = np.concatenate([cuts[1:], [len(picked)]]) - 1
    return picked[cuts], grams[picked[cuts]], cuts, ends


def row_key(key: str, text: Column) -> Column:
    return F.struct(F.col(key).cast("string").alias("id"), F.xxhash64(text).alias("h"))


def repeats(docs: DataFrame, key: str, text: str, window: int, seed: int) -> DataFrame:
    """Stored rows (id, h, first, last): runs of repeated window starts of each distinct (key, text)."""
    base = docs.select(F.col(key).cast("string").alias("id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    anchor_type = "id string, h long, seed long, a long, b long, first int, last int, n int"

    def spans(frames):
        hash_words = WordHash()
        for frame in frames:
            ids, parts = [], []
            for id_, t, h in zip(frame["id"], frame["text"], frame["h"]):
                words = words_of(t)
                if len(words) < window:
                    continue
                hashes = hash_words(words)
                _, grams, first, last = anchors(hashes, window, seed)
                a, b = (ranges(prefix_hashes(hashes, lane), first, last + window, lane) for lane in (0, 1))
                ids += [id_] * len(first)
                parts.append((np.full(len(first), h), grams.view("i8"), a.view("i8"), b.view("i8"), first.astype("i4"), last.astype("i4")))
            if parts:
                columns = dict(zip(("h", "seed", "a", "b", "first", "last"), map(np.concatenate, zip(*parts))))
                yield pd.DataFrame({"id": ids, **columns, "n": np.ones(len(ids), dtype="i4")})

    spanned = stored(base.select("id", "text", "h").mapInPandas(spans, anchor_type), "substring-spans")
    # Seeds that occur once are most of all; only the spans of the others are counted.
    seeds = stored(spanned.groupBy("seed").agg(F.count("n").alias("rows")).where("rows > 1").select("seed"), "substring-seeds")
    near = stored(spanned.drop("n").join(seeds, "seed"), "substring-near")
    counts = stored(near.groupBy("seed", "a", "b").agg(F.count("h").alias("count")), "substring-counts")
    kinds = stored(counts.groupBy("seed").agg(F.count("count").alias("kinds")), "substring-kinds")
    shared = stored(counts.join(kinds, "seed").select("seed", "a", "b", "count", "kinds"), "substring-shared")
    hit = stored(near.join(shared, ["seed", "a", "b"]), "substring-hits")
    whole = hit.where("count > 1").select("id", "h", "first", "last")

    # Spans to be cut: those of seeds with several kinds of spans, one representative row of each kind.
    cut = hit.where("kinds > 1")
    alone = cut.where("count = 1")
    many = cut.where("count > 1").groupBy("seed", "a", "b").agg(F.min(F.struct("id", "h", "first", "last")).alias("s"), F.first("count").alias("count")).select("seed", "a", "b", "s.*", "count")
    chosen = alone.select("id", "h", "seed", "first", "last", "count").unionByName(many.select("id", "h", "seed", "first", "last", "count"))
    asked = chosen.groupBy("id", "h").agg(F.collect_list(F.struct("seed", "first", "last", "count")).alias("cuts"))
    text_and_cuts = base.dropDuplicates(["id", "h"]).join(asked, base["id"].eqNullSafe(asked["id"]) & (base["h"] == asked["h"])).select(base["id"], "text", base["h"], "cuts")

    def windows(frames):
        hash_words = WordHash()
        for frame in frames:
            ids, parts = [], []
            for id_, t, h, cuts in zip(frame["id"], frame["text"], frame["h"], frame["cuts"]):
                hashes = hash_words(words_of(t))
                first, last = (np.array([c[k] for c in cuts]) for k in ("first", "last"))
                length = last - first + 1
                which = np.repeat(np.arange(len(first)), length)
                start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
                a, b = (ranges(prefix_hashes(hashes, lane), start, start + window, lane) for lane in (0, 1))
                seeds_ = np.array([c["seed"] for c in cuts])[which]
                lone = np.array([c["count"] for c in cuts])[which] == 1
                ids += [id_] * len(start)
                parts.append((np.full(len(start), h), seeds_, a.view("i8"), b.view("i8"), start.astype("i4"), lone))
            if parts:
                yield pd.DataFrame({"id": ids, **dict(zip(("h", "seed", "a", "b", "start", "lone"), map(np.concatenate, zip(*parts))))})

    cut_windows = stored(text_and_cuts.mapInPandas(windows, "id string, h long, seed long, a long, b long, start int, lone boolean"), "substring-windows")
    twice = stored(cut_windows.groupBy("seed", "a", "b").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("seed", "a", "b"), "substring-twice")
    part = cut_windows.where("lone").join(twice, ["seed", "a", "b"]).select("id", "h", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(part)


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Every row with ``kept_text``, ``n_words``, ``n_removed``: each word covered by a repeated window is gone."""
    found = repeats(docs, key, text, window, seed).groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("__runs")).select(F.col("id").alias("__id"), F.col("h").alias("__h"), "__runs")
    rows = packed(docs, __key=F.col(key).cast("string"), __text=text_of(text)).withColumn("__hash", F.xxhash64("__text"))
    rows = rows.join(found, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left").select("__row", "__text", "__runs")

    @F.pandas_udf("kept_text string, n_words long, n_removed long")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, runs):
            words = words_of(t)
            if own is None or not len(own):
                out.append((" ".join(words), len(words), 0))
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, [r["first"] for r in own], 1)
            np.add.at(edge, [r["last"] + window for r in own], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((" ".join(w for w, g in zip(words, gone) if not g), len(words), int(gone.sum())))
        return pd.DataFrame(out, columns=["kept_text", "n_words", "n_removed"])

    out = rows.withColumn("__k", kept("__text", "__runs"))
    return unpacked(out.select("__row", "__k.*"), "kept_text", "n_words", "n_removed")
