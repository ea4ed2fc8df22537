"""Similarity join of documents on word n-grams with MinHash banding.

Band and row counts follow from the similarity, the wanted recall and a bound on hashes (``plan``). Rows with one n-gram set are one
class from the start. Classes are shuffled on their band hashes; pairs that meet are verified on their full n-gram sets.

A bucket is never spread into pairs of rows. It is cut into blocks of bounded size, and each pair of blocks is verified inside one
task, which returns one row per class: its number of links and the root of its local tree. A pair is counted in the first band it
shares, so buckets of several bands count it once. Buckets that hold the same classes in several bands are verified once. Classes of links are
connected components, found by alternating star steps on stored edges.

Defined cases: a text of fewer than ``size`` words is one n-gram; null and empty texts have the empty set and are one class;
repeated rows are copies of each other; a null key is a key of its own; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked
from .substrings import WordHash, mixed, words_of

SIZE, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Classes and n-grams of a block.
BLOCK, BLOCK_GRAMS = 256, 200_000


def plan(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands reach the recall at the similarity within the number of hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1) if similarity < 1 else (1, 1)
    for rows in range(2, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def grams(text: str, size: int, hash_words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)[:, 0]
    n = max(len(words) - size + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = mixed(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[i:i + n]
    return np.unique(mixed(out))


def minima(sets: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of a set, by odd multipliers."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), 512):
        low = np.minimum(low, (sets[at:at + 512, None] * odd).min(axis=0))
    return low


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Stored rows (key, h, class, n, bands): one per input row."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(frames):
        hash_words = WordHash()
        for frame in frames:
            out = []
            for t in frame["text"]:
                s = grams(t, size, hash_words)
                m = mixed(minima(s, bands * rows)).reshape(bands, rows)
                band = m[:, 0]
                for j in range(1, rows):
                    band = mixed(band * np.uint64(31) + m[:, j])
                out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), band.view("i8").tolist()))
            yield pd.DataFrame({"key": frame["key"], "h": frame["h"], "class": [x[0] for x in out], "n": [x[1] for x in out], "bands": [x[2] for x in out]})

    base = packed(docs.select(key, text), __text=text_of(text)).select(F.col("__row").getField(key).cast("string").alias("key"), F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))
    out = base.mapInPandas(run, "key string, h long, class binary, n long, bands array<long>")
    return stored(out.withColumn("key", F.col("key").cast(key_type)), "jaccard-signatures")


def verified(frame: pd.DataFrame, size: int, similarity: float, hash_words: WordHash):
    """Links inside one pair of blocks: per class the weight of its partners and the root of its tree."""
    band, lo, hi = int(frame["band"].iloc[0]), int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
    n, block = len(frame), frame["block"].to_numpy()
    sets = [grams(t, size, hash_words) for t in frame["text"]]
    sizes = np.array([len(s) for s in sets])
    marks = np.stack([np.asarray(b, dtype=np.int64) for b in frame["bands"]])[:, :band]
    weight = frame["weight"].to_numpy()
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    links, root = np.zeros(n, dtype=np.int64), list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    inside = np.zeros(len(ids), dtype=bool)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if lo != hi:
            rest = rest[block[rest] != block[i]]
        a, b = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(a >= similarity * b - 1e-9) & ~(marks[rest] == marks[i]).any(axis=1)]
        if not len(rest):
            continue
        own = place[starts[i]:starts[i] + sizes[i]]
        inside[own] = True
        common = np.add.reduceat(inside[place], starts)[rest] if len(rest) * 4 > n else np.array([inside[place[starts[j]:starts[j] + sizes[j]]].sum() for j in rest])
        inside[own] = False
        rest = rest[common >= similarity * (sizes[rest] + sizes[i] - common) - 1e-9]
        links[i] += weight[rest].sum()
        links[rest] += weight[i]
        for j in rest:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    held = np.flatnonzero(links)
    names = frame["class"].to_numpy()
    return pd.DataFrame({"class": names[held], "links": links[held], "root": [names[find(i)] for i in held]})


def class_links(docs: DataFrame, signed: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """Stored rows (class, links, root) from every pair of blocks that holds a link."""
    classes = stored(signed.groupBy("class").agg(F.count("n").alias("weight"), F.min(F.struct("key", "h")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "jaccard-classes")
    spread = classes.where("n > 0").select("class", "n", F.posexplode("bands").alias("band", "hash"))
    mark = [F.xxhash64("class"), F.xxhash64("class", F.lit(1))]
    buckets = spread.groupBy("band", "hash").agg(
        F.count("n").alias("count"), F.sum("n").alias("grams"),
        *[F.sum(m.bitwiseAND(0xFFFFFFFFFF)).alias(f"m{i}") for i, m in enumerate(mark)]).where("count > 1")
    # The same classes in several bands: the first band stands for all.
    first = buckets.groupBy("count", "m0", "m1").agg(F.min(F.struct("band", "hash", "grams")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("b.grams") / BLOCK_GRAMS)).cast("int")
    kept = stored(first.select("b.band", "b.hash", F.least(blocks, F.col("count").cast("int")).alias("blocks")), "jaccard-buckets")
    members = spread.select("class", "band", "hash").join(kept, ["band", "hash"])
    members = stored(members.withColumn("block", F.pmod(F.xxhash64("class", "band"), "blocks").cast("int")), "jaccard-members")
    wanted = members.select("class").distinct().join(classes, "class").select("class", "first.key", "first.h", "weight", "bands")
    base = docs.select(F.col(key).alias("k"), text_of(text).alias("text")).withColumn("kh", F.xxhash64("text"))
    texts = base.join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("kh") == F.col("h"))).select("class", "weight", "bands", "text")
    texts = stored(texts.dropDuplicates(["class"]), "jaccard-texts")
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    at = ["band", "hash", "lo", "hi"]
    work = pairs.join(texts, "class").repartition(*at).sortWithinPartitions(*at)

    def run(frames):
        hash_words, waiting = WordHash(), []
        for frame in frames:
            groups = [g for _, g in frame.groupby(at, sort=False)]
            for g in groups:
                if waiting and tuple(waiting[0][at].iloc[0]) != tuple(g[at].iloc[0]):
                    done = pd.concat(waiting)
                    waiting = []
                    if len(done) > 1 and len(out := verified(done, size, similarity, hash_words)):
                        yield out
                waiting.append(g)
        if waiting and len(done := pd.concat(waiting)) > 1 and len(out := verified(done, size, similarity, hash_words)):
            yield out

    found = stored(work.mapInPandas(run, "class binary, links long, root binary"), "jaccard-links")
    return found, classes


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of ``edges`` (u, v), by alternating large and small stars until nothing changes."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-minima")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """Rows (key, h, class_id, n_links, keeper): one per input row; the class id is the smallest key of the component, the keeper its first row."""
    bands, rows = plan(similarity, recall, hashes)
    signed = signatures(docs, key, text, size, bands, rows)
    found, classes = class_links(docs, signed, key, text, size, similarity)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = stored(components(found.select(F.col("class").alias("u"), F.col("root").alias("v"))), "jaccard-components")
    labelled = classes.select("class", "weight", "first").join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    labelled = stored(labelled.select("class", "first", F.coalesce("root", "class").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-labelled")
    heads = stored(labelled.groupBy("root").agg(F.min("first").alias("head")), "jaccard-heads")
    resolved = stored(labelled.join(heads, "root").select("class", "head", "n_links"), "jaccard-resolved")
    return signed.join(resolved, "class").select("key", "h", F.col("head.key").alias("class_id"), "n_links", (F.col("key").eqNullSafe(F.col("head.key")) & (F.col("h") == F.col("head.h"))).alias("keeper"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the first row (by key, then text hash) of each class stays."""
    keep = stored(near_classes(docs, key, text, **how).where("keeper").select("key", "h").distinct(), "jaccard-keepers")
    rows = packed(docs, __key=F.col(key), __hash=F.xxhash64(text_of(text)))
    rows = rows.join(keep, F.col("__key").eqNullSafe(F.col("key")) & (F.col("__hash") == F.col("h")), "left_semi")
    return unpacked(rows.dropDuplicates(["__key", "__hash"]))
