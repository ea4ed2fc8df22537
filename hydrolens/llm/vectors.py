"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id. Each shard builds its graph in one task over its distinct
vectors and is stored as one row of flat arrays: ids, vectors, and per level a padded neighbour array. Queries travel in
blocks to every lot of a few shards, and the shard results are merged by exact distance, ties to the smaller id.

Defined cases: rows with a null id, and null, empty or zero vectors or ones with null or non-finite components, take no part; equal vectors
are one node that holds all its ids; repeated rows count once; vectors only meet those of their length; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD, BLOCK = 2048, 512
#: Shards of a lot at most, and lots that are made before a lot gets a second shard. A block of queries travels once to each lot.
LOT, LOTS = 16, 64
LINKS, BUILD, SEARCH, TOP = 12, 80, 96, 10


class Graph:
    """Flat neighbour arrays of one shard; level 0 has twice the links."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray] | None = None, start: int = 0):
        self.x, self.levels, self.start = x, levels if levels is not None else [], start

    def near(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = self.x[at] - q
        return np.einsum("ij,ij->i", d, d)

    def search(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found on a level, nearest first."""
        seen = np.zeros(len(self.x), dtype=bool)
        seen[[i for _, i in starts]] = True
        open_, best = list(starts), [(-d, i) for d, i in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        links = self.levels[level]
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            own = links[i]
            new = own[(own >= 0)]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            for dj, j in zip(self.near(q, new).tolist(), new.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-dj, j))
                elif dj < -best[0][0]:
                    heapq.heapreplace(best, (-dj, j))
                else:
                    continue
                heapq.heappush(open_, (dj, j))
        return sorted((-d, i) for d, i in best)

    def descend(self, q: np.ndarray, to: int, height: int) -> list[tuple[float, int]]:
        at = [(float(self.near(q, np.array([self.start]))[0]), self.start)]
        for level in range(height, to, -1):
            at = self.search(q, at, 1, level)
        return at

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: one that is nearer to a chosen one than to the node itself waits."""
        chosen, waiting = [], []
        for d, i in found:
            if len(chosen) == most:
                break
            (chosen if not chosen or self.near(self.x[i], np.array(chosen)).min() >= d else waiting).append(i)
        return chosen + waiting[: most - len(chosen)]

    def link(self, i: int, j: int, level: int) -> None:
        row = self.levels[level][i]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = j
            return
        every = np.append(row, j)
        d = self.near(self.x[i], every)
        by = np.argsort(d, kind="stable")
        kept = self.spread([(float(d[k]), int(every[k])) for k in by], len(row))
        row[:] = -1
        row[: len(kept)] = kept


def build(x: np.ndarray) -> Graph:
    """Insert the vectors one by one; levels are drawn from a fixed seed."""
    rng = np.random.default_rng(3)
    tall = np.minimum((-np.log(rng.random(len(x))) / np.log(LINKS)).astype(int), 8)
    g = Graph(x, [np.full((len(x), LINKS * (1 if level else 2)), -1, dtype=np.int32) for level in range(int(tall.max()) + 1)])
    height = int(tall[0])
    for i in range(1, len(x)):
        top = int(tall[i])
        at = g.descend(x[i], min(top, height), height)
        for level in range(min(top, height), -1, -1):
            at = g.search(x[i], at, BUILD, level)
            for j in g.spread(at, LINKS):
                g.link(i, j, level)
                g.link(j, i, level)
        if top > height:
            height, g.start = top, i
    return g


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & v.isNotNull() & F.exists(v, lambda c: c != 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v")).withColumn("size", F.size("v"))


def index(rows: DataFrame, shards: int) -> DataFrame:
    """One stored row per shard: (size, shard, start, ids, members, x, links)."""

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        x, of = np.unique(np.stack([np.asarray(v, dtype=np.float64) for v in frame["v"]]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.ravel(), frame["id"].to_numpy()], axis=1), axis=0)
        g = build(x)
        return pd.DataFrame({"size": [int(frame["size"].iloc[0])], "shard": [int(frame["shard"].iloc[0])], "start": [g.start], "nodes": [pairs[:, 0].astype("<i4").tobytes()],
                             "ids": [pairs[:, 1].astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()], "links": [[a.astype("<i4").tobytes() for a in g.levels]]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("size", "shard").applyInPandas(make, "size int, shard int, start int, nodes binary, ids binary, x binary, links array<binary>"), "vector-index")


def met(asked: DataFrame, indexed: DataFrame, shards: int) -> DataFrame:
    """Each block of queries with each shard once.

    Both sides are dealt out. Left to itself Spark takes the blocks for as small as they were before they were copied to every lot, and
    would gather all copies, queries times lots, on the driver to broadcast them.
    """
    lots = min(shards, max(LOTS, -(-shards // LOT)))
    copies = asked.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    return copies.join(indexed.withColumn("lot", F.pmod("shard", F.lit(lots))).hint("merge"), ["size", "lot"])


def nearest(vectors: DataFrame, every: int = 100, top: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    rows = stored(usable(vectors, key, vector), "vectors")
    shards = max(1, -(-rows.count() // SHARD))
    indexed = index(rows, shards)
    asking = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    blocks = max(1, -(-asking.count() // BLOCK))
    asked = asking.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("size", "block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    work = met(asked, indexed, shards).select("size", "start", "nodes", "ids", "x", "links", "asked")

    def run(frames):
        for frame in frames:
            for size, start, nodes, ids, x, links, asked_ in zip(*[frame[c] for c in ("size", "start", "nodes", "ids", "x", "links", "asked")]):
                x = np.frombuffer(x, dtype="<f8").reshape(-1, size)
                g = Graph(x, [np.frombuffer(a, dtype="<i4").reshape(len(x), -1) for a in links], start)
                nodes, ids = np.frombuffer(nodes, dtype="<i4"), np.frombuffer(ids, dtype="<i8")
                first = np.searchsorted(nodes, np.arange(len(x) + 1))
                out = []
                for a in asked_:
                    q = np.asarray(a["v"], dtype=np.float64)
                    found = g.search(q, g.descend(q, 0, len(g.levels) - 1), SEARCH, 0)
                    got = [(d, int(i)) for d, node in found[: 2 * top + 2] for i in ids[first[node]:first[node + 1]][: top + 1] if i != a["id"]]
                    out += [(a["id"], i, float(np.sqrt(d))) for d, i in sorted(got)[:top]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = work.mapInPandas(run, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
