"""Near duplicates of embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis it then points to, with
the sign, one of 2d. ``width`` such hashes name a bucket, and a vector also visits the ``PROBES`` - 1 buckets that it misses by least.
Two vectors meet in a bucket when one of them has it as its own. The width follows from the number of rows, so that buckets of
unrelated vectors stay small at every size; the number of tables follows from the wanted recall at the threshold, with the chance to meet measured on
made pairs of exactly that cosine (``plan``), never on the data.

Pairs that meet are verified by their cosine in double precision, and only inside tasks: a bucket is cut into blocks of bounded size and each
pair of blocks returns one row per class, its number of links and the root of its local tree. A pair counts in the first bucket in which it
meets. Buckets with the same members are verified once. Vectors that are equal are one class from the start, so a hot vector
is one row of the work. Components come from alternating star steps on stored edges.

Defined cases: rows whose label is null, and vectors that are null, empty or zero or hold null or non-finite components, link with nothing and
are a component of their own; vectors only meet those of their label and length; repeated rows, also of one id, are vectors that link with each
other; a row with a null id takes part and is kept if its component has no id; input columns stay, a result replaces a column of its name; an
empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, unpacked
from .jaccard import components
from .substrings import mixed

SIMILARITY, RECALL, PROBES = 0.93, 0.9995, 8
#: Vectors of a block, rows compared with a block at a time, and rows of groups that are compared many at once.
BLOCK, STRIP, FEW = 2048, 256, 24
_SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, whose length is a power of two."""
    d, step = x.shape[-1], 1
    while step < d:
        y = x.reshape(*x.shape[:-1], -1, 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / math.sqrt(d)


def signs(d: int, count: int) -> np.ndarray:
    """Three rounds of random signs for each of ``count`` rotations."""
    return np.random.default_rng([_SEED, d]).choice([-1.0, 1.0], size=(count, 3, d))


def codes(x: np.ndarray, tables: int, width: int, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit vectors; the first probe is the vector's own bucket."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    turned = np.zeros((len(x), tables * width, d))
    turned[:, :, :x.shape[1]] = x[:, None, :]
    for s in signs(d, tables * width).swapaxes(0, 1):
        turned = hadamard(turned * s)
    size = np.abs(turned)
    near = min(probes, 2 * d, d)
    axis = np.argsort(-size, axis=-1, kind="stable")[..., :near]
    value = np.take_along_axis(size, axis, -1)
    code = (2 * axis + (np.take_along_axis(turned, axis, -1) < 0)).reshape(len(x), tables, width, near)
    loss = ((value[..., :1] - value) ** 2).reshape(len(x), tables, width, near)
    # All ways to take an axis per hash among those that a list of so many probes can hold.
    ways = np.array([w for w in itertools.product(range(near), repeat=width) if math.prod(i + 1 for i in w) <= probes])
    each = np.arange(width)
    total = loss[:, :, each, ways].sum(-1)
    best = np.argsort(total, axis=-1, kind="stable")[..., :probes]
    picked = ways[best]
    number = np.take_along_axis(code[:, :, None, :, :], picked[..., None], -1)[..., 0]
    return (number * (2 * d) ** each).sum(-1)


def plan(rows: int, dim: int, similarity: float = SIMILARITY, recall: float = RECALL, probes: int = PROBES, trials: int = 2000) -> tuple[int, int]:
    """(width, tables): buckets at least as many as rows, and tables that reach the recall at the similarity."""
    d = 1 << max(0, dim - 1).bit_length()
    width = max(1, min(math.ceil(math.log(max(rows, 2)) / math.log(2 * d)), int(62 / math.log2(2 * d))))
    rng = np.random.default_rng(_SEED)
    u = rng.standard_normal((trials, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = rng.standard_normal((trials, dim))
    v -= (u * v).sum(1, keepdims=True) * u
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    v = similarity * u + math.sqrt(max(0.0, 1 - similarity**2)) * v
    a, b = codes(u, 1, width, probes)[:, 0], codes(v, 1, width, probes)[:, 0]
    met = ((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)).mean()
    # Two standard errors off the measured chance.
    met = max(met - 2 * math.sqrt(met * (1 - met) / trials), 0.01)
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(met, 0.99))))


def unit(vectors) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(label: Column, vector: Column) -> Column:
    good = label.isNotNull() & vector.isNotNull() & F.exists(vector, lambda c: c != 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(good, F.lit(False))


def class_name(label: Column, vector: Column) -> Column:
    """128 bits of label and vector as text."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(*lane)), 16, "0") for lane in ((label, vector), (vector, F.lit(_SEED), label))])


def visits(classes: DataFrame, plans: dict[int, tuple[int, int]], probes: int) -> DataFrame:
    """Stored rows (class, weight, size, v, own, all): the buckets of each class, own ones first in each table."""

    def run(frames):
        for frame in frames:
            for size, part in frame.groupby("size"):
                width, tables = plans[int(size)]
                for at in range(0, len(part), 1024):
                    some = part.iloc[at:at + 1024]
                    code = codes(unit(some["v"]), tables, width, probes).astype(np.uint64)
                    salt = some["salt"].to_numpy().astype(np.int64).view(np.uint64)[:, None, None]
                    # The table is in the top byte, so that buckets sort by table.
                    bucket = (mixed(mixed(code + np.uint64(1)) ^ salt) >> np.uint64(9)) | (np.arange(tables, dtype=np.uint64) << np.uint64(55))[None, :, None]
                    flat = bucket.view(np.int64)
                    yield pd.DataFrame({"class": some["class"], "weight": some["weight"], "v": some["v"], "own": flat[:, :, 0].tolist(), "all": flat.reshape(len(some), -1).tolist()})

    salted = classes.select("class", "weight", "size", "v", F.xxhash64("label", "size").alias("salt"))
    return stored(salted.mapInPandas(run, "class string, weight long, v array<double>, own array<long>, all array<long>"), "polytope-visits")


def bucket_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, allowed, similarity: float):
    """Pairs (i, j), i < j, of rows of one group whose vectors are near; ``allowed`` tells which pairs count at all."""
    size = ends - starts
    for n in np.unique(size[(size > 1) & (size <= FEW)]).tolist():
        # Small groups of one size together: every pair of rows.
        a, b = np.triu_indices(n, 1)
        first = starts[size == n]
        step = max(1, (1 << 15) // len(a))
        for at in range(0, len(first), step):
            i, j = ((first[at:at + step, None] + k).ravel() for k in (a, b))
            fine = allowed(i, j)
            i, j = i[fine], j[fine]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= similarity
            yield i[near], j[near]
    for lo, hi in zip(starts[size > FEW].tolist(), ends[size > FEW].tolist()):
        for at in range(lo, hi, STRIP):
            i, j = np.nonzero(x[at:min(at + STRIP, hi)] @ x[at:hi].T >= similarity)
            i, j = (i + at)[i < j], (j + at)[i < j]
            fine = allowed(i, j)
            yield i[fine], j[fine]


def verified(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links inside pairs of blocks, each whole in the frame: per class the weight of its partners and the root of its tree."""
    key = frame[["bucket", "lo", "hi"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    bucket, apart = key[:, 0], key[:, 1] != key[:, 2]
    weight, block, own, names = (frame[c].to_numpy() for c in ("weight", "block", "mine", "class"))
    links, root = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))

    def allowed(i, j):
        return (own[i] | own[j]) & ~(apart[i] & (block[i] == block[j]))

    found = bucket_pairs(unit(frame["v"]), starts, np.append(starts[1:], len(frame)), allowed, similarity)
    found = [(i, j) for i, j in found if len(i)]
    if not found:
        return pd.DataFrame(columns=["class", "links", "root"])
    i, j = (np.concatenate(k) for k in zip(*found))
    # A pair counts here unless it meets in a bucket before this one.
    held, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    mains = np.stack(frame["own"].iloc[held].to_numpy())
    every = np.stack(frame["all"].iloc[held].to_numpy()).reshape(len(held), mains.shape[1], -1)
    a, b = np.split(at.ravel(), 2)
    first = np.ones(len(i), dtype=bool)
    for part in range(0, len(i), 1 << 16):
        some = slice(part, part + (1 << 16))
        for t in range(mains.shape[1]):
            for u, v in ((a[some], b[some]), (b[some], a[some])):
                met = mains[u, t]
                first[some] &= ~((every[v, t] == met[:, None]).any(1) & (met < bucket[i[some]]))
    np.add.at(links, i[first], weight[j[first]])
    np.add.at(links, j[first], weight[i[first]])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"class": names[held], "links": links[held], "root": names[root[held]]})


def class_links(visited: DataFrame, similarity: float) -> DataFrame:
    """Stored rows (class, links, root) from every pair of blocks that holds a link."""
    spread = visited.select("class", F.explode("all").alias("bucket"), F.col("own").alias("mains"))
    spread = spread.select("class", "bucket", F.array_contains("mains", F.col("bucket")).alias("mine"))
    # Few members' marks, taken together, name a bucket's members.
    mark = [F.xxhash64("class", "mine", F.lit(k)).bitwiseAND(0xFFFFFFFF) for k in (0, 1)]
    buckets = spread.groupBy("bucket").agg(F.count("class").alias("count"), F.count_if("mine").alias("mains"), *[F.sum(m).alias(f"m{i}") for i, m in enumerate(mark)])
    buckets = buckets.where("count > 1 and mains > 0").groupBy("count", "m0", "m1").agg(F.min("bucket").alias("bucket"))
    kept = stored(buckets.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "polytope-buckets")
    members = spread.join(kept, "bucket").withColumn("block", F.pmod(F.xxhash64("class", "bucket"), "blocks").cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    at = ["bucket", "lo", "hi"]
    work = pairs.join(visited, "class").repartition(*at).sortWithinPartitions(*at)

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            # The last group may go on in the next frame.
            key = frame[at].to_numpy()
            cut = int(np.flatnonzero((key != key[-1]).any(1)).max(initial=-1)) + 1 if len(key) else 0
            rest = frame.iloc[cut:]
            if cut and len(out := verified(frame.iloc[:cut], similarity)):
                yield out
        if rest is not None and len(rest) and len(out := verified(rest, similarity)):
            yield out

    return stored(work.mapInPandas(run, "class string, links long, root string"), "polytope-links")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = SIMILARITY, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """Every row with ``n_links``, ``component_id`` and ``kept``."""
    v = F.col(vector).cast("array<double>")
    rows = packed(vectors, __id=F.col(key).cast("long"), __label=F.col(label), __v=v)
    rows = rows.withColumn("__use", usable(F.col("__label"), F.col("__v"))).withColumn("__class", F.when(F.col("__use"), class_name(F.col("__label"), F.col("__v"))))
    # Plus zero and minus zero are one value to a grouping, not to a hash: group by the name.
    classes = rows.where("__use").groupBy(F.col("__class").alias("class")).agg(F.count("__use").alias("weight"), F.min("__id").alias("id"), F.first("__label").alias("label"), F.first("__v").alias("v"))
    classes = stored(classes.withColumn("size", F.size("v")), "polytope-classes")
    counts = classes.groupBy("size", "label").agg(F.count("class").alias("rows")).groupBy("size").agg(F.max("rows").alias("rows"))
    # One row per vector length, not per vector.
    plans = {r["size"]: plan(r["rows"], r["size"], similarity, recall, probes) for r in counts.toLocalIterator()}
    found = class_links(visits(classes, plans, probes), similarity)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    labelled = classes.select("class", "weight", "id").join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    labelled = stored(labelled.select("class", "id", F.coalesce("root", "class").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "polytope-labelled")
    heads = labelled.groupBy("root").agg(F.min("id").alias("head"))
    resolved = stored(labelled.join(heads, "root").select("class", "head", "n_links"), "polytope-resolved")
    out = rows.drop("__v").join(resolved, F.col("__class") == F.col("class"), "left").select(
        "__row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("__use"), F.col("head")).otherwise(F.col("__id")).alias("component_id"), F.col("__id"))
    return unpacked(out.withColumn("kept", F.col("__id").eqNullSafe(F.col("component_id"))), "n_links", "component_id", "kept")
