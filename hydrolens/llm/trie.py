"""Prefix trie of conversations by adaptive radix trees over fixed-width turn ids.

A turn (role, text) gets an id of 16 bytes, a hash with its length in front, so that a conversation is a byte string of fixed-width big-endian ids.
Conversations are cut into segments of ``SEGMENT`` turns; a segment's key is the digest of all turns before it, again 16 bytes, and then its
turns. Keys are range partitioned on their bytes, hot equal keys also on the conversation, and every batch of keys goes into one
adaptive radix tree: nodes of 4, 16, 48 or 256 children that grow as needed, with compressed paths. Only byte depths at a turn's
end give trie nodes, inside compressed paths as well; each comes with the members that a batch has seen, so that batches are merged by
a sum on the node's digest. The digest of a prefix is a sum of hashes of (place, turn id), which a running total over ranges
gives to every turn, however long its conversation.

Sums over subtrees need no walk over the tree. A node belongs to its smallest member, and the nodes that a conversation owns
are a suffix of its path. So a sum over the subtree of a node is one over the node's members: of the turns that a member shares with
smaller ones, and of the leaves that members own.

Defined cases: rows without a conversation id take no part; null role or text is empty; null turn numbers come first, ties go by the hash of
role and text, so repeated rows are turns of their own; a conversation without turns is a member of the root; an empty table
gives no node; other input columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.operators.ranking import running_totals

from .common import stored, text_of

WIDTH, SEGMENT = 16, 64
#: Conversation ids whose quotient by this is equal are written into one piece of a member list.
PIECE = 1 << 14
NODE = ["depth", "a", "b"]
_MASK = 0xFFFFFFFF


class Node:
    """A node with a compressed path before it. Children lie in one of four layouts, by their number."""

    __slots__ = ("path", "room", "bytes", "kids", "ends")

    def __init__(self, path: bytes):
        self.path, self.room, self.bytes, self.kids, self.ends = path, 4, bytearray(), [], []

    def find(self, byte: int):
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid: "Node") -> None:
        """Add a child, or replace the one of this byte."""
        if self.room == 256:
            self.kids[byte] = kid
            return
        at = self.bytes[byte] - 1 if self.room == 48 else self.bytes.find(byte)
        if at >= 0:
            self.kids[at] = kid
            return
        if len(self.kids) == self.room:
            self.grow()
            self.put(byte, kid)
            return
        if self.room == 48:
            self.bytes[byte] = len(self.kids) + 1
        else:
            self.bytes.append(byte)
        self.kids.append(kid)

    def grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.bytes):
                index[byte] = i + 1
            self.room, self.bytes = 48, index
        else:
            self.room, self.kids, self.bytes = 256, [self.kids[at - 1] if at else None for at in self.bytes], bytearray()

    def children(self):
        return [kid for kid in self.kids if kid is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


class Radix:
    """An adaptive radix tree; ``members`` end at the node of their key."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, member: int) -> None:
        above, node, at = None, self.root, 0
        while True:
            rest = key[at:at + len(node.path)]
            common = len(rest) if rest == node.path else shared(rest, node.path)
            if common < len(node.path):
                fork = Node(node.path[:common])
                fork.put(node.path[common], node)
                above.put(key[at - 1], fork)
                node.path = node.path[common + 1:]
                node = fork
            at += common
            if at == len(key):
                node.ends.append(member)
                return
            above, kid = node, node.find(key[at])
            if kid is None:
                leaf = Node(key[at + 1:])
                leaf.ends.append(member)
                node.put(key[at], leaf)
                return
            node, at = kid, at + 1

    def aligned(self, width: int):
        """(depth in units of ``width``, members below, smallest member, members that end here) for every aligned byte depth, children first."""
        stack, totals = [(self.root, 0, False)], {}
        while stack:
            node, top, ready = stack.pop()
            bottom = top + len(node.path)
            if not ready:
                stack.append((node, top, True))
                stack.extend((kid, bottom + 1, False) for kid in node.children())
                continue
            below = [totals.pop(id(kid)) for kid in node.children()]
            count = len(node.ends) + sum(n for n, _ in below)
            if not count:
                return
            low = min([*node.ends, *(m for _, m in below)])
            totals[id(node)] = count, low
            # The byte that leads here stands at top - 1, so depth top is this node's when its path is empty or goes on.
            for depth in range(bottom // width, -(-top // width) - 1, -1):
                if depth * width or node is self.root:
                    yield depth, count, low, node.ends if depth * width == bottom else ()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes as lowercase hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)


def numbered(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored rows (conv, pos, turn, size): the turns of each conversation from 0, their ids, and the UTF-8 bytes of their texts."""
    base = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(order).alias("at"), turn_id(text_of(role), text_of(text)).alias("turn"), F.octet_length(text_of(text)).cast("long").alias("size"))
    ranked = running_totals(base, [("at", True), ("turn", True)], ["conv"])
    return stored(ranked.select("conv", (F.col("row_rank") - 1).alias("pos"), "turn", "size"), "trie-turns")


def grafted(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which every conversation begins with the first turns of its family's first one.

    The family of c starts at c - c % ``family``; c takes crc32(c) % ``most`` turns from there and goes on with its own after as many.
    The second frame has a row (conv, total) for every conversation, those without turns too.
    """
    convs = turns.groupBy("conv").agg(F.count("pos").alias("own"))
    convs = convs.withColumn("head", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("base", F.col("conv") - F.col("conv") % family)
    # At most most - 1 turns a family.
    heads = stored(turns.where((F.col("conv") % family == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base"), "trie-heads")
    there = heads.groupBy("base").agg(F.count("pos").alias("there"))
    convs = convs.join(there, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("head")))
    convs = stored(convs.select("conv", "base", "head", "taken", "total"), "trie-conversations")
    own = turns.join(convs, "conv").where(F.col("pos") >= F.col("head")).select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), "turn", "size", "total")
    begin = heads.join(convs, "base").where(F.col("pos") < F.col("head")).select("conv", "pos", "turn", "size", "total")
    return own.unionByName(begin), convs.select("conv", "total")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of ``numbered`` turns as they are."""
    convs = stored(turns.groupBy("conv").agg(F.count("pos").alias("total")), "trie-conversations")
    return turns.join(convs, "conv"), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """Stored turns with the digests (a, b) of the prefix that they end, (a0, b0) of the one before, and the bytes up to them."""
    lanes = [F.xxhash64("pos", "turn"), F.xxhash64("turn", "pos", F.lit(1))]
    pieces = {f"p{i}": F.shiftright(lane, shift).bitwiseAND(_MASK) for i, (lane, shift) in enumerate((lane, s) for lane in lanes for s in (32, 0))}
    running = running_totals(turns.withColumns(pieces), [("pos", True)], ["conv"], [*pieces, "size"])
    sums = [F.col(f"{p}_running") for p in pieces]
    before = [F.col(f"{p}_running") - F.col(p) for p in pieces]
    digest = lambda s: F.shiftleft(s[0].bitwiseAND(_MASK), 32).bitwiseOR(s[1].bitwiseAND(_MASK))
    return stored(running.select(
        "conv", "pos", "turn", "size", "total", digest(sums[:2]).alias("a"), digest(sums[2:]).alias("b"), digest(before[:2]).alias("a0"), digest(before[2:]).alias("b0"),
        F.col("size_running").alias("upto")), "trie-prefixes")


def segments(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """Keys of at most ``SEGMENT`` turns, in key order."""
    grouped = placed.withColumn("seg", F.floor(F.col("pos") / SEGMENT)).groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "a", "b", "size", "upto", "a0", "b0"))).alias("t"), F.first("total").alias("total"))
    key = lambda turns: F.unhex(F.array_join(turns, ""))
    full = grouped.select(
        "conv", (F.col("seg") * SEGMENT).alias("depth"), F.col("t")[0]["a0"].alias("a"), F.col("t")[0]["b0"].alias("b"), key(F.col("t.turn")).alias("key"),
        F.col("t.a").alias("as"), F.col("t.b").alias("bs"), F.col("t.size").alias("sizes"), F.col("t.upto").alias("uptos"), (F.col("seg") * SEGMENT + F.size("t") == F.col("total")).alias("last"))
    none = F.lit(None).cast("array<long>")
    zero = F.lit(0).cast("long")
    bare = convs.where("total = 0").select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(b"").alias("key"), *[none.alias(c) for c in ("as", "bs", "sizes", "uptos")], F.lit(True).alias("last"))
    by = ["a", "b", "key", "conv"]
    return full.unionByName(bare).repartitionByRange(*by).sortWithinPartitions(*by)


def partial_nodes(keys: DataFrame) -> DataFrame:
    """Stored trie nodes as far as each batch of keys sees them."""

    def run(frames):
        for frame in frames:
            tree = Radix()
            conv = frame["conv"].tolist()
            a0, b0, depth0, last = (frame[c].tolist() for c in ("a", "b", "depth", "last"))
            steps = [frame[c].tolist() for c in ("as", "bs", "sizes", "uptos")]
            # Members in the order of their ids, so that the smallest member of a subtree is its smallest number.
            order = sorted(range(len(conv)), key=conv.__getitem__)
            keys_ = frame["key"].tolist()
            for rank, i in enumerate(order):
                tree.insert(a0[i].to_bytes(8, "big", signed=True) + b0[i].to_bytes(8, "big", signed=True) + bytes(keys_[i]), rank)
            out = []
            for level, count, low, ends in tree.aligned(WIDTH):
                i, k = order[low], level - 2
                ended = [conv[order[m]] for m in ends if last[order[m]]]
                if level == 1 and depth0[i] == 0:
                    out.append((0, 0, 0, 0, 0, conv[i], count, 0, 0, ended))
                elif level > 1:
                    above = (a0[i], b0[i]) if k == 0 else (int(steps[0][i][k - 1]), int(steps[1][i][k - 1]))
                    out.append((depth0[i] + k + 1, int(steps[0][i][k]), int(steps[1][i][k]), *above, conv[i], count, int(steps[2][i][k]), int(steps[3][i][k]), ended))
            yield pd.DataFrame(out, columns=["depth", "a", "b", "pa", "pb", "conv", "n", "size", "upto", "ends"])

    return stored(keys.mapInPandas(run, "depth long, a long, b long, pa long, pb long, conv long, n long, size long, upto long, ends array<long>"), "trie-partial")


def member_lists(partial: DataFrame) -> DataFrame:
    """Rows (depth, a, b, ends_sha256): the hash of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined in pieces of bounded ranges; the pieces of a node are hashed one after the other, so no list is ever whole.
    """
    ids = partial.select(*NODE, F.explode("ends").alias("id")).withColumn("piece", F.floor(F.col("id") / PIECE))
    pieces = ids.groupBy(*NODE, "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("list"))
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(frames):
        at, digest = None, None
        for frame in frames:
            out = []
            for node, part in zip(zip(*[frame[c].tolist() for c in NODE]), frame["list"]):
                if node != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    return ordered.mapInPandas(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, pos, turn, size, total) and ``convs`` (conv, total).

    A node is named by its smallest member and its depth, so its last turn is that of ``conv_id`` at place depth - 1.
    """
    placed = prefixes(turns)
    partial = partial_nodes(segments(placed, convs))
    nodes = stored(partial.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("size").alias("size"), F.max("upto").alias("upto")), "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("children"))
    counted = stored(nodes.join(children, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long")), "trie-counted")
    # The nodes of an owner are a suffix of its path.
    owners = counted.groupBy("conv").agg(F.min(F.struct("depth", (F.col("upto") - F.col("size")).alias("before"))).alias("first"), F.max(F.struct("depth", "children")).alias("deepest"))
    owners = stored(owners.select("conv", F.col("first.before").alias("before"), (F.col("deepest.children") == 0).cast("long").alias("leaf")), "trie-owners")
    # A conversation that owns nothing shares all its turns and has no leaf.
    none_owned = placed.groupBy("conv").agg(F.max("upto").alias("bytes")).join(owners, "conv", "left_anti").select("conv", F.col("bytes").alias("before"), F.lit(0).cast("long").alias("leaf"))
    parts = stored(owners.unionByName(none_owned), "trie-shares")
    zero = F.lit(0).cast("long")
    members = placed.select("conv", (F.col("pos") + 1).alias("depth"), "a", "b", (F.col("upto") - F.col("size")).alias("done"))
    members = members.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("done")))
    sums = members.join(parts, "conv").groupBy(*NODE).agg(F.sum("leaf").alias("leaves"), F.sum(F.greatest(zero, F.col("before") - F.col("done"))).alias("saved"))
    above = counted.select(F.col("depth").alias("d"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("conv").alias("parent"))
    out = counted.join(sums, NODE).join(member_lists(partial), NODE, "left")
    out = out.join(above, (F.col("depth") - 1 == F.col("d")) & (F.col("pa") == F.col("x")) & (F.col("pb") == F.col("y")), "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
