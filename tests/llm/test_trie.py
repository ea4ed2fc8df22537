"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib

from hydrolens.llm.trie import Radix, grafted, numbered, prefix_trie, whole

SCHEMA = "conv_id long, turn long, role string, text string, total long, a string"


def test_radix_tree_equals_prefix_dictionary():
    """All four layouts, compressed paths, keys that end inside others, and depths inside compressed paths."""
    rng = random.Random(3)
    for _ in range(300):
        width = rng.choice([1, 2, 4])
        keys = [bytes(rng.randrange(rng.choice([2, 256])) for _ in range(width * rng.randint(0, 6))) for _ in range(rng.randint(1, 400))]
        tree, want = Radix(), {}
        for i, key in enumerate(keys):
            tree.insert(key, i)
            for d in range(len(key) // width + 1):
                want.setdefault((d, key[:d * width]), []).append(i)
        got = sorted((d, n, low, sorted(ends)) for d, n, low, ends in tree.aligned(width))
        assert got == sorted((d, len(m), m[0], [i for i in m if keys[i] == p]) for (d, p), m in want.items())


def test_layouts_grow():
    tree = Radix()
    rooms = set()
    for i in range(256):
        tree.insert(bytes([i, 1]), i)
        rooms.add(tree.root.room)
    assert rooms == {4, 16, 48, 256}


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32])
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


def brute(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    kids = {p: sum(1 for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p) for p in nodes}
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(str(c) for c in members if tuple(convs[c]) == p)
        out.add((
            members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), kids[p], sum(kids[q] == 0 for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(rng):
    rows = []
    for c in [*range(-6, 24), 30, 41, 42, 100_000, 100_001]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é b", "", None, "𝒳" * 3]), t, "x"))
    rows += [(50, t, "user", "same" if t < 150 else f"own {t}", 0, "") for t in range(200)] + [(52, t, "user", "same", 0, "") for t in range(170)]
    return rows + [rows[3], rows[3], (None, 1, "user", "lost", 0, "")]


def same(frame, want):
    got = frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_as_it_is(spark):
    rows = rows_of(random.Random(7))
    same(prefix_trie(*whole(numbered(spark.createDataFrame(rows, SCHEMA)))), brute(ordered(rows)))


def test_trie_with_shared_beginnings(spark):
    rows = rows_of(random.Random(8))
    convs = ordered(rows)
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = convs.get(base, [])[:h] + own[h:]
    assert any(not t for t in built.values())
    same(prefix_trie(*grafted(numbered(spark.createDataFrame(rows, SCHEMA)))), brute(built))


def test_no_conversation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(*grafted(numbered(none))).count() == 0


def test_long_member_lists(spark):
    """Members of one node in several pieces of ids are hashed in ascending order."""
    rows = [(c, 0, "user", "hello", 0, "") for c in [-3, 5, 9, 70_000, 200_001, 200_002]]
    same(prefix_trie(*whole(numbered(spark.createDataFrame(rows, SCHEMA)))), brute(ordered(rows)))
