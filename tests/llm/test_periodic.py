"""Periodic runs against a scan of all periods."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from hydrolens.llm.periodic import Squares, collapse_runs, repeated_tail, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(rng):
    n = rng.randint(0, 120)
    w = [str(rng.randrange(rng.randint(1, 4))) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = "x"
    return w


def test_runs_equal_brute_force_however_they_are_appended():
    rng = random.Random(5)
    for k in range(600):
        texts = [made(rng) for _ in range(rng.randint(1, 4))]
        assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts)] == [brute(w) for w in texts]
        if k % 5 == 0:
            number = {}
            ids = np.array([number.setdefault(w, len(number)) for w in texts[0]], dtype=np.int64)
            squares, at = Squares(), 0
            while at < len(ids):
                step = rng.choice([1, 1, 1, 5])
                squares.append(ids[at:at + step])
                at += step
            assert [tuple(r) for r in squares.end().tolist()] == brute(texts[0])


def test_lower_exponents():
    """With two periods and two words the result is every run of the text."""
    rng = random.Random(6)
    for exponent in (2, 3):
        texts = [made(rng) for _ in range(200)] + [list("abaababaabaab")]
        assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts, exponent, 2)] == [brute(w, exponent, 2) for w in texts]


def test_one_word_for_ever_is_one_run():
    assert runs_of([["a"] * 60_000])[0].tolist() == [[0, 60_000, 1]]


def want(words):
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_collapse(spark, docs, none):
    rng = random.Random(9)
    more = docs.unionByName(spark.createDataFrame([(100 + i, " ".join(["", "\t\n "]) + " \x0b".join(made(rng)), "s", 0, "r") for i in range(80)], docs.schema))
    rows = collapse_runs(more.withColumn("start", F.lit("clash"))).collect()
    assert len(rows) == more.count()
    for r in rows:
        got = (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], [tuple(x) for x in r["runs"]], r["collapsed_text"])
        assert got == want(WORD.findall(r["text"] or ""))
        assert r["__row"] is None or isinstance(r["__row"], str)
    assert collapse_runs(none).count() == 0


def test_repeated_tail(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 60)) + " ") for i in range(400)] + [(None, "a b"), (7, None), (8, "")]
    edited = spark.createDataFrame(rows, "doc_id long, text string").withColumn("out", repeated_tail(F.col("text"), F.col("doc_id"))).collect()
    changed = 0
    for r in edited:
        words = WORD.findall(r["text"] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert WORD.findall(r["out"] or "") == words
    assert changed > 20
