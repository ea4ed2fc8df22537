"""Periodic runs of words by online dyadic square catching.

A text is read as words that are appended, one by one or many at a time. Level k owns the squares whose period lies between
2b - 1 and 4b - 2, where b = 2**k: the first half of such a square holds a completed block of b words that starts at a multiple
of b, and that block occurs again one period later. Every completed block is a catcher. A word that is appended completes one
block hash on each level (two halves of the level below) and is compared with exactly two catchers there, so the work is
n log n, whatever the text. Caught blocks of one period that follow each other are one chain of overlapping squares; a chain
that can grow no more is extended by less than b words to each side, word by word, which gives the run to the word and leaves
nothing to chance in the hashes. A stretch that is found with several periods keeps the smallest.

Appending one word at a time and appending a whole text give the same runs. The texts of a batch are appended to one stream with
a word of its own between two texts, which nothing equals, so short texts cost no more than long ones.

Defined cases: null and empty texts have no words and no runs, repeated rows each get their result, ties of the best run go to
the smaller start, then the smaller period; very long texts are read whole, in memory in proportion to their words; input columns stay
as they are, a result replaces a column of its name; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, text_of, unpacked
from .substrings import mixed, words_of

EXPONENT, LEAST = 4, 6
#: Words of texts that share one stream; a longer text has a stream of its own.
STREAM = 1 << 17
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.zeros(0, dtype=np.int64)


class Level:
    """Catchers of blocks of ``b`` words: block hashes so far, and chains (period, first block, last block) that may still grow."""

    def __init__(self, b: int):
        self.b, self.hashes, self.chains = b, np.zeros(0, np.uint64), (_NONE, _NONE, _NONE)

    def advance(self, lower: np.ndarray, words: int):
        """Complete the blocks that the new words end, compare each with its two catchers, and return the chains that are closed."""
        b, done = self.b, len(self.hashes)
        if words - b + 1 > done:
            half = b // 2
            new = mixed(lower[done:words] + _LEFT) if b == 1 else mixed(lower[done:words - b + 1] * _LEFT + lower[done + half:words - half + 1] * _RIGHT)
            self.hashes = np.concatenate([self.hashes, new])
            at = np.arange(done, words - b + 1)
            near = (at - (2 * b - 1)) // b * b
            caught_at, caught = [], []
            for first in (near, near - b):
                hit = np.flatnonzero((first >= 0) & (self.hashes[np.maximum(first, 0)] == new))
                caught_at.append(at[hit])
                caught.append(first[hit])
            at, first = np.concatenate(caught_at), np.concatenate(caught)
            self.merge(at - first, first)
        return self.closed(words)

    def merge(self, period: np.ndarray, first: np.ndarray) -> None:
        if not len(period):
            return
        q, lo, hi = (np.concatenate(x) for x in zip(self.chains, (period, first, first)))
        by = np.lexsort((lo, q))
        q, lo, hi = q[by], lo[by], hi[by]
        head = np.concatenate([[True], (q[1:] != q[:-1]) | (lo[1:] != hi[:-1] + self.b)])
        start = np.flatnonzero(head)
        self.chains = q[start], lo[start], hi[np.concatenate([start[1:], [len(q)]]) - 1]

    def closed(self, words: int, last: bool = False):
        """Take out the chains whose next block has been compared, or all at the end."""
        q, lo, hi = self.chains
        over = np.full(len(q), True) if last else hi + q + 2 * self.b <= words
        self.chains = q[~over], lo[~over], hi[~over]
        return q[over], lo[over], hi[over]


class Squares:
    """Runs of at least ``exponent`` periods and ``least`` words among the words appended so far."""

    def __init__(self, exponent: int = EXPONENT, least: int = LEAST, longest: int | None = None):
        self.exponent, self.least, self.longest = exponent, least, longest
        self.words, self.levels = np.zeros(0, np.int64), [Level(1)]
        self.found: dict[tuple[int, int], int] = {}

    def shortest(self, period):
        return np.maximum(self.least, self.exponent * period)

    def append(self, ids: np.ndarray) -> None:
        """Append words, given as numbers that are equal where the words are."""
        self.words = np.concatenate([self.words, ids])
        n = len(self.words)
        reach = n if self.longest is None else min(n, self.longest)
        while self.exponent * (4 * self.levels[-1].b - 1) <= reach:
            self.levels.append(Level(2 * self.levels[-1].b))
        for k, level in enumerate(self.levels):
            lower = self.levels[k - 1].hashes if k else self.words.view(np.uint64)
            self.report(level.b, *level.advance(lower, n))

    def end(self) -> np.ndarray:
        """The runs (start, length, period), by start, then period."""
        for level in self.levels:
            self.report(level.b, *level.closed(len(self.words), last=True))
        return np.array(sorted((start, length, period) for (start, length), period in self.found.items()), dtype=np.int64).reshape(-1, 3)

    def report(self, b: int, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Merge closed chains into runs."""
        # A run of this period holds so many whole blocks at least.
        enough = (hi - lo) // b + 1 >= np.maximum(1, (self.shortest(q) - q + 1) // b - 1)
        q, lo, hi = q[enough], lo[enough], hi[enough]
        if not len(q):
            return
        by = np.argsort(lo, kind="stable")
        q, lo, hi = q[by], lo[by], hi[by]
        # Chains inside a run whose period divides theirs are that run again.
        again = np.zeros(len(q), dtype=bool)
        low = int(self.shortest(q.min()))
        for (start, length), p in self.found.items():
            if length >= low:
                i, j = np.searchsorted(lo, [start, start + length])
                again[i:j] |= (hi[i:j] + b + q[i:j] <= start + length) & (q[i:j] % p == 0)
        w, n = self.words, len(self.words)
        for k in sorted(np.flatnonzero(~again), key=q.__getitem__):
            p, first, last = int(q[k]), int(lo[k]), int(hi[k]) + b
            if not np.array_equal(w[first:last], w[first + p:last + p]):
                first, last = self.checked(p, first, last)
            back = max(first - b, 0)
            differ = np.flatnonzero(w[back:first] != w[back + p:first + p])
            first = back + int(differ[-1]) + 1 if len(differ) else back
            ahead = min(last + b, n - p)
            differ = np.flatnonzero(w[last:ahead] != w[last + p:ahead + p])
            last = last + int(differ[0]) if len(differ) else max(ahead, last)
            length = last - first + p
            if length >= self.shortest(p):
                at = (first, length)
                self.found[at] = min(p, self.found.get(at, p))

    def checked(self, p: int, first: int, last: int) -> tuple[int, int]:
        """The longest truly equal part, should block hashes ever meet by chance."""
        differ = np.concatenate([[first - 1], first + np.flatnonzero(self.words[first:last] != self.words[first + p:last + p]), [last]])
        k = int(np.argmax(np.diff(differ)))
        return int(differ[k]) + 1, int(differ[k + 1])


def runs_of(texts: list[list[str]], exponent: int = EXPONENT, least: int = LEAST) -> list[np.ndarray]:
    """The runs of each text, given as lists of words, by one stream."""
    sizes = np.array([len(t) for t in texts])
    ids = pd.factorize(np.array([w for t in texts for w in t], dtype=object))[0].astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    # After each text a number that occurs nowhere else.
    ends = np.cumsum(sizes)
    stream = np.insert(ids, ends, -1 - np.arange(len(texts)))
    squares = Squares(exponent, least, longest=int(sizes.max(initial=0)))
    squares.append(stream)
    found = squares.end()
    starts = ends - sizes + np.arange(len(texts))
    of = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[of] if len(found) else 0
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    return [found[cuts[i]:cuts[i + 1]] for i in range(len(texts))]


def summary(words: list[str], runs: np.ndarray):
    """One row of RESULT."""
    if not len(runs):
        return 0, None, None, None, None, [], " ".join(words)
    best = runs[0].tolist()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs.tolist():
        edge[start + period] += 1
        edge[start + length] -= 1
        if length * best[2] > best[1] * period:
            best = [start, length, period]
    kept = np.cumsum(edge[:-1]) == 0
    rows = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
    return len(runs), *best, 1000 * best[1] // best[2], rows, " ".join(w for w, k in zip(words, kept.tolist()) if k)


def collapse_runs(docs: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Every row with its runs, the run of the greatest exponent, and the text without the repetitions."""

    @F.pandas_udf(RESULT)
    def found(column: pd.Series) -> pd.DataFrame:
        out, group, held = [], [], 0

        def flush():
            out.extend(summary(words, runs) for words, runs in zip(group, runs_of(group, exponent, least)))

        for t in column:
            words = words_of(t)
            if group and held + len(words) > STREAM:
                flush()
                group, held = [], 0
            group.append(words)
            held += len(words)
        if group:
            flush()
        return pd.DataFrame(out, columns=["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_text"])

    rows = packed(docs, __text=text_of(text)).withColumn("__found", found("__text"))
    return unpacked(rows.select("__row", "__found.*"), "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_text")


def repeated_tail(text: Column, key: Column) -> Column:
    """The words of a text; where the hash of the key is divisible by ten, they repeat from some word on."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        place = lambda i: F.when(i < a, i.cast("long")).otherwise(a + F.pmod(i.cast("long") - a, p)).cast("int")
        return F.when(n > 0, F.transform(w, lambda _, i: F.get(w, place(i)))).otherwise(w)

    return F.when((h % 10 == 0) & key.isNotNull(), F.array_join(let(words, edited), " ")).otherwise(text)
