"""Byte-pair encoding and decoding as streaming transducers, and the token stores built on public vocabularies.

``Encoder`` reads a text piece by piece. It keeps the bytes whose tokens may still change and emits a token as soon as no
continuation can change it. How far a change can reach follows from the merge list alone (``reach``), so the memory
is constant. ``Decoder`` turns ids into text with an incremental byte-to-text state machine.

Defined cases: null text counts as empty and gives no ids; repeated rows are each encoded; an empty table gives an empty
table; the strings of added tokens inside a text are those tokens, as the public library has them by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked

#: Fixed value: the pattern that cuts a text before the merges (byte-level vocabularies).
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A contraction is at most this long, so a cut further than this from the end of a piece is final.
LOOK = 3
#: Characters read at a time, and entries and length of the memo of short units.
PIECE, MEMO, SHORT = 1 << 16, 200_000, 48
#: A unit without an end that is longer than this is read on byte by byte, as one run of the classes of ``CUT``.
OPEN, SPACES = 4096, r"\s+"
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", SPACES)
#: A word of Latin letters and a stop: two cuts of ``CUT``, found without it.
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0240]+)([,.]?)")


def byte_letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Vocabulary:
    """Ids, ranked merges and added tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.first = [vocab[c] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.rank = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [made for _, made in self.merges.values()]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: t.encode() for t, i in self.added.items()})
        self.reach = self._reach()

    def _reach(self) -> int:
        """A sufficient lookahead in bytes.

        Bytes that follow can change a merge only if they change the symbol at its right, and so on from right to left
        through merges of rising rank. ``far[x]`` is the length of the longest such chain whose left end is the symbol x;
        one pass over the merges in rank order gives all of them.
        """
        size = {i: len(b) for i, b in self.bytes_of.items()}
        far: dict[int, int] = {}
        for (a, b), (_, ab) in self.merges.items():
            n = max(size[a] + far.get(b, size[b]), far.get(a, 0))
            far[a] = max(far.get(a, 0), n)
            far[ab] = max(far.get(ab, 0), n)
        return max(far.values(), default=1) + max(size.values())

    def merge(self, data: bytes) -> list[int]:
        """Ids of a byte string: the pair of lowest rank first, the leftmost one on ties."""
        ids = [self.first[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, made, none = self.rank, self.made, len(self.made)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i:i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        import heapq

        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = ab, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [x for x, keep in zip(ids, alive) if keep]


class Encoder:
    """The transducer of one text: ``feed`` pieces, then ``end``; both return the ids that have become stable."""

    def __init__(self, vocabulary: Vocabulary, memo: dict):
        import regex

        self.v, self.memo = vocabulary, memo
        self.cut = regex.compile(CUT)
        self.runs = [regex.compile(r) for r in RUNS]
        self.rest, self.open, self.run = "", b"", None

    def _bytes(self, data: bytes, last: bool) -> list[int]:
        """Bytes of the unit that is being read. Tokens that end before the reach of what may follow are emitted."""
        self.open += data
        if last:
            ids, self.open = self.v.merge(self.open), b""
            return ids
        if len(self.open) <= 4 * self.v.reach:
            return []
        ids, at, out = self.v.merge(self.open), 0, []
        for i in ids:
            at += len(self.v.bytes_of[i])
            if at > len(self.open) - self.v.reach:
                at -= len(self.v.bytes_of[i])
                break
            out.append(i)
        self.open = self.open[at:]
        return out

    def _unit(self, text: str) -> list[int]:
        ids = self.memo.get(text)
        if ids is None:
            ids = self.v.merge(text.encode("utf-8", "surrogatepass"))
            if len(text) <= SHORT and len(self.memo) < MEMO:
                self.memo[text] = ids
        return ids

    def _ids(self, text: str, out: list[int]) -> None:
        """Whole units: from one blank that follows a letter to the next, the cuts do not depend on what stands around them."""
        units, held = self.memo.setdefault(None, {}), []
        for k, part in enumerate(text.split(" ")):
            unit = " " + part if k else part
            if not part or part[-1].isspace() or held:
                held.append(unit)
                if not part or part[-1].isspace():
                    continue
                unit, held = "".join(held), []
            ids = units.get(unit)
            if ids is None:
                plain = PLAIN.fullmatch(unit)
                if plain:
                    ids = self._unit(plain[1]) + self._unit(plain[2]) if plain[2] else self._unit(plain[1])
                else:
                    ids = [i for m in self.cut.findall(unit) for i in self._unit(m)] if len(unit) <= 4 * self.v.reach else self._stream(unit)
                if len(unit) <= SHORT and len(units) < MEMO:
                    units[unit] = ids
            out.extend(ids)
        if held:
            unit = "".join(held)
            out.extend(i for m in self.cut.findall(unit) for i in self._unit(m))

    def _stream(self, unit: str) -> list[int]:
        out: list[int] = []
        for m in self.cut.finditer(unit):
            for at in range(m.start(), m.end(), PIECE):
                to = min(m.end(), at + PIECE)
                out += self._bytes(unit[at:to].encode("utf-8", "surrogatepass"), to == m.end())
        return out

    def feed(self, piece: str) -> list[int]:
        """Ids that have become stable. What is kept is short: the rest up to ``OPEN`` characters, or some bytes of an open unit."""
        text, out = self.rest + piece, []
        if self.run is not None:
            text = self._run_on(text, out)
        if self.run is None:
            text = self._settled(text, out)
        self.rest = text
        return out

    def _settled(self, text: str, out: list[int]) -> str:
        """Everything before the last blank that follows other than white space is final; without blanks, so is every cut that ends before the text."""
        at = text.rfind(" ")
        while at > 0 and text[at - 1].isspace():
            at = text.rfind(" ", 0, at)
        if at > 0:
            self._ids(text[:at], out)
            text = text[at:]
        if len(text) <= OPEN:
            return text
        at = 0
        for m in self.cut.finditer(text):
            if m.end() == len(text) or m.start() + LOOK > len(text):
                break
            out.extend(self._unit(m[0]) if len(m[0]) <= 4 * self.v.reach else self._stream(m[0]))
            at = m.end()
        text = text[at:]
        if len(text) <= OPEN:
            return text
        self.run = next(r for r in self.runs if r.match(text[-1]))
        if text[0] == " " and self.run.pattern != SPACES:
            self._bytes(b" ", False)
            text = text[1:]
        return self._run_on(text, out)

    def _run_on(self, text: str, out: list[int]) -> str:
        """Read the open unit on, up to its end if that has come. The last of several blanks may belong to the next unit, so it waits."""
        m = self.run.match(text)
        n = m.end() if m else 0
        ended = n < len(text)
        n -= self.run.pattern == SPACES and n > 0
        for at in range(0, n, OPEN):
            out.extend(self._bytes(text[at:min(n, at + OPEN)].encode("utf-8", "surrogatepass"), False))
        if ended:
            out.extend(self._bytes(b"", True))
            self.run = None
        return text[n:]

    def end(self) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            out = self._bytes(self.rest.encode("utf-8", "surrogatepass"), True)
        elif self.rest:
            self._ids(self.rest, out)
        self.rest, self.run = "", None
        return out


class Decoder:
    """Ids to text, one step at a time: bytes of a character that is not complete wait for the next id."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        known = self.v.bytes_of
        return self.state.decode(b"".join([known[i] for i in ids]))

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(4)
def vocabulary(path: str) -> tuple[Vocabulary, dict]:
    return Vocabulary(path), {}


def encode_stream(text: str, path: str):
    """Lists of ids of one text, with constant memory beside the text itself."""
    v, memo = vocabulary(path)
    import regex

    marks = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
    for part in marks.split(text) if marks and any(t in text for t in v.added) else [text]:
        if part in v.added:
            yield [v.added[part]]
            continue
        encoder = Encoder(v, memo)
        for at in range(0, len(part), PIECE):
            yield encoder.feed(part[at:at + PIECE])
        yield encoder.end()


def encode(text: str, path: str) -> np.ndarray:
    lists = list(encode_stream(text, path))
    return np.fromiter((i for x in lists for i in x), dtype="<u4", count=sum(map(len, lists)))


def decode(ids, path: str) -> str:
    decoder = Decoder(vocabulary(path)[0])
    return "".join([*(decoder.feed(ids[at:at + PIECE].tolist()) for at in range(0, len(ids), PIECE)), decoder.end()])


def with_ids(docs: DataFrame, path: str, text: str = "text", result: str = "ids") -> DataFrame:
    """Every row with the ids of its text."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t, path).astype("i4") for t in texts])

    return unpacked(packed(docs, __text=text_of(text)).withColumn(result, ids("__text")), result)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with ``n_tokens`` and digests of its ids (unsigned, little-endian) and of the decoded text; ids stay inside the task."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        rows = []
        v, _ = vocabulary(path)
        for t in texts:
            seen, plain, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(v)
            for ids in encode_stream(t, path):
                if ids:
                    n += len(ids)
                    seen.update(np.array(ids, dtype="<u4").tobytes())
                    plain.update(decoder.feed(ids).encode("utf-8"))
            plain.update(decoder.end().encode("utf-8"))
            rows.append((n, seen.hexdigest(), plain.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    out = packed(docs, __text=text_of(text)).withColumn("__d", digests("__text"))
    return unpacked(out.select("__row", "__d.*"), "n_tokens", "ids_sha256", "decoded_sha256")
