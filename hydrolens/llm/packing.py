"""Packing by concatenate and cut.

All documents form one long stream of tokens, an end token after each. The first pass tokenizes, numbers the tokens inside
each partition and stores them; a prefix sum over the partition totals (one row per partition) gives every document its
global offset. The second pass cuts the stream every ``length`` tokens and writes a boundary record per piece, so all
sequences but the last are full.

Defined cases: null text counts as empty (its end token is packed), repeated rows are each packed, a text of any length is cut
into as many pieces as it needs, an empty table gives no pieces. Only the key and the text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, stored, text_of
from .tokens import byte_letters

LENGTH, END = 4096, 2
#: White space on which the vocabulary's rules and str.split() may disagree.
ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Words of Latin letters that lower case and composition leave one by one, digits and marks; no contraction or added token can begin in them.
PLAIN = re.compile("[A-Za-z0-9!-&(-/:;=-@\\[-`{-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0240]+")
#: Fixed value: the runs that the vocabulary's rules cut such a word into, after lower case.
RUN = re.compile("[a-z\x80-\U0010ffff]+|[0-9]|[!-/:-@\\[-`{-~]+")
#: Words kept in a worker's memo, and about the bytes of the texts that are encoded together (one text at least).
MEMO, CHUNK = 200_000, 1 << 23


class WordIds:
    """Ids of a text from the public tokenizer, word by word: no token of a word-end vocabulary crosses white space.

    Plain words are cut into runs, which go straight to the tokenizer's merge model; all others take its whole path. The first
    ``MEMO`` different words and as many runs of a worker are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.runs = Tokenizer.from_file(path), {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _run(self, run: str) -> tuple[int, ...]:
        ids = self.runs.get(run)
        if ids is None:
            ids = tuple([t.id for t in self.merge(run if run.isascii() else "".join([self.letters[b] for b in run.encode()]))])
            if len(self.runs) < MEMO:
                self.runs[run] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        if PLAIN.fullmatch(word) is None:
            return tuple(self._whole(word))
        low = word.lower()
        if low.isalpha():
            return self._run(low)
        ids = ()
        for run in RUN.findall(low):
            ids += self._run(run)
        return ids

    def __call__(self, text: str, end: int) -> np.ndarray:
        return self.many(pa.array([text]), end)[1]

    def many(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of many texts, ``end`` after each. Arrow splits them and makes their words distinct, so that a
        word is looked up once however often it occurs; a text with odd white space counts as one word and is encoded whole."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False))
        whole = [self._whole(texts[int(i)].as_py()) for i in odd]
        if len(odd):
            texts = pc.if_else(pc.match_substring_regex(texts, ODD_SPACE), "", texts)
        # a blank text is one empty word, as are blanks at the ends; empty words have no ids
        lists = pc.ascii_split_whitespace(texts)
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        memo, words = self.memo, coded.dictionary.to_pylist()
        own = [*map(memo.get, words), *whole]
        for i, word in enumerate(words):
            if own[i] is None:
                own[i] = self._word(word) if word else ()
                if len(memo) < MEMO:
                    memo[word] = own[i]
        codes = coded.indices.to_numpy().copy()
        codes[first[odd]] = len(words) + np.arange(len(odd))
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.fromiter(chain.from_iterable(own), dtype=np.int32)
        n = size[codes]
        stop = np.cumsum(n)
        # where each text ends among the ids, with one place for each end before it
        offsets = np.concatenate([[0], stop[first[1:] - 1] + np.arange(1, len(texts) + 1)])
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - (stop - n), n) + np.arange(int(n.sum()))]
        out = np.full(int(offsets[-1]), end, dtype=np.int32)
        kept = np.ones(len(out), dtype=bool)
        kept[offsets[1:] - 1] = False
        out[kept] = ids
        return offsets, out


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Stored rows (key, part, first, n, ids): the ids of each document and their place inside the partition that made them."""
    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encode, first, part = word_ids(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.unique([0, *np.searchsorted(ends, np.arange(CHUNK, int(ends[-1]) if len(ends) else 0, CHUNK)), batch.num_rows])
            for at, to in zip(cuts.tolist(), cuts[1:].tolist()):
                offsets, ids = encode.many(texts.slice(at, to - at), end)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [keys[at:to], pa.array(np.full(to - at, part, dtype=np.int32)), pa.array(first + offsets[:-1]), pa.array(np.diff(offsets)), lists],
                    names=["key", "part", "first", "n", "ids"])
                first += int(offsets[-1])

    rows = packed(docs.select(key, text), __text=text_of(text)).select(F.col("__row").getField(key).alias("key"), "__text")
    return stored(rows.mapInArrow(run, schema), "tokens")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    tokens = tokenized(docs, path, key, text, end)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # One small row per partition of the first pass, so the broadcast is bounded by the number of input splits.
    placed = tokens.join(F.broadcast(before), "part").select("key", (F.col("first") + F.col("before")).alias("first"), "ids")
    fields = [T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def cut(batches):
        for batch in batches:
            firsts = batch.column(1).to_numpy(zero_copy_only=False)
            where, ids = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False).astype("<u4")
            row, start, size, crc, total, sequence, offset = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                own, first = ids[where[i]:where[i + 1]], int(firsts[i])
                edges = [0, *range(length - first % length, len(own), length), len(own)]
                for a, b in zip(edges, edges[1:]):
                    row.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    total.append(len(own))
                    sequence.append((first + a) // length)
                    offset.append((first + a) % length)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, size, crc, total, sequence, offset)]]
            if with_ids:
                columns.append(pa.array([ids[where[i] + a:where[i] + a + n].astype("i4") for i, a, n in zip(row, start, size)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return placed.mapInArrow(cut, T.StructType(fields))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences (sequence_id, ids) of pieces that carry their ids; a sequence holds at most ``length`` ids."""
    own = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return own.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
