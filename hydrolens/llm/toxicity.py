"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (with the marks < and > at its ends), a text the mean of its
words, and a two-class linear softmax reads that mean. Embeddings and softmax are trained together, so a misspelling that was
never seen shares the vectors of its n-grams. The trained model is linear in the n-grams, so scoring needs one number per bucket.

Training uses a bounded sample of the distinct labelled texts, ``SAMPLE`` of each class, in one task; a fifth of
the sample calibrates the cut, weighted by the class shares of all labelled rows. Every text is scored whole.
Copies of a whole text with the same label teach once; texts that only share an opening all teach.

Defined cases: null or empty text has the score of no words (the intercept); rows with a null key or label teach nothing;
conflicting labels of one key count as toxic; of repeated keys one text teaches, and each row is scored; without labels of both classes the
score is the share of the class there is, or 0 without labels; an empty table gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked
from .substrings import mixed

#: Distinct labelled texts of each class that the model is fitted on.
SAMPLE = 2000
BITS, DIM, EPOCHS, RARE, SCALE = 16, 3, 40, 5, 20.0
#: Slope of the reported score around its cut.
STEEP = 4.0
#: The first rate of the embeddings, the loss at which the fit ends early, and the z score that counts.
RATE, STOP, SURE = 0.001, 0.02, 3.0
GRAMS = (3, 5)
EDGES = ".,;:!?\"'()[]{}<>*_-…»«“”„"
#: Words of texts that are looked up together.
TOGETHER = 1 << 19
_LETTER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, and the number of the word that each belongs to."""
    marked = [f"<{w.strip(EDGES).lower()}>" for w in words]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(size)
    # Roots of the characters; those of n + 1 follow from those of n.
    codes = mixed(np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + _LETTER)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - np.repeat(ends - size, size)
    odd = np.cumprod(np.full(int(size.max(initial=1)), _LETTER, dtype=np.uint64))
    grams, of = [mixed(np.add.reduceat(codes * odd[place], ends - size))] if len(words) else [codes], [np.arange(len(words))]
    rolled = codes
    for n in range(2, GRAMS[1] + 1):
        rolled = mixed(rolled[:len(codes) - n + 1] * _LETTER + codes[n - 1:]) if len(codes) >= n else rolled[:0]
        if n >= GRAMS[0]:
            whole = np.flatnonzero(place[:len(rolled)] + n <= size[word[:len(rolled)]])
            grams.append(rolled[whole] + np.uint64(n))
            of.append(word[whole])
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(of)


def _sums(values: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(to, values[:, j], size) for j in range(values.shape[1])], axis=1)


def fit(texts: list[str], labels: list[int]) -> np.ndarray:
    """Weights per bucket and, last, the intercept, from full-batch descent on embeddings and softmax together."""
    number, doc, word, share = {}, [], [], []
    for i, text in enumerate(texts):
        counts: dict[str, int] = {}
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
        total = max(sum(counts.values()), 1)
        for w, n in counts.items():
            doc.append(i)
            word.append(number.setdefault(w, len(number)))
            share.append(n / total)
    doc, word, share = np.array(doc, dtype=np.int64), np.array(word, dtype=np.int64), np.array(share)
    gram, of = buckets(list(number))
    by = np.argsort(of, kind="stable")
    gram, of = gram[by], of[by]
    sizes = np.bincount(of, minlength=len(number))
    part = np.repeat(1 / np.maximum(sizes, 1), sizes)
    # n-grams of fewer than RARE (text, word) pairs keep the weight zero: they would only fit noise.
    seen = np.bincount(word, minlength=len(sizes))
    keep = np.bincount(gram, seen[of], 1 << BITS)[gram] >= RARE
    used, gram = np.unique(gram[keep], return_inverse=True)
    of, part = of[keep], part[keep]
    y = np.array(labels, dtype=float)
    gain = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))[:, None]
    target = np.stack([1 - y, y], axis=1)
    # The first embedding axis starts at the log odds of n-grams whose class share is no accident; the rest starts near zero.
    # Counted over texts: inside a text the n-grams of a style come in clusters.
    first = np.searchsorted(of, np.arange(len(sizes) + 1))
    own = np.searchsorted(doc, np.arange(len(y) + 1))
    seen_toxic, seen_all = np.zeros(len(used)), np.zeros(len(used))
    for i in range(len(y)):
        held = word[own[i]:own[i + 1]]
        here = np.unique(np.concatenate([gram[first[k]:first[k + 1]] for k in held] or [gram[:0]]))
        seen_all[here] += 1
        seen_toxic[here] += y[i]
    usual = min(max(y.mean(), 1e-6), 1 - 1e-6)
    sure = (seen_toxic - seen_all * usual) / np.sqrt(seen_all * usual * (1 - usual) + 1e-9)
    odds = np.log((seen_toxic + 0.5) / (seen_all * usual + 0.5)) * np.clip(np.abs(sure) / SURE - 1, 0, 1)
    rng = np.random.default_rng(7)
    e, w, c = rng.normal(0, 0.01, (len(used), DIM)), rng.normal(0, 0.01, (DIM, 2)), np.zeros(2)
    e[:, 0] += odds
    w[0] += (-1, 1)
    # Each n-gram steps in inverse proportion to its second moment, so that rare and common ones are learnt alike.
    moment = np.bincount(gram, (np.bincount(word, share**2, len(sizes))[of] * part**2), len(used)) / len(y)
    step = (1 / (moment + np.quantile(moment, 0.9)))[:, None] / SCALE**2
    rate, before, kept, slopes = RATE, np.inf, None, None
    for _ in range(EPOCHS):
        words = _sums(e[gram] * part[:, None], of, len(sizes))
        means = _sums(words[word] * share[:, None], doc, len(y)) * SCALE
        z = means @ w + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        loss = -(gain[:, 0] * np.log((p * target).sum(axis=1) + 1e-12)).sum()
        if loss > before:
            rate /= 4
            e, w, c = kept
        else:
            before, kept = loss, (e, w, c)
            d = (p - target) * gain
            back = _sums((d @ w.T * SCALE)[doc] * share[:, None], word, len(sizes))
            slopes = (_sums(back[of] * part[:, None], gram, len(used)) * step, means.T @ d, d.sum(axis=0))
            rate *= 1.3
        e, w, c = e - rate * slopes[0], w - 300 * rate * slopes[1], c - 1000 * rate * slopes[2]
        if before < STOP:
            break
    e, w, c = kept
    weights = np.zeros((1 << BITS) + 1)
    weights[used] = e @ (w[:, 1] - w[:, 0]) * SCALE
    weights[-1] = c[1] - c[0]
    return weights


def totals(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the words of each text; a word counts as the mean of its n-grams. Distinct words are looked up once for many texts."""
    out, at = np.zeros(len(texts)), 0
    while at < len(texts):
        words, sizes = [], []
        while at + len(sizes) < len(texts) and (not sizes or len(words) < TOGETHER):
            own = texts[at + len(sizes)].split()
            words += own
            sizes.append(len(own))
        if words:
            of, distinct = pd.factorize(np.array(words, dtype=object))
            gram, owner = buckets(distinct.tolist())
            value = np.bincount(owner, weights[gram], len(distinct)) / np.bincount(owner, minlength=len(distinct))
            text = np.repeat(np.arange(len(sizes)), sizes)
            out[at:at + len(sizes)] = np.bincount(text, value[of], len(sizes)) / np.maximum(sizes, 1)
        at += len(sizes)
    return out


def calibrated(texts: list[str], labels: list[int], toxic_share: float) -> np.ndarray:
    """``fit`` on four fifths of the texts; on the rest, the cut with the least expected error at the true share of toxic rows becomes score 0.5."""
    own = [i for i in range(len(texts)) if i % 5]
    weights = fit([texts[i] for i in own], [labels[i] for i in own])
    z = totals(texts[::5], weights)
    y = np.array([labels[i] for i in range(0, len(texts), 5)])
    if len(z) == 0 or y.min() == y.max():
        weights[-1] += np.log(toxic_share / (1 - toxic_share))
        return weights
    by = np.argsort(z, kind="stable")
    z, y = z[by], y[by]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum() * toxic_share
    alarms = ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])) / (y == 0).sum() * (1 - toxic_share)
    cut = int(np.argmin(missed + alarms))
    low, high = z[max(cut - 1, 0)], z[min(cut, len(z) - 1)]
    weights[-1] = -(low + high) / 2
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` distinct labelled texts of each class, chosen by the hash of the text."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    shares = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    toxic, clean = shares.get(1, 0), shares.get(0, 0)
    if not toxic or not clean:
        return Model(np.zeros(1 << BITS), -40.0 if not toxic else 40.0)
    # One text of each key, then one key of each text and label: only keys and hashes are shuffled, however often either is repeated.
    hashed = docs.select(F.col(key).alias("__key"), F.sha2(text_of(text), 256).alias("__hash")).join(known, "__key")
    distinct = stored(hashed.groupBy("__key").agg(F.min("__hash").alias("__hash"), F.first("__label").alias("__label"))
                      .groupBy("__label", "__hash").agg(F.min("__key").alias("__key")), "toxicity-texts")
    chosen = [distinct.where(F.col("__label") == v).orderBy("__hash").limit(sample) for v in (0, 1)]
    # At most 2 * sample keys, so the broadcast is bounded; the task that fits gets one text of each.
    rows = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")).join(F.broadcast(chosen[0].union(chosen[1])), "__key")
    rows = rows.where(F.sha2("__text", 256) == F.col("__hash")).groupBy("__key", "__label").agg(F.min("__text").alias("__text"))

    share = toxic / (toxic + clean)

    def one(frames):
        all_rows = pd.concat(list(frames))
        all_rows = all_rows.sort_values(["__label", "__key", "__text"])
        yield pd.DataFrame({"w": [calibrated(all_rows["__text"].tolist(), all_rows["__label"].tolist(), share).astype("<f8").tobytes()], "n": [len(all_rows)]})

    got = rows.select("__key", "__text", "__label").repartition(1).mapInPandas(one, "w binary, n long").collect()
    weights = np.frombuffer(got[0]["w"], dtype="<f8")
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score`` and ``predicted``."""
    weights, intercept = model.weights, model.intercept

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        z = STEEP * (totals(texts.tolist(), weights) + intercept)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    out = packed(docs, __text=text_of(text)).withColumn("score", scores("__text"))
    return unpacked(out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "score", "predicted")
