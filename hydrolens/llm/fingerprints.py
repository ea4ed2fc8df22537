"""Document fingerprints by Order MinHash, with DataFrame functions only.

The units of a text are its words, cut every ``UNIT`` characters where they are longer. Its k-mers are runs of ``K`` units, each
numbered by how often it has occurred before, so repeats count. Numbered k-mers are hashed into ``BINS`` bins, and the
minimum of each bin is selected. The selected k-mers of neighbouring bins keep their order in the text, and the ordered tuple
is hashed to one component. Moving text around changes the order and so the components, unlike with plain MinHash: agreement
follows the edit distance.

Defined cases: null text counts as empty; a text without units has the empty fingerprint, and two of these are alike (1.0); a text
of fewer than ``K`` units is one k-mer; repeated rows have equal fingerprints. In the order of keys null keys come last, equal keys are
ordered by text, and the document after the last one is the first. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, packed, scan_array, stored, text_of, unpacked

UNIT, K = 12, 3
#: 2**6 bins in pairs; bits of a hash and of a place in a packed value.
BIN_BITS, HASH_BITS, PLACE_BITS = 6, 39, 24
_HASH, _PLACE = (1 << HASH_BITS) - 1, (1 << PLACE_BITS) - 1


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(h.bitwiseAND(F.lit(_HASH)), PLACE_BITS).bitwiseOR(place.bitwiseAND(F.lit(_PLACE)))


def _hash(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _kmers(units: Column) -> Column:
    """Sorted packed (hash, place) of all k-mers."""
    starts = F.slice(units, F.lit(1), F.greatest(F.size(units) - (K - 1), F.least(F.size(units), F.lit(1))))
    return F.sort_array(F.transform(starts, lambda u, i: _pack(F.xxhash64(u, *[F.get(units, i + j) for j in range(1, K)]), i.cast("long"))))


def _numbered(kmers: Column) -> Column:
    """Sorted packed (hash of k-mer and occurrence number, place).

    In sorted order the occurrences of a k-mer stand together in text order. Only the later ones need a number other than 0;
    it is their distance from the start of their run, found with a running maximum over these few.
    """
    again = F.filter(F.transform(kmers, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                     lambda s: (s["i"] > 0) & (_hash(s["x"]) == _hash(F.get(kmers, s["i"] - 1))))

    def count(r: Column) -> Column:
        opens = F.transform(r, lambda s, j: F.when((j == 0) | (_hash(F.get(r, j - 1)["x"]) != _hash(s["x"])), j).otherwise(F.lit(0)))
        return F.zip_with(r, F.transform(scan_array(opens, lambda a, b: F.greatest(a, b)), lambda o, j: j - o + 1),
                          lambda s, n: _pack(F.xxhash64(_hash(s["x"]), n), s["x"]))

    once = F.transform(F.filter(kmers, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(kmers, i - 1)))), lambda x: _pack(F.xxhash64(_hash(x), F.lit(0)), x))
    return F.sort_array(F.concat(once, let(again, count)))


def _tuples(numbered: Column) -> Column:
    """One packed (component, hash) for each pair of bins that holds a k-mer."""
    shift = HASH_BITS + PLACE_BITS - BIN_BITS
    low = F.filter(numbered, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(numbered, i - 1), shift)))
    part = lambda x: F.shiftright(x, shift + 1)

    def join(m: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            y = F.get(m, i + 1)
            place = lambda v: v.bitwiseAND(F.lit(_PLACE))
            h = F.when(y.isNull() | (part(y) != part(x)), F.xxhash64(_hash(x))).when(
                place(x) <= place(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
            first = (i == 0) | (part(F.get(m, i - 1)) != part(x))
            return F.when(first, F.shiftleft(part(x), 32).bitwiseOR(h.bitwiseAND(F.lit(0xFFFFFFFF))))

        return F.filter(F.transform(m, one), lambda x: x.isNotNull())

    return let(low, join)


def signature(text: Column) -> Column:
    """Array of packed components of a text."""
    units = F.regexp_extract_all(text, F.lit(rf"\S{{1,{UNIT}}}"), F.lit(0))
    return let(let(let(units, _kmers), _numbered), _tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that either fingerprint has."""
    parts = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 32))))
    return F.when(parts == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / parts)


def shown(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.hex(x))), ".")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, text, signature, text and signature of the next document): keys are cut into ranges of about equal size, and the first
    row of each range also stands at the end of the range before it, so no task sees the whole order."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(F.col(key).alias("k")).where("k is not null").repartitionByRange(ranges, "k").withColumn("p", F.spark_partition_id())
    # One key for each range; the ranges are stored first, for a plan that only groups them would not make them.
    bounds = sorted({r["low"] for r in stored(keys, "key-ranges").groupBy("p").agg(F.min("k").alias("low")).collect()})
    edge = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")
    own = F.when(F.col("__key").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(edge, lambda b: b <= F.col("__key"))))
    before = F.when(F.col("__key") == bounds[0], F.lit(len(bounds))).otherwise(F.col("__range") - 1) if bounds else F.lit(None)
    places = F.when(F.array_contains(edge, F.col("__key")), F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")), F.struct(before.cast("int").alias("r"), F.lit(1).alias("g")))) if bounds else F.lit(None)
    rows = packed(docs, __key=F.col(key), __text=text_of(text)).withColumn("__range", own)
    rows = rows.withColumn("__sig", signature(F.col("__text")))
    rows = rows.withColumn("__at", F.explode(F.coalesce(places, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g"))))))
    order = Window.partitionBy("__at.r").orderBy("__at.g", F.col("__key").asc_nulls_last(), F.xxhash64("__text"), "__text")
    every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(every))
    return rows.withColumns({"__next": after("__text"), "__next_sig": after("__sig")}).where("__at.g = 0")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of a text (rounded down) replaced by as many first characters of the following one."""
    q = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - q), F.substring(following, F.lit(1), q))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its fingerprint, the fingerprint of its edited text and the likeness to that and to the next document's."""
    rows = with_next(docs, key, text).withColumn("edited_text", edited(F.col("__text"), F.col("__next")))
    rows = rows.withColumn("__edited", signature(F.col("edited_text")))
    results = {
        "n_chars": F.length("__text").cast("long"), "edited_text": F.col("edited_text"), "fingerprint": shown(F.col("__sig")), "edited_fingerprint": shown(F.col("__edited")),
        "near_edited": likeness(F.col("__sig"), F.col("__edited")), "near_next": likeness(F.col("__sig"), F.col("__next_sig")),
    }
    return unpacked(rows.select("__row", *[c.alias(n) for n, c in results.items()]), *results)
