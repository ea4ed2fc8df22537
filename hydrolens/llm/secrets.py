"""Secret scan by corpus-wide ownership frequency.

Candidates are found in every text with regular expressions. Their values are hashed and counted over distinct
repositories (documents) and distinct owners (sources). A value that many owners or many repositories hold is a copied
example; a value that few repositories of few owners hold looks live. Only built-in DataFrame functions are used.

Base kinds are always reported. The kinds the method adds (``pem`` blocks, ``mixed`` high-variety strings) are reported
only when their value looks live, because a string that is widely shared is an identifier and not a credential. A ``pem``
value is the header with its body, to the footer or, in a block that is cut, to the last line of key material.

Defined cases: null text counts as empty, null owners as one more owner, repeated rows are each scanned (and count once
as a repository), an empty table gives an empty table. Input columns may have any name; results replace equal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, scan_array, stored, text_of, unpacked

# The patterns of the base kinds, then those the method adds.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Header, then all up to the next run of five hyphens if that is a footer; without one, the key material that follows.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/=]{20,}+)*+)"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"

BASE_KINDS = ("assign", "access", "hex")
METHOD_KINDS = ("pem", "mixed")
KINDS = BASE_KINDS + METHOD_KINDS

#: Cheap necessary conditions, so that most texts are not cut into pieces.
GUARD = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "pem": r"-----BEGIN ",
    "mixed": r"[A-Za-z0-9+/_=-]{20}",
}
# Runs of hex digits and of capitals are maximal, so a match that is long enough is the same with the length in the pattern.
PATTERN = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "pem": PEM, "mixed": MIXED}

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"

#: A value held by more owners than this is a copied example.
MAX_OWNERS = 2
#: So is a value held by more repositories than this, however few their owners.
MAX_REPOSITORIES = 10


def _kept(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.length(value) >= 8
    if kind == "mixed":
        return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.lit(True)


def spans_of_kind(text: Column, kind: str) -> Column:
    """Spans of one kind as (start, rank of the kind, end, value): leftmost, non-overlapping, in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so running sums of their lengths are the places.
    """
    pattern, rank = F.lit(PATTERN[kind]), KINDS.index(kind)
    value = (lambda m: F.regexp_extract(m, ASSIGN, 1)) if kind == "assign" else (lambda m: m)

    def build(both: Column) -> Column:
        lengths = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["found"])), both["found"], lambda g, m: F.length(g) + F.length(m))
        ends = scan_array(lengths, lambda a, b: a + b)
        spans = F.zip_with(ends, both["found"], lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), value(m).alias("value")))
        return F.filter(spans, lambda s: _kept(kind, s["value"]))

    pieces = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, PATTERN[kind], -1).alias("gaps"))
    return F.when(text.rlike(GUARD[kind]), let(pieces, build)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind; strings of the kind ``mixed`` that touch a base span or lie in a ``pem`` block are left out."""
    base = F.flatten(F.array(*[spans_of_kind(text, k) for k in BASE_KINDS]))
    more, pem = spans_of_kind(text, "mixed"), spans_of_kind(text, "pem")
    return let(F.struct(base.alias("base"), more.alias("more"), pem.alias("pem")), lambda x: F.array_sort(F.concat(
        x["base"], x["pem"], F.filter(x["more"], lambda m: ~F.exists(x["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
                                      & ~F.exists(x["pem"], lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", carry: list[str] | None = None, max_owners: int = MAX_OWNERS,
                 max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per input row: the carried input columns, counts of base kinds, the spans, and the ownership verdicts.

    ``secret_spans`` is an array of (start, rank, end, value, owners, repositories, live), base spans first to last and the
    live spans of the added kinds. ``carry`` names the input columns to keep (all by default).
    """
    rows = docs if carry is None else docs.select(*carry)
    scanned = stored(
        packed(docs, __text=text_of(text), __repository=F.col(repository).cast("string"), __owner=F.col(owner).cast("string"))
        .select(F.struct(*[F.col("__row").getField(c).alias(c) for c in rows.columns]).alias("__row"), "__repository", "__owner",
                candidates(F.col("__text")).alias("__found"))
        .withColumn("__id", F.monotonically_increasing_id()),
        "secrets-scan",
    )
    held = scanned.where(F.size("__found") > 0).select(
        "__id", "__repository", "__owner", F.explode("__found").alias("__span")
    ).withColumn("__hash", F.sha2(F.when(F.col("__span")["rank"] == KINDS.index("pem"), F.regexp_replace(F.col("__span")["value"], r"\s+", ""))
                                  .otherwise(F.col("__span")["value"]), 256))  # line breaks and indents are no part of a key
    counts = stored(
        held.groupBy("__hash", "__owner", "__repository").agg(F.lit(1).alias("one"))
        .groupBy("__hash", "__owner").agg(F.count("one").alias("n"))
        .groupBy("__hash").agg(F.count("n").alias("__owners"), F.sum("n").alias("__repositories")),
        "secrets-owners",
    )
    judged = held.join(counts, "__hash").select("__id", F.struct(
        F.col("__span")["start"].alias("start"), F.col("__span")["rank"].alias("rank"), F.col("__span")["end"].alias("end"),
        F.col("__span")["value"].alias("value"), F.col("__owners").alias("owners"), F.col("__repositories").alias("repositories"),
        ((F.col("__owners") <= max_owners) & (F.col("__repositories") <= max_repositories)).alias("live"),
    ).alias("s")).groupBy("__id").agg(F.array_sort(F.collect_list("s")).alias("__spans"))
    empty = F.array().cast(judged.schema["__spans"].dataType)
    spans = F.filter(F.coalesce(F.col("__spans"), empty), lambda s: (s["rank"] < len(BASE_KINDS)) | s["live"])
    base = F.filter(F.col("secret_spans"), lambda s: s["rank"] < len(BASE_KINDS))
    out = scanned.join(judged, "__id", "left").withColumn("secret_spans", spans)
    counted = {f"n_{k}": F.size(F.filter(F.col("secret_spans"), (lambda i: lambda s: s["rank"] == i)(i))).cast("long") for i, k in enumerate(BASE_KINDS)}
    out = out.withColumns(counted | {
        "base_spans": _joined(base), "spans": _joined(F.col("secret_spans")),
        "n_live": F.size(F.filter(F.col("secret_spans"), lambda s: s["live"])).cast("long"),
        "n_example": F.size(F.filter(F.col("secret_spans"), lambda s: ~s["live"])).cast("long"),
    })
    return unpacked(out, *counted, "base_spans", "spans", "n_live", "n_example", "secret_spans")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap become one."""
    ends = scan_array(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def build(x: Column) -> Column:
        # A span that starts after all earlier ends opens a block; a block ends where the next one opens.
        opens = F.filter(F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))),
                         lambda o: (o["i"] == 0) | (o["start"] > F.get(x["ends"], o["i"] - 1)))
        blocks = let(opens, lambda o: F.transform(o, lambda s, i: F.struct(
            s["start"].alias("start"),
            F.get(x["ends"], F.coalesce(F.get(o, i + 1)["i"], F.size(x["ends"])) - 1).alias("end"),
            F.coalesce(F.get(x["ends"], s["i"] - 1), F.lit(0)).alias("after"))))
        return let(blocks, lambda b: F.concat(
            F.array_join(F.transform(b, lambda s: F.concat(F.substring(x["text"], s["after"] + 1, s["start"] - s["after"]), F.lit(mark))), ""),
            F.substring(x["text"], F.element_at(b, -1)["end"] + 1, F.lit(2147483647))))

    whole = F.struct(text.alias("text"), spans.alias("spans"), ends.alias("ends"))
    return F.when(F.size(spans) > 0, let(whole, build)).otherwise(text)
