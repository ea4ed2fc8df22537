"""Registered queries of the text operators and, where SQL can say it, the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import secrets
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@register("op2_secret_scan")
def op2(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_live", "n_example")


@register("op8_bpe_round_trip")
def op8(spark, sf_dir):
    import public_tokenizers

    from .tokens import round_trip

    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op9_packing")
def op9(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op5_toxicity")
def op5(spark, sf_dir):
    from .toxicity import held_out, score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@register("op10_html_text")
def op10(spark, sf_dir):
    from .html import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register("op3_substring_dedup")
def op3(spark, sf_dir):
    from .substrings import dedup_substrings

    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_jaccard_join")
def op6(spark, sf_dir):
    from .jaccard import near_classes

    return near_classes(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "class_id", "n_links")


@register("op7_fingerprints")
def op7(spark, sf_dir):
    from .fingerprints import fingerprints

    out = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@register("op4_nearest_vectors")
def op4(spark, sf_dir):
    from .vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@register("op1_license_scan")
def op1(spark, sf_dir):
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "families", F.size("licenses").cast("long").alias("n_lines"), "n_unknown")


#: Unsigned crc32 of the decimal digits of a column, bit by bit.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 AS pos,
           {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY pos) AS ts, {CRC.format('c')} % 9 AS h FROM turns GROUP BY c),
rebuilt AS (
    SELECT o.c, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts
    FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5),
members AS (SELECT c, len(ts) AS total, unnest(range(len(ts) + 1)) AS depth, ts FROM rebuilt),
placed AS (SELECT c, total, depth, ts[1:depth] AS path FROM members),
nodes AS (
    SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(path[depth].text)), 0) AS size,
           coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE total = depth), '') AS ends
    FROM placed GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
above AS (SELECT path, depth, n_convs, size, n_children, unnest(range(depth + 1)) AS d FROM full_nodes),
sums AS (
    SELECT path[1:d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
    FROM above GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON n.path = s.path LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


@register("op11_prefix_trie", TRIE_SQL)
def op11(spark, sf_dir):
    from .trie import grafted, numbered, prefix_trie

    return prefix_trie(*grafted(numbered(table(spark, sf_dir, "conversations"))))


@register("op12_periodic_runs")
def op12(spark, sf_dir):
    from .periodic import collapse_runs, repeated_tail

    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = collapse_runs(docs)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
heads AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, h.component_id, e.vec_id = h.component_id AS kept
FROM embeddings e JOIN heads h ON e.vec_id = h.u LEFT JOIN degrees d ON e.vec_id = d.u
"""


@register("op13_near_vectors", NEAR_VECTORS_SQL)
def op13(spark, sf_dir):
    from .polytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select("vec_id", "n_links", "component_id", "kept")
