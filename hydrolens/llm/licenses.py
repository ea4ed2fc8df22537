"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

Only DataFrame functions and Spark ML are used. A paragraph is a line, and also a block between blank lines with its wrapped lines joined
(in overlapping windows of ``WINDOW`` words, so that long blocks are covered too). Its features are hashed words and word pairs; a multinomial
logistic regression with an L1 penalty keeps few of them. Training lines come from the templates (whole, cut, and with words left out), the
references by name and, as the class ``unknown``, from lines by which licences of no known family are declared and from bounded samples of corpus
lines: some that pass the gate of the scan and match nothing, and some that name no licence. A family is predicted where it beats
``unknown`` by the bar, which is the probability that all but ``ALLOWED`` of the held-out unknown lines stay below; so a paragraph may have several.
A predicted family is confirmed by enough of the words of a template, among them half of those that no other family's templates
have, or by a reference. Only paragraphs with a word of ``GATE`` are scored; it is built from the templates and references, of each the words
that are no common ones first, so that no other paragraph can confirm any.

Defined cases: null text counts as empty and has no licence; repeated rows are each scanned; a text may hold several families; an empty table
gives an empty table (the model is then trained on the templates alone).
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, stored, text_of, unpacked

# The opening or reference lines by which each family is declared.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License"],
    "cc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Released under the Mozilla Public License"],
}
#: Short references by name, as lower-case words that follow each other.
REFERENCES = {
    "apache": ["apache 2 0", "apache license", "apache licence"],
    "bsd": ["bsd 3 clause", "bsd 2 clause", "bsd license", "bsd licence"],
    "cc": ["cc by", "creative commons attribution", "cc0 1 0"],
    "gpl": ["gpl 3 0", "gpl 2 0", "gpl version 3", "gpl version 2", "gpl v3", "gpl v2", "gplv3", "gplv2", "gnu gpl", "gnu general public license"],
    "mit": ["mit license", "mit licence", "identifier mit", "spdx mit"],
    "mpl": ["mpl 2 0", "mozilla public license"],
}
FAMILIES = tuple(sorted(TEMPLATES))
UNKNOWN = len(FAMILIES)
ENTRIES = "array<struct<family:string,probability:double,line:string,confirmed:boolean>>"
#: Names of licences of no known family; taught as unknown in the forms of the references.
OTHERS = (
    "ISC License", "Boost Software License", "Artistic License 2.0", "Eclipse Public License 2.0", "GNU Lesser General Public License", "GNU Affero General Public License",
    "LGPL 3.0", "AGPL 3.0", "LGPL-2.1", "Unlicense", "zlib License", "European Union Public Licence", "Python Software Foundation License", "PostgreSQL License",
    "Common Development and Distribution License", "Microsoft Public License", "SIL Open Font License", "Open Software License 3.0", "house license", "proprietary license of the owner",
)
FORMS = ("%s", "SPDX: %s-only", "%s-or-later", "Released under %s", "Released under the %s.", "Distributed under the %s", "SPDX-License-Identifier: %s", "Code is %s", "Licensed under the %s", "This file is under the %s, see the file for details")
#: Buckets of n-grams, background lines of each of the two training samples, share of template words that confirms, and of held-out unknown lines that may pass.
BUCKETS, BACKGROUND, CONFIRM, ALLOWED = 1024, 1500, 0.7, 0.01
#: Words of any prose; the gate takes them last.
COMMON = frozenset("a an and any are be by for free in is it may not of or person public subject terms the this to under use with without work you".split())
#: Words of a window of a long block, and the step between windows; no template is longer than the overlap.
WINDOW, STEP = 60, 30
#: A line speaks of a licence if it holds one of these.
GUARD = r"(?i)licen[sc]|redistribut|permission|copyright|creative commons|mozilla|gnu general"


def _needed() -> list[str]:
    """Words without all of which no template reaches ``CONFIRM`` and no reference is held: of each the least common, longest words, just enough of them."""
    out = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        w = sorted(set(re.findall(r"[^\W_]+", t.lower())), key=lambda x: (x in COMMON, -len(x), x))
        out.update(w[:next(k for k in range(1, len(w) + 1) if (len(w) - k) / len(w) < CONFIRM)])
    return sorted(out | {max(r.split(), key=len) for rs in REFERENCES.values() for r in rs})


GATE = GUARD + r"|(?u:(?<![\p{L}\p{N}])(?:" + "|".join(_needed()) + r")(?![\p{L}\p{N}]))"


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def features(line: Column) -> Column:
    """Distinct buckets of the words and word pairs of a line."""
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return let(words(line), lambda w: F.array_distinct(F.concat(
        F.transform(w, lambda x: bucket(x)),
        F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: bucket(x, F.get(w, i + 1))))))


def _telling(family: str, template: str) -> list[str]:
    """The words of a template that no other family's templates have."""
    found = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    return sorted(found(template).difference(*(found(t) for f, ts in TEMPLATES.items() if f != family for t in ts)))


def held(w: Column) -> Column:
    """For each family, whether a paragraph of the words ``w`` holds enough of a template, with half of its telling words, or a reference."""
    joined = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    def own(f: str) -> Column:
        def enough(t: str) -> Column:
            telling = F.array(*map(F.lit, _telling(f, t)))
            share = F.size(F.array_intersect(words(F.lit(t)), w)) / F.size(F.array_distinct(words(F.lit(t))))
            return (share >= CONFIRM) & (2 * F.size(F.array_intersect(telling, w)) >= F.size(telling))

        return reduce(Column.__or__, map(enough, TEMPLATES[f])) | F.exists(F.array(*[F.lit(f" {r} ") for r in REFERENCES[f]]), lambda r: F.contains(joined, r))

    return F.array(*[own(f) for f in FAMILIES])


def _training(spark, docs: DataFrame, text: str, background: int = BACKGROUND) -> DataFrame:
    """Rows (line, label, hard): template lines with cuts and gaps, references, and background lines; ``hard`` ones pass the gate."""
    known = spark.createDataFrame([(t, FAMILIES.index(f)) for f, ts in TEMPLATES.items() for t in ts], "line string, label int")
    varied = known.select("label", F.split("line", " ").alias("w")).select("label", F.explode(F.concat(
        F.array("w"), F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.filter("w", lambda x, i: F.pmod(F.xxhash64(i, k), F.lit(6)) > 0)))).alias("w")).select(F.array_join("w", " ").alias("line"), "label")
    named = spark.createDataFrame([(form % r, FAMILIES.index(f)) for f, rs in REFERENCES.items() for r in rs for form in FORMS], "line string, label int")
    other = spark.createDataFrame([(form % name, UNKNOWN) for name in OTHERS for form in FORMS], "line string, label int").withColumn("hard", F.lit(False))
    # Bounded samples of background lines, taken by hash so that every part of the corpus can give some.
    lines = docs.select(F.explode(F.split(text_of(text), r"\n")).alias("line")).where(F.length("line") > 20)
    easy = lines.where(~F.col("line").rlike(GATE)).orderBy(F.xxhash64("line"), "line").limit(background)
    # Distinct, so that a common line takes one place.
    hard = lines.where(F.col("line").rlike(GATE)).where(~F.exists(held(words(F.col("line"))), lambda x: x)).distinct().orderBy(F.xxhash64("line"), "line").limit(background)
    odd = spark.createDataFrame([(x, UNKNOWN) for x in (
        "driving license renewal", "permission to enter the building", "all copyright questions go to the office", "the version of the file is old", "a license plate",
        "public works are under way", "general terms of use", "released in version 2.0", "the source code form", "free of charge for any person")], "line string, label int")
    taught = varied.unionByName(named).unionByName(easy.withColumn("label", F.lit(UNKNOWN))).unionByName(odd).withColumn("hard", F.lit(False))
    return taught.unionByName(other).unionByName(hard.select("line", F.lit(UNKNOWN).alias("label"), F.lit(True).alias("hard")))


def train(docs: DataFrame, text: str = "text", background: int = BACKGROUND):
    """(coefficients by class and bucket, intercepts, bar); at most ``background`` corpus lines of each of two kinds teach."""
    # Stored, because the fit reads its rows many times and each reading would scan the corpus again.
    rows = stored(_training(docs.sparkSession, docs, text, background).withColumn("b", features(F.col("line"))), "license-training")
    dense = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.array_contains("b", k).cast("double")))
    rows = rows.select(dense.alias("features"), F.col("label").cast("double").alias("label"), "hard", (F.pmod(F.xxhash64("line"), F.lit(4)) == 0).alias("aside"))
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=1.0, maxIter=60, standardization=False).fit(rows.where("not aside"))
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = model.transform(rows.where((F.col("label") == UNKNOWN) & F.col("aside")))
    from pyspark.ml.functions import vector_to_array

    z = vector_to_array("rawPrediction")
    best = F.array_max(F.slice(z, 1, UNKNOWN)) - F.get(z, F.lit(UNKNOWN))
    bar = scored.select(best.alias("z")).agg(F.percentile("z", F.lit(1 - ALLOWED))).first()[0]
    return coefficients, intercepts, 1 / (1 + math.exp(-(bar or 0.0)))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``licenses`` (family, its probability against unknown, line, confirmed), ``families`` (confirmed, sorted, comma-joined) and ``n_unknown``,
    the lines that speak of a licence or are accepted by the model but belong to no family."""
    coefficients, intercepts, bar = train(docs, text)
    used = [int(k) for k in range(BUCKETS) if abs(coefficients[:, k]).max() > 0]
    place = {k: i for i, k in enumerate(used)}
    slot = F.array(*[F.lit(place.get(k, -1)) for k in range(BUCKETS)])
    weight = [F.array(*[F.lit(float(coefficients[c, k])) for k in used]) for c in range(UNKNOWN + 1)]
    names, numbers = F.array(*[F.lit(f) for f in FAMILIES]), F.array(*[F.lit(i) for i in range(UNKNOWN)])
    spoken = F.array(*[words(F.lit(" ".join(TEMPLATES[f] + REFERENCES[f]))) for f in FAMILIES])

    def judged(line: Column) -> Column:
        """Entries of one paragraph: one for each confirmed family, or one unconfirmed, or none if it says nothing of a licence."""
        def of(own: Column) -> Column:
            z = F.array(*[F.aggregate(own, F.lit(float(intercepts[c])), (lambda c: lambda a, s: a + F.get(weight[c], s))(c)) for c in range(UNKNOWN + 1)])

            def pick(zs: Column) -> Column:
                e = F.transform(zs, lambda x: F.exp(x - F.array_max(zs)))
                total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
                first = F.array_position(zs, F.array_max(F.slice(zs, 1, UNKNOWN))).cast("int") - 1
                # Each family against unknown alone, so that two families of one line do not weaken each other.
                each = F.transform(F.slice(zs, 1, UNKNOWN), lambda x: 1 / (1 + F.exp(F.get(zs, F.lit(UNKNOWN)) - x)))
                return F.struct(first.alias("c"), (1 - F.get(e, F.lit(UNKNOWN)) / total).alias("p"), each.alias("each"))

            return let(z, pick)

        def entry(family: Column, p: Column, confirmed: bool) -> Column:
            return F.struct(family.alias("family"), p.alias("probability"), line.alias("line"), F.lit(confirmed).alias("confirmed"))

        def entries(x: Column) -> Column:
            likely = F.exists(x["each"], lambda p: p > bar)
            sure = F.when(likely, let(words(line), lambda w: let(held(w), lambda h: F.filter(numbers, lambda i: F.get(h, i) & (F.get(x["each"], i) > bar))))).otherwise(F.array().cast("array<int>"))
            return let(sure, lambda fs: F.when(F.size(fs) > 0, F.transform(fs, lambda i: entry(F.get(names, i), F.get(x["each"], i), True))).when(
                likely | line.rlike(GUARD), F.array(entry(F.get(names, x["c"]), x["p"], False))).otherwise(F.array().cast(ENTRIES)))

        own = F.filter(F.transform(features(line), lambda k: F.get(slot, k)), lambda s: s >= 0)
        return let(let(own, of), entries)

    def all_of(units: Column) -> Column:
        return F.flatten(F.transform(F.filter(units, lambda u: u.rlike(GATE)), judged))

    def windows(block: Column) -> Column:
        """The words of a block in overlapping windows; none for a single line that fits into one, which is judged as a line."""
        def cut(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(STEP), F.lit(1)), F.lit(STEP))
            return F.transform(starts, lambda s: F.array_join(F.slice(w, s, F.lit(WINDOW)), " "))

        return let(F.split(block, r"\s+"), lambda w: F.when((F.size(w) > WINDOW) | block.contains("\n"), cut(w)).otherwise(F.array().cast("array<string>")))

    def merged(x: Column) -> Column:
        """The entries of the lines; those of windows where they confirm a family that no line does, in place of the lines they join."""
        sure = F.transform(F.filter(x["lines"], lambda e: e["confirmed"]), lambda e: e["family"])
        more = let(sure, lambda fs: F.filter(x["windows"], lambda e: e["confirmed"] & ~F.array_contains(fs, e["family"])))
        first = let(more, lambda m: F.filter(m, lambda e, i: F.array_position(F.transform(m, lambda o: o["family"]), e["family"]) == i + 1))
        # A line that is half words of a family's templates is part of the notice that was wrapped.
        part = lambda e, f: let(F.array_distinct(words(e["line"])), lambda w: 2 * F.size(F.array_intersect(w, F.get(spoken, F.array_position(names, f).cast("int") - 1))) >= F.size(w))
        return let(first, lambda m: F.concat(F.filter(x["lines"], lambda e: e["confirmed"] | ~F.exists(m, lambda o: part(e, o["family"]))), m))

    def of_block(block: Column) -> Column:
        return let(F.struct(all_of(F.split(block, r"\n")).alias("lines"), all_of(windows(block)).alias("windows")), merged)

    # Blocks are parted by lines without letters and digits.
    blocks = F.filter(F.split(text_of(text), r"\n(?:[^\p{L}\p{N}\n]*+\n)++"), lambda b: b.rlike(GATE))
    out = packed(docs, __blocks=blocks).withColumn("licenses", F.flatten(F.transform("__blocks", of_block)))
    out = out.withColumns({
        "families": F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["family"]))), ","),
        "n_unknown": F.size(F.filter("licenses", lambda x: ~x["confirmed"])).cast("long")})
    return unpacked(out, "licenses", "families", "n_unknown")
