"""Families need a prediction and words that tell them apart; other licences are unknown."""

FOUND = {
    "Released under the BSD 3-Clause License.": "bsd", "Released under the Mozilla Public License.": "mpl", "Released under the MIT License.": "mit",
    "This file is distributed under the GPL, version 3.": "gpl", "SPDX: GPL-3.0-only": "gpl", "Code is Apache-2.0, text is CC BY-SA 4.0": "apache,cc", "SPDX-License-Identifier: MIT": "mit",
    "This work is licensed under the GNU General Public License, version 3 or later.": "gpl", "Licensed under the Apache License, Version 2.0 (the License)": "apache",
    "Released under the ISC License.": "", "Released under the Boost Software License.": "", "Released under the Artistic License 2.0.": "", "Subject to the Eclipse Public License 2.0.": "",
    "You may use it under the terms of the GNU Lesser General Public License, version 3.": "", "Covered by the GNU Affero General Public License, version 3.": "", "This is free and unencumbered software, see the Unlicense.": "",
    "The letter was written by the harbour master": "",
}


def test_families(spark, docs):
    from hydrolens.llm.licenses import scan_licenses

    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    asked = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(FOUND)], "doc_id long, text string")
    got = {r["text"]: r["families"] for r in scan_licenses(corpus.unionByName(asked)).where("doc_id < 0").collect()}
    assert got == FOUND


def test_gate_passes_no_common_prose(spark):
    """Words of any prose are not in the gate, and every line that is held passes it."""
    import re

    from hydrolens.llm.licenses import COMMON, REFERENCES, TEMPLATES, _needed

    assert not COMMON.intersection(_needed())
    for t in (t for ts in [*TEMPLATES.values(), *REFERENCES.values()] for t in ts):
        assert set(re.findall(r"[^\W_]+", t.lower())).intersection(_needed())
