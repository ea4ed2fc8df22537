"""Licences in wrapped notices, short references, several in one line, and lines that the gate must not lose."""

import random
import re


def test_paragraphs(spark, docs):
    from hydrolens.llm.licenses import scan_licenses

    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the\nGNU General Public\nLicense as published by the Free Software Foundation."
    filler = " ".join(f"word{i}" for i in range(300))
    texts = {
        30: ("Intro line.\n\n" + gpl + "\n\nmore", "gpl"),
        31: ("# you can redistribute it and/or\n# modify it under the terms of the GNU\n# General Public\n# License\n#\n# code", "gpl"),
        32: ("SPDX: GPL-3.0-only", "gpl"), 33: ("Distributed under the GPL, version 3.", "gpl"), 34: ("Code is Apache-2.0, text is CC BY-SA 4.0", "apache,cc"),
        35: ("BSD 3-Clause", "bsd"), 36: (filler + " " + gpl.replace("\n", " ") + " " + filler, "gpl"), 37: ("my fishing license is old\nand the river runs", ""),
        38: ("er kam mit dem Zug und ging", ""),
    }
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([(k, t, "a", 1, "") for k, (t, _) in texts.items()], docs.schema)).collect()}
    assert {k: r["families"] for k, r in got.items()} == {k: f for k, (_, f) in texts.items()}
    assert got[37]["n_unknown"] == 1 and got[38]["n_unknown"] == 0 and got[31]["n_unknown"] == 0


def test_gate():
    """Any paragraph with enough of a template, or with a reference, holds a word of the gate."""
    from hydrolens.llm.licenses import CONFIRM, REFERENCES, TEMPLATES, _needed

    rng, needed = random.Random(10), set(_needed())
    for t in (t for ts in TEMPLATES.values() for t in ts):
        w = sorted(set(re.findall(r"[^\W_]+", t.lower())))
        for _ in range(300):
            some = rng.sample(w, next(k for k in range(len(w) + 1) if k / len(w) >= CONFIRM))
            assert needed & set(some)
    assert all(needed & set(r.split()) for rs in REFERENCES.values() for r in rs)
