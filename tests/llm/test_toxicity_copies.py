"""Every distinct labelled text teaches, also when many share their first words."""

import random


def test_shared_opening(spark, docs):
    from hydrolens.llm.toxicity import score, train

    rng = random.Random(8)
    opening = "this page is part of a large archive\n"
    made = [(i, opening + " ".join(rng.choices(["river", "stone", "cloud", "field", "house", "green", "water"], k=30) + (["horridword", "vileterm"] if i % 4 == 0 else [])), "s", 0, "") for i in range(1000, 1240)]
    rows = spark.createDataFrame(made, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000, 1200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in score(rows, train(rows, labels)).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(1200, 1240))


def test_copies_do_not_fill_the_sample(spark, docs):
    """Copies of one text take one place of the bounded sample, so the other texts still teach."""
    from hydrolens.llm.toxicity import score, train

    rng = random.Random(9)
    own = lambda toxic: " ".join(rng.choices(["river", "stone", "cloud", "field", "house"], k=30) + (["horridword", "vileterm"] if toxic else []))
    made = [(i, "copied words of one text", "s", 0, "") for i in range(2000)] + [(i, own(i % 2), "s", 0, "") for i in range(2000, 2120)]
    rows = spark.createDataFrame(made, docs.schema)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(2100)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in score(rows, train(rows, labels, sample=51)).collect()}
    assert all(got[i] == i % 2 for i in range(2100, 2120))
