"""Verdicts by repositories and owners together, and PEM blocks as wholes."""

from pyspark.sql import functions as F


def found(spark, docs, rows):
    from hydrolens.llm.secrets import find_secrets, redacted

    rows = spark.createDataFrame([(i, t, s, 0, "") for i, (t, s) in enumerate(rows)], docs.schema)
    return find_secrets(rows).withColumn("clean", redacted(F.col("text"), F.col("secret_spans"))).orderBy("doc_id").collect()


def test_hot_source(spark, docs):
    """A value in many repositories of one owner is widely copied; one in a few of them is not."""
    rows = found(spark, docs, [("use Ab3dEf6hIj9lMn2pQr5t here, password=copied123456", "hot")] * 40 + [("password=private1234", "hot")] * 2)
    assert all((r["n_live"], r["n_example"], r["clean"]) == (0, 1, "use Ab3dEf6hIj9lMn2pQr5t here, [SECRET]") for r in rows[:40])
    assert all((r["n_live"], r["n_example"]) == (1, 0) for r in rows[40:])


def test_pem_blocks(spark, docs):
    """The body is part of the value: keys of one type under many owners are each live, a copied key is an example."""
    def key(body, end="\n-----END RSA PRIVATE KEY-----"):
        return "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + body + end

    own = [(f"a {key('GHIJK'[i] * 64 + chr(10) + 'k/+=')} b", f"s{i}") for i in range(5)]
    copied = [(f"a {key('ABCD' * 16)} b", f"s{i}") for i in range(5)]
    cut = [(f"-----BEGIN PRIVATE KEY-----\n{'GHIJK'[i] * 64}\n{'x' * 30} and so on", f"s{i}") for i in range(5)]
    rows = found(spark, docs, own + copied + cut + [("-----BEGIN PRIVATE KEY----- is a header, -----BEGIN PRIVATE KEY-----" + "z" * 300_000 + "-----END PRIVATE KEY-----.", "s9")])
    assert all((r["n_live"], r["clean"]) == (1, "a [SECRET] b") for r in rows[:5])
    assert all((r["n_live"], r["clean"]) == (0, r["text"]) for r in rows[5:10])
    assert all((r["n_live"], r["clean"]) == (1, "[SECRET] and so on") for r in rows[10:15])
    assert rows[15]["clean"] == "[SECRET] is a header, [SECRET]."
