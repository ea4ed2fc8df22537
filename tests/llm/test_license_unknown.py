"""The class unknown is taught and calibrated on lines that the scan scores."""


def test_unknown_sample(spark, docs):
    """Licence-like lines of no known family are taught and held aside as ``unknown``; common ones take one place."""
    from hydrolens.llm.licenses import UNKNOWN, _training

    rows = [(i, f"Licensed under the Foo {i} Private License\nReleased under the MIT License.\na common copyright line of the house", "a", 1, "") for i in range(50)]
    hard = [(r["line"], r["label"]) for r in _training(spark, spark.createDataFrame(rows, docs.schema), "text").where("hard").collect()]
    assert len(hard) == 51 and {label for _, label in hard} == {UNKNOWN} and not any("MIT" in line for line, _ in hard)
