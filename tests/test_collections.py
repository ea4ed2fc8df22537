import json
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.sources.collections import feature_texts
from hydrolens.sources.geojson import read_features

WORDS = ["plain", "a}b", "{[", "]}", 'say "x"', "back\\slash\\", '"features": [', '"type": "FeatureCollection"', "ünï}", "", "\\\"}{", "] } ,"]


def some_feature(rng, i):
    ring = [[rng.randint(0, 9), rng.randint(0, 9)] for _ in range(rng.randint(3, 40))]
    properties = {"n": str(i), rng.choice(WORDS) + "k": rng.choice(WORDS), "features": rng.choice(WORDS), "nested": {"a": [{"b": rng.choice(WORDS)}], "features": [{}]}}
    geometry = rng.choice([{"type": "Polygon", "coordinates": [ring]}, {"type": "Point", "coordinates": ring[0]}, None])
    return {"type": "Feature", "properties": properties, "geometry": geometry}


def some_collection(rng, count):
    members = [
        ("type", "FeatureCollection"), ("name", rng.choice(WORDS)), ("crs", {"type": "name", "properties": {"features": [{"x": rng.choice(WORDS)}]}}),
        ("foreign", [{"type": "Feature", "properties": {"n": "foreign"}}, [{"features": [1]}]]), ("features", [some_feature(rng, i) for i in range(count)]),
    ]
    rng.shuffle(members)
    return dict(members)


@pytest.mark.parametrize("split", [229, 1900, 100000])
def test_features_equal_the_whole_read_at_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    wanted = []
    for i, count in enumerate((1, 25, 3)):
        document = some_collection(rng, count)
        wanted += [json.dumps(f, sort_keys=True) for f in document["features"]]
        text = json.dumps(document, ensure_ascii=False, indent=rng.choice([None, 1]))
        (tmp_path / f"{i}.json").write_text(text + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = feature_texts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in rows) == sorted(wanted)


def test_bad_collections_are_errors(spark, tmp_path):
    def fails(name, text, message):
        path = tmp_path / name
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            read_features(spark, str(path)).collect()

    one = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":null}'
    fails("a.json", '{"type":"FeatureCollection","features":[ ]}', "no features")
    fails("b.json", '{"type":"FeatureCollection"}', "no features")
    fails("c.json", one, "FeatureCollection")
    fails("d.json", '{"x":{"type":"FeatureCollection"},"features":[%s]}' % one, "FeatureCollection")
    fails("e.json", '{"type":"FeatureCollection","features":[%s,{"type":"Feature","properties":{"a":{' % one, "cut off")
    fails("f.json", '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":,}}]}', "(?i)malformed|parse")


def test_a_feature_across_many_splits(spark, tmp_path):
    ring = [[i / 1000, (i * i) % 7] for i in range(4000)]
    holes = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {str(k): {"v": "}" * 50} for k in range(200)}} for _ in range(3)]
    path = tmp_path / "big.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": holes}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    try:
        rows = read_features(spark, str(path)).select(F.size(F.col("geometry.rings")[0]).alias("n"), F.size("properties").alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.n, r.p) for r in rows] == [(4000, 200)] * 3
