import pytest
from pyspark.sql import functions as F

from hydrolens.sources.versions import VersionedTable, part_name
from hydrolens.streaming.ingest import IngestJob

SCHEMA = "k string, day string, v int"


def rows(table):
    return sorted((r.k, r.day, r.v) for r in table.read().collect())


def frame(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_a_writer_that_dies_before_the_swap_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), ["day"])
    t.upsert(frame(spark, ("a", "d1", 1), ("b", "d2", 2)), ["k"])
    with monkeypatch.context() as m:
        m.setattr(t, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            t.upsert(frame(spark, ("a", "d1", 9)), ["k"])
    assert rows(t) == [("a", "d1", 1), ("b", "d2", 2)]
    t.upsert(frame(spark, ("a", "d1", 9), ("c", "d1", 3)), ["k"])
    assert rows(t) == [("a", "d1", 9), ("b", "d2", 2), ("c", "d1", 3)]
    assert sorted(r.v for r in t.read(version=1).collect()) == [1, 2]


def test_only_touched_partitions_are_written_again(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["day"])
    t.upsert(frame(spark, ("a", "d1", 1), ("b", "d2", 2), ("n", None, 0)), ["k"])
    before = {f["folder"] for f in t.current()["folders"]}
    t.upsert(frame(spark, ("b", "d2", 5)).withColumn("extra", F.lit("x")), ["k"])
    assert len(before & {f["folder"] for f in t.current()["folders"]}) == 2
    assert {(r.k, r.v, r.extra) for r in t.read().collect()} == {("a", 1, None), ("b", 5, "x"), ("n", 0, None)}
    with pytest.raises(ValueError, match="duplicate"):
        t.upsert(frame(spark, ("b", "d2", 1), ("b", "d2", 2)), ["k"])
    t.upsert(frame(spark), ["k"])
    assert len(t.read().collect()) == 3


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, two = VersionedTable(spark, path), VersionedTable(spark, path)
    one.upsert(frame(spark, ("a", "d1", 1)), ["k"])
    known = two.current()
    one.upsert(frame(spark, ("b", "d1", 2)), ["k"])
    monkeypatch.setattr(two, "current", lambda: known)
    with pytest.raises(RuntimeError, match="another writer"):
        two.upsert(frame(spark, ("c", "d1", 3)), ["k"])
    assert rows(one) == [("a", "d1", 1), ("b", "d1", 2)]


def test_appends_replays_compaction_and_vacuum(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["day"])
    for i in (0, 1, 1, 2):
        t.append(frame(spark, (f"k{i}", "d1", i), (f"m{i}", f"d{i + 2}", i)), str(i))
    wanted = rows(t)
    assert len(wanted) == 6
    t.compact(3)
    assert [f["part"] for f in t.current()["folders"]].count(part_name(day="d1")) == 1 and rows(t) == wanted
    t.vacuum(1)
    assert rows(t) == wanted and len(t.versions()) == 1


def test_a_batch_reads_the_keys_of_its_days_only(spark, tmp_path):
    def message(day, minute):
        body = f'{{"stationId":"s1","timestamp":"2026-01-0{day}T00:{minute:02d}:00Z","waterLevelCm":50}}'
        return (body, "sensors/s1/readings")

    stations = spark.createDataFrame([("s1", "Bridge", "offline", 100.0, 150.0, 200.0)], "station_id string, name string, status string, warning_level_cm double, danger_level_cm double, critical_level_cm double")
    job = IngestJob(spark, str(tmp_path / "job"), stations, "sensors/+/readings")
    batches = [(0, [(1, 0), (1, 1)]), (1, [(2, 0), (1, 1)]), (1, [(2, 0), (1, 1)]), (2, [(3, 0), (2, 0), (1, 2)]), (3, [(3, 0), (3, 1)])]
    for batch, readings in batches:
        job.process(spark.createDataFrame([message(*r) for r in readings], "value string, topic string"), batch)
    assert job.table("observations").count() == 6
    files = job.keys.read([part_name(key_day="2026-01-03")]).inputFiles()
    assert files and all("2026-01-03" in f for f in files)
