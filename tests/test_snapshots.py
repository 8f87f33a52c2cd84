"""Tables under snapshots: keyed replacement in one step, conflicts, and writers that stop early."""

import pytest
from pyspark.sql import functions as F

from quillspark.sources import snapshots

SCHEMA = "version_id string, n int"


@pytest.fixture
def at(spark, tmp_path):
    return snapshots.SnapshotTable(spark, f"file://{tmp_path}/t", ["version_id"])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upsert_replaces_whole_keys(spark, at):
    at.replace(make(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]), buckets=8)
    before = at.snapshot()
    at.upsert(make(spark, [("a", 9), ("c", 5)]), gone=make(spark, [("b", None)]))
    assert rows(at.read()) == sorted([("a", 9), ("c", 5), (None, 4)], key=repr)
    assert rows(at.read(before["number"])) == sorted([("a", 1), ("a", 2), ("b", 3), (None, 4)], key=repr)
    at.upsert(make(spark, [(None, 7)]))
    assert (None, 7) in rows(at.read().where("version_id IS NULL")) and at.read().where("n = 4").isEmpty()


def test_untouched_buckets_stay(spark, at):
    at.replace(spark.range(200).select(F.col("id").cast("string").alias("version_id"), F.col("id").cast("int").alias("n")), buckets=16)
    before = at.snapshot()["parts"]
    at.upsert(make(spark, [("7", -7)]))
    after = at.snapshot()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert at.read().count() == 200 and rows(at.read().where("n < 0")) == [("7", -7)]


def test_a_writer_that_stops_leaves_the_old_state(spark, at, monkeypatch):
    at.replace(make(spark, [("a", 1), ("b", 2)]), buckets=4)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots.SnapshotTable, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            at.upsert(make(spark, [("a", 5)]), gone=make(spark, [("b", 0)]))
    assert rows(at.read()) == [("a", 1), ("b", 2)]
    at.upsert(make(spark, [("a", 5)]), gone=make(spark, [("b", 0)]))
    assert rows(at.read()) == [("a", 5)]
    assert len(at.vacuum()) >= 1 and rows(at.read()) == [("a", 5)]


def test_second_writer_is_told(spark, at, monkeypatch):
    at.replace(make(spark, [("a", 1)]))
    old = at.snapshot()
    at.append(make(spark, [("b", 2)]))
    monkeypatch.setattr(at, "snapshot", lambda number=None: old)
    with pytest.raises(snapshots.Conflict):
        at.append(make(spark, [("c", 3)]))
    monkeypatch.undo()
    assert rows(at.read()) == [("a", 1), ("b", 2)]


def test_first_upsert_and_empty_change(spark, at):
    with pytest.raises(FileNotFoundError):
        at.read()
    at.upsert(make(spark, [("a", 1)]))
    assert at.upsert(make(spark, [])) == 1
    assert rows(at.read()) == [("a", 1)]
    at.replace(make(spark, []))
    assert rows(at.read()) == []
