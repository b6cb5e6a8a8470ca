"""The store of scans: what is written is read, a version counts whole or not at all, lookups read one partition."""

import io
from contextlib import redirect_stdout

import pytest

from auditlake.sources.store import ChangedMeanwhile, ScanStore

SCAN = "id string, status string, created_at string, reports map<string,boolean>"


@pytest.fixture
def store(spark, tmp_path):
    return ScanStore(spark, f"{tmp_path}/s", SCAN, buckets=8)


def scans(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:3] + ({"json": True},) for r in rows], SCAN)


def seen(df):
    return sorted((r.id, r.status) for r in df.collect())


def test_written_read_and_found_again(spark, store):
    assert store.version() is None and store.read().count() == 0 and store.get("a").count() == 0
    assert store.create(scans(spark, [("a", "queued"), ("b", "queued"), ("c", "queued"), (None, "x"), ("c", "running", "2024")])) == 0
    assert seen(store.read()) == [("a", "queued"), ("b", "queued"), ("c", "running")]
    assert store.save(scans(spark, [("b", "completed"), ("zz", "completed")])) == 1
    assert seen(store.read()) == [("a", "queued"), ("b", "completed"), ("c", "running")] and seen(store.read(0))[1] == ("b", "queued")
    assert store.get("b").first().reports == {"json": True}


def test_deleted_ids_stay_deleted(spark, store):
    store.create(scans(spark, [(f"s{i}", "queued") for i in range(40)]))
    store.delete(spark.createDataFrame([("s1",), ("s2",), ("none",), (None,)], "id string"))
    store.save(scans(spark, [("s1", "completed"), ("s3", "completed")]))
    left = dict(seen(store.read()))
    assert len(left) == 38 and "s1" not in left and left["s3"] == "completed"
    store.delete(store.read().select("id"))
    assert store.read().count() == 0 and store.get("s3").count() == 0
    store.create(scans(spark, [("s1", "again")]))
    assert seen(store.read()) == [("s1", "again")]


def test_a_writer_lost_before_the_switch_changes_nothing(spark, store, monkeypatch):
    store.create(scans(spark, [("a", "queued")]))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.save(scans(spark, [("a", "completed")]))
    assert store.version() == 0 and seen(store.read()) == [("a", "queued")]
    store.save(scans(spark, [("a", "completed")]))
    store.vacuum(keep=1)
    assert seen(store.read()) == [("a", "completed")] and store._names("versions") == ["1"]
    assert sum(len([n for n in store._names(f"data/{f}") if n.startswith("bucket=")]) for f in store._names("data")) == 1


def test_of_two_writers_one_wins(spark, store):
    store.create(scans(spark, [("a", "queued")]))
    folders = store._folders(0)
    store._commit(folders, 0)
    with pytest.raises(ChangedMeanwhile):
        store._commit({}, 0)
    assert seen(store.read()) == [("a", "queued")] and all(not n.startswith(".draft") for n in store._names("versions"))


def test_only_touched_partitions_are_written_and_read(spark, store):
    store.create(scans(spark, [(f"s{i}", "queued") for i in range(100)]))
    before = store._folders(0)
    store.save(scans(spark, [("s5", "running")]))
    changed = [k for k, v in store._folders(1).items() if before[k] != v]
    assert len(before) == 8 and len(changed) == 1
    found = store.get("s5")
    assert found.count() == 1 and len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    said = io.StringIO()
    with redirect_stdout(said):
        found.explain("formatted")
    assert "PartitionFilters: [isnotnull(bucket" in said.getvalue()
