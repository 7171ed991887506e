import pytest
from helpers import files, rows
from pyspark.sql import functions as F

from twinsieve.operators import store
from twinsieve.sources import shared
from twinsieve.streaming import incremental

SESSION = "session_id string, root_paths string, status string, started_at timestamp, completed_at timestamp"


def test_sessions(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("s1", '["/a","/b"]', "completed", t, t), ("s2", '["/a"]', "running", t, None)], SESSION)
    again = store.find_or_create_session(sessions, ["/b", "/a"], "new", "2024-02-01")
    assert rows(again, "session_id", "status", "reused") == [("s1", "running", True)]
    assert rows(store.find_or_create_session(sessions, ["/a"], "new", "2024-02-01"), "session_id", "reused") == [("new", False)]
    done = store.complete_session(again, "2024-02-02", files(spark, ("/a/x", 40, 1), ("/a/y", 60, 1)))
    assert rows(done, "status", "files_scanned", "total_bytes") == [("completed", 2, 100)]
    assert store.delete_sessions(sessions, ["s1"]).count() == 1 and store.delete_sessions(sessions, None).count() == 0 and store.delete_sessions(sessions, []).count() == 2


def test_upserts(spark):
    schema = "canonical_path string, file_size long, marked_deleted boolean"
    old = spark.createDataFrame([("/a", 1, True), ("/b", 2, False)], schema)
    new = spark.createDataFrame([("/a", 9, False), ("/c", 3, None), ("/c", 3, None)], schema)
    assert rows(store.upsert_files(old, new)) == [("/a", 9, True), ("/b", 2, False), ("/c", 3, None)]
    assert rows(store.insert_or_ignore(old, new, ["canonical_path"]), "canonical_path", "file_size") == [("/a", 1), ("/b", 2), ("/c", 3)]


def test_snapshots(spark, tmp_path):
    base = str(tmp_path / "groups")
    assert store.read_snapshot(spark, base) is None
    rows_ = spark.createDataFrame([("s", 1), ("t", 2)], "session_id string, n long")
    store.write_snapshot(rows_, base, ["session_id"])
    store.write_snapshot(spark.createDataFrame([("t", 5)], rows_.schema), base, ["session_id"])
    assert rows(store.read_snapshot(spark, base), "session_id", "n") == [("s", 1), ("t", 5)]


def test_hash_cache_asks_only_for_misses(spark):
    df = files(spark, ("/a", 1, None), ("/b", 1, None)).drop("content_hash")
    cache = spark.createDataFrame([("/a", 1_700_000_000, "known"), ("/b", 5, "old")], "canonical_path string, last_modified long, content_hash string")
    out, new = store.with_cached_hash(df, cache, lambda d: d.withColumn("content_hash", F.lit("fresh")))
    assert rows(out, "canonical_path", "content_hash") == [("/a", "known"), ("/b", "fresh")]
    assert rows(store.cache_count(new)) == [(3,)] and store.clear(new).count() == 0


def test_rescan(spark):
    before = files(spark, ("/a", 1, 1), ("/b", 1, 1), ("/c", 2, 2))
    asked = []

    def hashed(d):
        asked.append([r[0] for r in d.select("canonical_path").collect()])
        return d.withColumn("content_hash", F.lit("1"))

    now = files(spark, ("/a", 1, None), ("/d", 1, None), ("/e", 7, None)).select("canonical_path", "file_size", "last_modified")
    assert rows(incremental.rescan(before, now, hashed), "canonical_path") == [("/a",), ("/d",)]
    assert asked == [["/d"]]
    assert rows(incremental.changes(before, now), "canonical_path", "change") == [("/a", "same"), ("/b", "removed"), ("/c", "removed"), ("/d", "added"), ("/e", "added")]


def test_stream(spark, tmp_path):
    schema = "canonical_path string, file_size long, content_hash string, seen_at timestamp"
    df = spark.createDataFrame([("/a", 1, "x"), ("/b", 1, "x"), ("/a", 1, "x"), ("/c", 2, "y")], "canonical_path string, file_size long, content_hash string").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = incremental.duplicate_counts(stream).writeStream.outputMode("update").format("memory").queryName("dups_now").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("dups_now").where("file_count > 1"), "content_hash", "file_count", "wasted_bytes") == [("x", 2, 1)]
    seen = []
    incremental.run_batches(stream, lambda batch, i: seen.append(batch.count()), str(tmp_path / "ck")).awaitTermination()
    assert seen == [4]


def test_progress(spark):
    import pytest

    said = []
    p = incremental.Progress(spark, lambda *x: said.append(x))
    assert p.run("scan", lambda: 7) == 7 and said == [("scan", "start"), ("scan", "end")]
    p.cancel()
    with pytest.raises(RuntimeError):
        p.run("hash", lambda: 1)


def test_last_write_wins(spark):
    old = spark.createDataFrame([("/a", 5, 0)], "canonical_path string, file_size long, marked_deleted int")
    new = spark.createDataFrame([("/a", 9, 0, 1), ("/a", 2, 0, 7), ("/a", 8, 0, 3)], "canonical_path string, file_size long, marked_deleted int, seq long")
    assert rows(store.upsert_files(old, new, order="seq"), "canonical_path", "file_size") == [("/a", 2)]
    assert rows(store.upsert_files(old, new.drop("seq")), "canonical_path", "file_size") == [("/a", 9)]


def test_swap_and_versions(spark, tmp_path):
    base = f"file://{tmp_path}/cache"
    store.swap_snapshot(spark.range(3), base)
    store.swap_snapshot(store.read_snapshot(spark, base).where("id > 0"), base)  # computed from what it replaces
    assert store.read_snapshot(spark, base).count() == 2
    (tmp_path / "cache" / f"v{store.VERSION}").rename(tmp_path / "cache" / f"v{store.VERSION}.old")  # a crash between the renames
    assert store.read_snapshot(spark, base).count() == 2
    spark.range(1).write.parquet(f"{base}/v1")
    assert store.drop_other_versions(spark, base) == ["v1"] and store.read_snapshot(spark, base).count() == 2
    assert store.drop_other_versions(spark, f"{base}/none") == []


def test_stashed_tables_are_removed(spark):
    df, path = shared.stashed(spark.range(4), "test")
    assert df.count() == 4
    shared.remove(spark, path)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
