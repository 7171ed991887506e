import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from twinsieve.llm import warc
from twinsieve.llm.scratch import filesystem

BIG, OTHER = "<p>é</p>" * 300, "<b>x</b>" * 300
PAGES = [(1, "u1", BIG), (5, "u\r\n5", BIG), (3, None, BIG), (None, "null id", BIG), (5, "u5 again", BIG), (2, "u2", "small"), (4, "u4", "small"), (6, "u6", None), (7, "u7", ""), (8, "u8", OTHER), (None, None, None)]
SCHEMA = "page_id long, url string, html string, id long, digest string, offset long"


def pages(spark):
    return spark.createDataFrame([(*p, 1, "d", 2) for p in PAGES], SCHEMA).repartition(3)


def test_round_trip(spark):
    index = warc.archive(pages(spark))
    got = sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        revisit = html == BIG and i != 5
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)


def test_archives_are_gzip_members_at_the_indexed_places(spark):
    index = warc.archive(pages(spark)).orderBy("file", "offset").collect()
    for r in index:
        system, path = filesystem(r["file"])
        with system.open_input_file(path) as f:
            fields, body = warc.parse(f.read_at(r["length"], r["offset"]))
        assert fields["WARC-Type"] == r["record_type"] and fields["WARC-Payload-Digest"] == f"sha1:{r['digest']}"
        assert (len(body) == r["payload_bytes"]) == (r["record_type"] == "response" or not r["payload_bytes"])
    whole = gzip.decompress(Path(index[0]["file"].removeprefix("file://")).read_bytes())
    assert whole.startswith(b"WARC/1.1\r\n")


def test_selected_records_only(spark):
    index = warc.archive(pages(spark))
    few = warc.read_records(index.where("id in (2, 8)"), payloads=True).collect()
    assert sorted((r["id"], bytes(r["payload"]).decode()) for r in few) == [(2, "small"), (8, OTHER)]


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 500, 5), ("b", 505, 5)]
    assert list(warc.ranges(rows, gap=10, most=1000)) == [("a", 0, 30, [0, 1, 2]), ("a", 500, 505, [3]), ("b", 505, 510, [4])]
    assert [x[3] for x in warc.ranges(rows, gap=10, most=20)] == [[0, 1], [2], [3], [4]]
    assert list(warc.ranges([])) == []


def test_empty(spark):
    assert warc.read_records(warc.archive(pages(spark).where("1 = 0"))).collect() == []


def test_long_payloads_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    long, hot = "<i>long</i>" * 300_000, "<u>hot</u>" * 200
    rows = [(i, hot) for i in range(100)] + [(1000 + i, f"{i} " + "z" * 1500) for i in range(40)] + [(2000, long), (2001, long), (2002, None), (2003, None)]
    got = {r["id"]: r for r in warc.read_records(warc.archive(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(4))).collect()}
    assert len(got) == len(rows)
    for i, html in rows:
        raw = (html or "").encode()
        top = 99 if html == hot else 2001 if html == long else i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == i else ("revisit", top))


def test_an_attempt_that_runs_twice_leaves_a_whole_index(spark, tmp_path):
    """Two attempts of the same partitions, in other orders of rows: each index names the bytes of its own files."""
    base = f"file://{tmp_path}"
    rows = warc.classify(pages(spark)).coalesce(1)
    one = warc.write_archives(rows.sortWithinPartitions("url"), base)
    two = warc.write_archives(rows.sortWithinPartitions("payload_bytes"), base)
    assert one.select("file").distinct().count() == two.select("file").distinct().count() == 1
    content = lambda index: sorted((tuple(r) for r in warc.read_records(index).select("id", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert content(one) == content(two) and len(content(one)) == len(PAGES)


def test_the_filter_lets_few_bodies_through(spark):
    repeated = spark.range(5_000).select(F.sha1(F.concat(F.lit("r"), F.col("id"))).alias("same"))
    rows = spark.range(40_000).select(F.sha1(F.concat(F.when(F.col("id") < 5_000, "r").otherwise("x"), F.col("id"))).alias("digest"), "id")
    marked = warc._marked(rows, repeated, F.col("id") >= 0)
    assert marked.where("id < 5000 and not may_repeat").count() == 0
    assert marked.where("id >= 5000 and may_repeat").count() < 35_000 / 64 * 1.3
    assert warc._marked(rows, repeated.where("1 = 0"), F.col("id") >= 0).where("may_repeat").count() == 0


def test_a_payload_of_many_pages_is_spread_over_tasks(spark):
    df = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>hot</p>" * 120).alias("html"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = warc.classify(df)
        sizes = [r["count"] for r in records.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        kinds = {r["record_type"]: (r["count"], r["bytes"]) for r in records.groupBy("record_type").agg(F.count("*").alias("count"), F.sum(F.octet_length("body")).alias("bytes")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert kinds == {"response": (1, 1200), "revisit": (19_999, 0)}
    assert max(sizes) < 8_000
