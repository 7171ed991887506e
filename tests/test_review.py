import pytest
from helpers import files, rows
from pyspark.sql import functions as F

from twinsieve.functions import scalars as fn
from twinsieve.operators import cascade, groups, review, store

S = ["session_id"]


def members(df):
    return cascade.members(df, S)


def decided(spark, *pairs):
    return spark.createDataFrame(list(pairs), "canonical_path string, action string")


def plan(spark, *rows_):
    return spark.createDataFrame(list(rows_), "canonical_path string, executed_at long")


def test_auto_mark_keeps_first_path(spark):
    df = files(spark, ("/z/beta.txt", 100, 111), ("/a/alpha.txt", 100, 111))
    marked = review.auto_mark(members(df)).withColumn("executed_at", F.lit(None).cast("long"))
    assert rows(marked, "canonical_path") == [("/z/beta.txt",)]
    assert rows(review.plan_summary(marked, df)) == [(1, 100)]


def test_group_order(spark):
    df = files(spark, ("/a", 500, 10), ("/b", 500, 10), ("/c", 200, 20), ("/d", 200, 20), ("/e", 200, 20))
    got = groups.groups_of_session(cascade.groups(df, S), "s").select("content_hash", "wasted_bytes").collect()
    assert [tuple(r) for r in got] == [("10", 500), ("20", 400)]
    assert rows(groups.totals(cascade.groups(df, S))) == [(2, 900)]


def test_subtree_marks(spark):
    df = files(spark, ("/target/a.txt", 100, 111), ("/target/sub/b.txt", 200, 222), ("/target2/c.txt", 300, 333))
    assert rows(review.mark_subtree(df, "/target"), "canonical_path") == [("/target/a.txt",), ("/target/sub/b.txt",)]
    assert len(rows(review.mark_subtree(df, "/TARGET", strict=False))) == 3


def test_plan_and_marks(spark):
    df = files(spark, ("/s/a.txt", 500, 1), ("/s/b.txt", 300, 2))
    assert rows(review.plan_summary(plan(spark, ("/s/a.txt", None), ("/s/b.txt", None)), df)) == [(2, 800)]
    log = spark.createDataFrame([("/s/a.txt", "mark", "auto", 1, 1), ("/s/a.txt", "unmark", "auto", 2, 2), ("/s/b.txt", "mark", "auto", 1, 3)], "canonical_path string, kind string, strategy string, marked_at long, seq long")
    assert rows(store.fold_marks(log), "canonical_path") == [("/s/b.txt",)]


def test_status_and_progress(spark):
    df = files(spark, *[(f"/{g}{i}", 10, g) for g in "abc" for i in range(3)])
    d = decided(spark, ("/b0", "keep"), *[(f"/c{i}", "delete") for i in range(3)])
    assert rows(review.review_status(members(df), d), "content_hash", "status") == [("a", "unreviewed"), ("b", "partial"), ("c", "decided")]
    assert rows(review.review_progress(members(df), d), "reviewed", "total") == [(4, 9)]


def test_queue_names_a_retained_copy(spark):
    df = files(spark, ("/a", 10, 1), ("/b", 10, 1), ("/c", 10, 1), ("/d", 20, 2), ("/e", 20, 2))
    d = decided(spark, ("/a", "delete"), ("/b", "keep"), ("/d", "delete"), ("/e", "delete"))
    q = review.deletion_queue(members(df), df, d)
    assert rows(q, "canonical_path", "retained_path") == [("/a", "/b"), ("/d", None), ("/e", None)]
    assert rows(review.queue_summary(q)) == [(3, 50, 1, False)]


def test_simulation(spark):
    p = plan(spark, ("/a", None), ("/b", None), ("/c", 5), (None, None))
    got = review.simulate(p, decided(spark, ("/a", "x")))
    assert rows(got) == [("/a", "success"), ("/b", "file_missing"), (None, "error: unknown file")]
    assert rows(review.simulation_summary(got)) == [(1, 1)]


WEEK = 7 * 86_400


@pytest.mark.parametrize(
    ("copies", "result"),
    [
        (((r"C:\backup\x", 0), (r"D:\data\x", 0)), (r"C:\backup\x", r"D:\data\x", "Backup root")),
        (((r"C:\Users\u\Documents\x", 0), (r"D:\data\x", 0)), (r"D:\data\x", r"C:\Users\u\Documents\x", "Active workspace")),
        ((("/a/x", 0), ("/b/x", WEEK + 86_400)), ("/a/x", "/b/x", "Most recent")),
        ((("/a/x", 0), ("/b/c/x", WEEK)), ("/b/c/x", "/a/x", "Shortest path")),
        ((("/a/x", 0), ("/b/x", 0)), None),
        ((("/a/x", 0),), None),
        (((r"C:\2019\x", 0), (r"D:\data\x", 0)), (r"C:\2019\x", r"D:\data\x", "Backup root")),
    ],
)
def test_suggestions(spark, copies, result):
    df = files(spark, *[(p, 1, 1, t) for p, t in copies])
    assert rows(review.suggest(df), "delete_path", "keep_path", "label") == ([result] if result else [])


def test_badges_and_selection(spark):
    df = files(spark, ("/a", 1, 1, 5), ("/b/c", 1, 1, 9), ("/d", 1, 2, 7), ("/e", 1, 2, 7), ("/single", 1, 3, 1))
    assert rows(review.age_badges(df), "canonical_path", "badge")[:4] == [("/a", "oldest"), ("/b/c", "newest"), ("/d", None), ("/e", None)]
    assert rows(review.auto_select(df), "canonical_path", "action") == [("/a", "delete"), ("/b/c", "keep"), ("/d", "keep"), ("/e", "delete")]
    assert ("/a", "keep") in rows(review.auto_select(df, "shortest"), "canonical_path", "action")
    with pytest.raises(ValueError):
        review.auto_select(df, "best")


def test_single_keep_and_undo(spark):
    log = spark.createDataFrame([("s", 1, "1", "/a", "keep", 1), ("s", 1, "1", "/b", "keep", 2), ("s", 1, "1", "/c", "delete", 3)], "session_id string, file_size long, content_hash string, canonical_path string, action string, seq long")
    assert rows(review.single_keep(log), "canonical_path", "action") == [("/a", "skip"), ("/b", "keep"), ("/c", "delete")]
    e = [("decide", "/a", "keep"), ("decide", "/a", "delete"), ("undo", None, None), ("undo", None, None), ("redo", None, None), ("decide", "/b", "keep"), ("redo", None, None)]
    events = spark.createDataFrame([("u", i, *x) for i, x in enumerate(e)], "user string, seq long, kind string, canonical_path string, action string")
    assert rows(review.undo_fold(events)) == [("u", "/a", "keep"), ("u", "/b", "keep")]
    two = spark.createDataFrame([("u", i, "decide", f"/{i}", "keep") for i in range(3)] + [("u", 9 + i, "undo", None, None) for i in range(3)], events.schema)
    assert rows(review.undo_fold(two, limit=2), "canonical_path", "action") == [("/0", "keep"), ("/1", "skip"), ("/2", "skip")]


def test_session_scoped_density(spark):
    one, two = files(spark, ("/d/a", 1, 1), ("/x/a", 1, 1)), files(spark, ("/d/a", 1, 1), ("/y/a", 1, 1), session="t")
    m = members(one.unionByName(two))
    assert rows(groups.directory_density(one, m, "s").where("parent_dir = '/d'"), "duplicates", "total") == [(1, 1)]
    assert rows(groups.sibling_context(one, m, "s"), "siblings", "duplicated") == [(0, 0), (0, 0)]


def test_filters_and_pages(spark):
    df = files(spark, ("/a/one.jpg", 10, 1), ("/b/two.txt", 10, 1), ("/a/100%.pdf", 5, 2), ("/c/x.pdf", 5, 2))
    g, m, d = cascade.groups(df, S), members(df), decided(spark, ("/a/one.jpg", "keep"))
    find = lambda **by: [r["content_hash"] for r in groups.filter_groups(g, m, df, d, "s", groups.GroupFilter(**by)).collect()]
    assert find() == ["1", "2"] and find(text="ONE") == ["1"] and find(text="%") == ["2"] and find(file_type="documents") == ["1", "2"]
    assert find(file_type="audio") == [] and find(file_type="no such") == [] and find(status="partial") == ["1"] and find(min_wasted=6) == ["1"] and find(max_wasted=5) == ["2"]
    assert groups.search(df, m, "0%").count() == 1
    for bad in ({"sort": "wasted; drop"}, {"by": groups.GroupFilter(status="no")}):
        with pytest.raises(ValueError):
            groups.filter_groups(g, m, df, d, "s", **bad)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(fn.extension(F.lit(x))) for x in ("a.b.TXT", "noext", ".jpg")] == ["txt", "noext", "jpg"]
    assert [value(fn.format_bytes(F.lit(x).cast("long"))) for x in (0, 999, 1500, 1_000_000, 2_345_000_000, -1, None)] == ["0 B", "999 B", "1.5 KB", "1 MB", "2.35 GB", "—", "—"]
    assert [value(fn.format_bytes(F.lit(x).cast("long"), True)) for x in (1023, 1536, 1 << 40)] == ["1023 B", "1.5 KiB", "1 TiB"]
    assert [value(fn.density_level(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 5), (1, 2))] == ["low", "medium", "high"]
    assert [value(fn.drive_letter(F.lit(x))) for x in (r"\\?\D:\x", "/x", r"c:\y")] == ["D", "", "c"]
    assert value(fn.hex16(F.lit(-1).cast("long"), True)) == "F" * 16
    for n, label in ((1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.3 KB"), (1279, "1.2 KB"), (2304, "2.3 KB"), (1792, "1.8 KB"), ((1 << 20) - 1, "1024.0 KB"), (5 << 19, "2.5 MB"), (3 << 30, "3.0 GB")):
        assert value(fn.treemap_label(F.lit(n).cast("long"))) == label
    assert value(fn.density_colour(F.lit(1.0))) == "#c42b1c"
    assert value(fn.path_label(F.lit("/x/y"))) == ""
    assert value(fn.session_label(F.lit("running"), F.array(F.lit("/a/b"), F.lit("/c")), F.lit("2024-01-02").cast("timestamp"))) == "aborted: b +1 2024-01-02"


def test_treemap_rectangles(spark):
    from twinsieve.functions.layout import squarify, treemap_rectangles

    boxes = squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert [round(w * h, 9) for *_, w, h in boxes] == [6, 6, 4, 3, 2, 2, 1] and boxes[0] == (0, 0, 3.0, 2.0)
    df = spark.createDataFrame([("/a", 30), ("/b", 10), ("/c", 0)], "parent_dir string, bytes long")
    assert rows(treemap_rectangles(df)) == [("/a", 0.0, 0.0, 0.75, 1.0), ("/b", 0.75, 0.0, 0.25, 1.0)]
    assert rows(treemap_rectangles(df, width=100, height=10, least=30)) == [] and rows(treemap_rectangles(df, width=100, height=40, least=30), "parent_dir") == [("/a",)]
    assert squarify([], 0, 0, 1, 1) == [] and rows(treemap_rectangles(df.where("1 = 0"))) == []
