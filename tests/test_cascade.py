import pytest
from helpers import rows
from pyspark.sql import functions as F

from twinsieve.operators import cascade
from twinsieve.plans.scan import analyze
from twinsieve.sources import inventory, shared

P = b"A" * 1024
TREE = {"/x/1": P + b"tail-one", "/x/2": P + b"tail-one", "/x/3": P + b"tail-two", "/x/4": b"B" * 1032, "/x/5": b"short", "/x/6": b"", "/x/7": None}


@pytest.fixture(scope="module")
def inv(spark):
    df = spark.createDataFrame(list(TREE.items()), "p string, c binary")
    return inventory.from_table(df, F.col("p"), F.col("c"))


def paths(df):
    return [r[0] for r in rows(df, "canonical_path")]


def test_stages(inv):
    assert paths(cascade.same_size(inv)) == ["/x/1", "/x/2", "/x/3", "/x/4"]
    assert paths(cascade.same_prefix(inv)) == ["/x/1", "/x/2", "/x/3"]
    assert paths(cascade.find_duplicates(inv)) == ["/x/1", "/x/2"]
    assert rows(cascade.groups(cascade.find_duplicates(inv)), "file_size", "file_count", "wasted_bytes") == [(1032, 2, 1032)]
    assert rows(cascade.scan_result(inv)) == [(5, 4, 3, 1, 2, 1032)]


def test_no_content_in_a_shuffle(spark, inv):
    """Every exchange of the plans carries slim columns, also where nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (cascade.same_prefix(inv), cascade.find_duplicates(inv), cascade.scan_result(inv), cascade.groups(cascade.find_duplicates(inv))):
            plan = df._jdf.queryExecution().executedPlan()
            text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            parts = [x for x in text.split("\n\n") if "Exchange" in x.split("\n")[0]]
            assert parts and plan is not None
            assert not any("content#" in line for x in parts for line in x.split("\n") if line.startswith("Input"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("algorithm", ["md5", "sha256", "xxhash64"])
def test_any_digest_gives_the_same_groups(inv, algorithm):
    assert paths(cascade.find_duplicates(inv, algorithm=algorithm)) == ["/x/1", "/x/2"]


def test_cascade_is_grouping_by_content(inv):
    plain = cascade.repeated(inv.where("file_size > 0"), ["content"])
    assert paths(plain) == paths(cascade.find_duplicates(inv, prefix=2))


def test_within_and_repeated_paths(spark):
    df = spark.createDataFrame([("/a", b"x", "1"), ("/b", b"x", "1"), ("/c", b"x", "2"), ("/a", b"x", "1")], "p string, c binary, s string")
    inv = inventory.from_table(df, F.col("p"), F.col("c"), session_id=F.col("s"))
    dups = cascade.find_duplicates(inv, ["session_id"])
    assert sorted(set(paths(dups))) == ["/a", "/b"]
    assert len(paths(cascade.members(dups, ["session_id"]))) == 2


def test_empty(inv):
    none = inv.where("1 = 0")
    assert rows(cascade.scan_result(none)) == [(0, 0, 0, 0, 0, 0)]
    assert rows(cascade.scan_stats(none)) == [(0, 0, 0)]


@pytest.fixture
def disk(tmp_path):
    small = {"folder_a/unique_a.txt": b"unique content a", "folder_b/unique_b.txt": b"unique content b", "folder_a/shared.txt": b"shared content xyz", "folder_b/shared.txt": b"shared content xyz", "empty": b""}
    for name, data in (small | {"folder_c/large_dup_1.bin": b"\xaa" * 4096, "folder_c/large_dup_2.bin": b"\xaa" * 4096}).items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return tmp_path


def test_files_on_disk(spark, disk):
    inv = inventory.from_paths(spark, [str(disk), str(disk / "folder_a"), str(disk / "missing")])
    assert inv.count() == 6
    dups = inventory.find_duplicate_files(inv)
    found = analyze(inv, dups, threshold=0.5)
    assert rows(found.groups, "file_size", "file_count", "wasted_bytes") == [(18, 2, 18), (4096, 2, 4096)]
    assert dups.agg(F.sum("file_size")).first()[0] == 8228
    a, b = (str(disk / f) for f in ("folder_a", "folder_b"))
    assert rows(found.similar.where((F.col("entity_a") == a) & (F.col("entity_b") == b)), "score", "shared_weight", "match_type") == [(1.0, 18, "exact")]
    every = analyze(inv, dups, universe="all", hashed=inventory.full_digest(inv))
    assert every.similar.where((F.col("entity_a") == a) & (F.col("entity_b") == b)).count() == 0


def test_ignored_folder(spark, disk):
    inv = inventory.from_paths(spark, [str(disk)], ignore=["**/folder_c/**", "[oops"])
    assert inv.count() == 4 and cascade.groups(inventory.find_duplicate_files(inv)).count() == 1


def test_removed_file_and_same_scan_again(spark, disk):
    first = rows(inventory.find_duplicate_files(inventory.from_paths(spark, [str(disk)])))
    assert first == rows(inventory.find_duplicate_files(inventory.from_paths(spark, [str(disk)])))
    (disk / "folder_b/shared.txt").unlink()
    spark.catalog.clearCache()
    assert cascade.groups(inventory.find_duplicate_files(inventory.from_paths(spark, [str(disk)]))).count() == 1


@pytest.mark.parametrize(
    ("roots", "kept"),
    [(["a/b", "a/c", "a"], ["a"]), (["/home/user", "/home/user/docs", "/var/data"], ["/home/user", "/var/data"]), (["/a", "/ab"], ["/a", "/ab"]), ([], []), (["/a", "/a/", "/a"], ["/a"])],
)
def test_roots(roots, kept):
    assert inventory.reduce_roots(roots) == kept


def test_config(tmp_path):
    assert inventory.Config.load(str(tmp_path / "none.toml")) == inventory.Config()
    (tmp_path / "c.toml").write_text('root_paths = ["/a"]\nignore_patterns = ["*.tmp"]\n')
    assert inventory.Config.load(str(tmp_path / "c.toml")) == inventory.Config(["/a"], ["*.tmp"])


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("**/x/**", "/a/x/b", True), ("**/x/**", "/a/xy/b", False), ("*/x", "/a/x", True), ("*.tmp", "/a/b.tmp", True), ("/a/[!b]", "/a/c", True), ("/a/[!b]", "/a/b", False), ("/a/?", "/a/bc", False)],
)
def test_globs(pattern, path, hit):
    import re

    assert bool(re.match(inventory.glob_regex(pattern), path)) is hit


def test_walk_skips_what_it_may_not_read(spark, disk, monkeypatch):
    import os

    (disk / "folder_a" / "link.txt").symlink_to(disk / "folder_a" / "shared.txt")
    (disk / "loop").symlink_to(disk)
    files, skipped = inventory.walk(spark, [str(disk), str(disk / "folder_a"), str(disk / "missing")])
    plain = inventory.from_paths(spark, [str(disk)])
    real = {p for p in paths(plain) if "link" not in p and "loop" not in p}
    assert set(paths(files)) == real and len(real) == 6 and skipped.count() == 0  # links are neither followed nor listed
    assert rows(files.where(f"canonical_path = '{disk}/folder_a/shared.txt'"), "file_size", "file_name") == [(18, "shared.txt")]

    def lister(path):
        if path.endswith("folder_b"):
            return [("skipped", path, 0, 0, "PermissionError: Permission denied")]
        return inventory.list_directory(path)

    files, skipped = inventory.walk(spark, [str(disk)], ["*.bin"], lister)
    assert rows(skipped, "path", "reason") == [(str(disk / "folder_b"), "PermissionError: Permission denied")]
    assert set(paths(files)) == {p for p in real if "folder_b" not in p and not p.endswith(".bin")}

    def denied(path):
        raise PermissionError(13, "Permission denied")

    monkeypatch.setattr(os, "scandir", denied)
    assert inventory.list_directory(str(disk)) == [("skipped", str(disk), 0, 0, "PermissionError: Permission denied")]


class Entry:
    """A directory entry of which one call may fail."""

    def __init__(self, name, fails=None):
        self.path, self.fails = f"/d/{name}", fails

    def is_symlink(self):
        return False

    def is_dir(self, follow_symlinks):
        return False

    def is_file(self, follow_symlinks):
        return True

    def stat(self, follow_symlinks):
        if self.fails:
            raise self.fails
        return type("S", (), {"st_size": 3, "st_mtime": 9.5})


def test_one_bad_entry_does_not_hide_its_siblings(monkeypatch):
    import contextlib
    import os

    entries = [Entry("a"), Entry("b", PermissionError(13, "Permission denied")), Entry("c"), Entry("gone", FileNotFoundError(2, "gone"))]
    monkeypatch.setattr(os, "scandir", lambda path: contextlib.nullcontext(entries))
    assert inventory.list_directory("/d") == [("file", "/d/a", 3, 9, None), ("skipped", "/d/b", 0, 0, "PermissionError: Permission denied"), ("file", "/d/c", 3, 9, None)]
    entries.append(Entry("broken", OSError(5, "Input/output error")))
    with pytest.raises(OSError, match="Input/output"):
        inventory.list_directory("/d")


def test_an_error_other_than_permission_ends_the_walk(spark, disk):
    def lister(path):
        if path.endswith("folder_b"):
            raise OSError(5, "Input/output error")
        return inventory.list_directory(path)

    with pytest.raises(Exception, match="Input/output"):
        inventory.walk(spark, [str(disk)], lister=lister)
    # but not below a directory that is ignored
    assert inventory.walk(spark, [str(disk)], ["**/folder_b"], lister)[0].count() == 4


@pytest.mark.parametrize("pattern", ["**/skipme/**", "**/skipme", "*/skipme"])
def test_nothing_below_an_ignored_directory_is_listed(spark, disk, tmp_path_factory, pattern):
    (disk / "skipme/deep/deeper").mkdir(parents=True)
    (disk / "skipme/deep/deeper/x.txt").write_bytes(b"x")
    (disk / "folder_a/skipme").mkdir()
    (disk / "folder_a/skipme/y.txt").write_bytes(b"y")
    log = tmp_path_factory.mktemp("log") / "listed"

    def lister(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return inventory.list_directory(path)

    files, _ = inventory.walk(spark, [str(disk)], [pattern, "[oops"], lister)
    assert sorted(log.read_text().split()) == sorted(str(disk / d) for d in ("", "folder_a", "folder_b", "folder_c"))
    assert files.count() == 6 and set(paths(files)) == set(paths(inventory.from_paths(spark, [str(disk)], [pattern])))
    log.unlink()
    assert inventory.walk(spark, [str(disk / "skipme/deep")], [pattern], lister)[0].count() == 0 and not log.exists()


def counting(log, broken=""):
    """An opener that notes each file it opens."""

    def opener(path):
        with open(log, "a") as f:
            f.write(path.rpartition("/")[2] + "\n")
        if broken and path.endswith(broken):
            raise PermissionError(13, "Permission denied")
        return inventory.open_file(path)

    return opener


def test_every_file_is_opened_once_a_stage(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"same{i}").write_bytes(b"s" * 3000)
    (tmp_path / "size").write_bytes(b"t" * 3000)
    (tmp_path / "other").write_bytes(b"u" * 10)
    inv, log = inventory.from_paths(spark, [str(tmp_path)]), tmp_path / "log"
    found = inventory.find_duplicate_files(inv, opener=counting(log))
    for _ in range(2):
        assert len(paths(found)) == 4
    opened = log.read_text().split()
    assert {n: opened.count(n) for n in set(opened)} == {"same0": 2, "same1": 2, "same2": 2, "same3": 2, "size": 1}


def test_a_file_that_cannot_be_read_is_left_out(spark, tmp_path):
    for name in ("a", "b", "locked"):
        (tmp_path / name).write_bytes(b"s" * 30)
    inv, log = shared.stash(inventory.from_paths(spark, [str(tmp_path)]), "listed"), tmp_path / "log"
    assert [p.rpartition("/")[2] for p in paths(inventory.find_duplicate_files(inv, opener=counting(log, "locked")))] == ["a", "b"]
    assert [p.rpartition("/")[2] for p in paths(inventory.unreadable(inventory.full_digest(inv, opener=counting(log, "b"))))] == ["b"]
    (tmp_path / "a").unlink()
    assert paths(inventory.find_duplicate_files(inv)) == [str(tmp_path / "b"), str(tmp_path / "locked")]


def test_a_query_writes_digests_once(spark, monkeypatch):
    from twinsieve.plans import catalog

    made = []
    fresh = shared.fresh
    monkeypatch.setattr(shared, "fresh", lambda s, name: made.append(name) or fresh(s, name))
    for name, tables in (("op_q07_filtered_groups", ["digests"]), ("op_k02_groups_and_members", ["digests"]), ("op_d03_duplicate_groups", ["digests"]), ("op_q11_quick_wins", ["digests", "elements"])):
        made.clear()
        catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert made == tables, name
