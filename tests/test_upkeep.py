"""Tables kept up by deltas against full rollups, and sketches against exact counts."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from twinsieve.operators import sketches, tree, upkeep
from twinsieve.sources.inventory import located

COLUMNS = "canonical_path string, file_size long, last_modified long, content_hash string"


def listing(spark, state):
    return located(spark.createDataFrame([(p, *v) for p, v in state.items()], COLUMNS))


def full(df):
    totals = tree.directory_tree(df).select("path", "file_count", "total_size")
    return rows(totals), rows(tree.directory_elements(df), "entity", "element", "weight")


def changed(rng, state, n):
    state = dict(state)
    for _ in range(n):
        path = f"/{rng.choice('ab')}/{rng.choice('xyz')}/{rng.choice(['', 'deep/er/'])}f{rng.randrange(12)}"
        if rng.random() < 0.35:
            state.pop(path, None)
        else:
            state[path] = (rng.choice([0, 5, 7]), rng.randrange(1000), rng.choice([None, "h1", "h2", "h3"]))
    return state


def test_random_changes_come_to_the_full_rollup(spark):
    rng, state = random.Random(1), {}
    totals = spark.createDataFrame([], upkeep.SCHEMAS["totals"])
    contents = spark.createDataFrame([], upkeep.SCHEMAS["contents"])
    for k in range(5):
        new = changed(rng, state, 40) if k < 4 else {}
        before, now = listing(spark, state), listing(spark, new)
        same = {p for p in state if new.get(p) == state[p]}
        changes = upkeep.signed(before.where(~F.col("canonical_path").isin(*same, "")), now.where(~F.col("canonical_path").isin(*same, "")))
        totals = spark.createDataFrame(upkeep.merge_totals(totals, upkeep.total_deltas(changes)).collect(), upkeep.SCHEMAS["totals"])
        contents = spark.createDataFrame(upkeep.merge_contents(contents, upkeep.content_deltas(changes)).collect(), upkeep.SCHEMAS["contents"])
        want = full(now)
        assert (rows(totals), rows(upkeep.elements(contents), "entity", "element", "weight")) == want
        state = new
    assert totals.count() == contents.count() == 0


def test_deltas_add_up_in_any_order(spark):
    rng = random.Random(2)
    states = [{}]
    for _ in range(3):
        states.append(changed(rng, states[-1], 25))
    steps = [upkeep.total_deltas(upkeep.signed(listing(spark, a), listing(spark, b))) for a, b in zip(states, states[1:], strict=False)]
    none = spark.createDataFrame([], upkeep.SCHEMAS["totals"])
    sums = none
    for d in (steps[2], steps[0], steps[1]):
        sums = sums.unionByName(d)
    assert rows(upkeep.merge_totals(none, sums)) == full(listing(spark, states[-1]))[0]


def test_only_files_that_came_or_changed_are_read(spark, tmp_path):
    state = {f"/d/{i % 3}/f{i}": (10 + i % 2, 100, f"h{i % 4}") for i in range(12)}
    seen, hashes = [], {}

    def hashed(df):
        seen.append(sorted(r[0] for r in rows(df, "canonical_path")))
        hash_of = F.create_map(*(F.lit(x) for p, h in hashes.items() for x in (p, h)))
        return df.withColumn("content_hash", F.get(F.map_values(F.map_filter(hash_of, lambda k, v: k == F.col("canonical_path"))), F.lit(0)))

    def bring_up(s):
        hashes.clear()
        hashes.update({p: v[2] for p, v in s.items()})
        found = upkeep.follow(spark, listing(spark, s).drop("content_hash"), str(tmp_path / "state"), hashed)
        assert (rows(found["totals"]), rows(upkeep.elements(found["contents"]), "entity", "element", "weight")) == full(listing(spark, s))
        return s

    bring_up(state)
    bring_up(state)
    later = {p: v for p, v in state.items() if p != "/d/0/f0"} | {"/d/1/f1": (11, 101, "h9"), "/e/new": (3, 5, "h0")}
    bring_up(later)
    assert seen == [sorted(state), [], ["/d/1/f1", "/e/new"]]
    # a run that breaks off leaves the last generation, and the next one starts from it
    with pytest.raises(ZeroDivisionError):
        upkeep.follow(spark, listing(spark, state).drop("content_hash"), str(tmp_path / "state"), lambda df: 1 / 0)
    (tmp_path / "state/g4/totals").mkdir(parents=True)
    assert upkeep.generation(spark, str(tmp_path / "state")) == 3
    bring_up(state)
    assert upkeep.generation(spark, str(tmp_path / "state")) == 4


def test_sketches_are_exact_below_k_and_close_above(spark):
    rng = random.Random(3)
    files = [(f"/{rng.choice('ab')}/{rng.choice('xy')}/f{i}", 1, 0, f"h{rng.randrange(30_000)}") for i in range(40_000)] + [("/n/f", 1, 0, None)]
    df = located(spark.createDataFrame(files, COLUMNS))
    want = {}
    for p, _, _, h in files[:-1]:
        parts = p.split("/")[:-1]
        for k in range(1, len(parts) + 1):
            want.setdefault("/".join(parts[:k]) or "/", set()).add(h)
    pairs = [(a, b) for a in want for b in want if a < b]
    asked = spark.createDataFrame(pairs, "path_a string, path_b string")
    for log_k, error in ((16, 0), (10, 4 / 1023**0.5)):
        made = sketches.directory_sketches(df, log_k)
        got = {r["path"]: r["hashes"] for r in sketches.distinct_content(made).collect()}
        assert got.keys() == want.keys()
        for p, n in got.items():
            assert abs(n - len(want[p])) <= error * len(want[p])
        for r in sketches.shared_content(made, asked, log_k).collect():
            a, b = want[r["path_a"]], want[r["path_b"]]
            allowed = 4 * (len(a | b) / len(a & b) / 2**log_k) ** 0.5 * len(a & b) if error else 0
            assert abs(r["shared"] - len(a & b)) <= allowed
            assert abs(r["score"] - len(a & b) / len(a | b)) <= (0.15 if error else 1e-9)


def test_sketches_are_united_with_what_is_stored(spark):
    some = located(spark.createDataFrame([("/a/f", 1, 0, "x"), ("/a/g", 1, 0, "y")], COLUMNS))
    more = located(spark.createDataFrame([("/a/h", 1, 0, "y"), ("/b/h", 1, 0, "z")], COLUMNS))
    both = sketches.merge(sketches.directory_sketches(some).unionByName(sketches.directory_sketches(more)))
    assert rows(sketches.distinct_content(both)) == [("/", 3), ("/a", 2), ("/b", 1)]
    assert rows(sketches.distinct_content(sketches.directory_sketches(some.where("1 = 0")))) == []


def many_hashes(spark):
    """Files of three directories: two of more than 64 distinct hashes, one of fewer."""
    files = [(f"/{d}/{x}/f{i}", 1, 0, f"h{i * k % n}") for d, x, k, n in (("a", "x", 1, 500), ("a", "y", 3, 700), ("b", "z", 1, 20)) for i in range(900)] + [("/n/f", 1, 0, None)]
    want = {}
    for p, _, _, h in files[:-1]:
        parts = p.split("/")[:-1]
        for k in range(1, len(parts) + 1):
            want.setdefault("/".join(parts[:k]) or "/", set()).add(h)
    return located(spark.createDataFrame(files, COLUMNS)), want


def test_counts_are_exact_beyond_the_sketch(spark):
    df, want = many_hashes(spark)
    made = sketches.directory_sketches(df, 6)
    assert rows(sketches.exact_content(df, made, 6)) == sorted((p, len(s)) for p, s in want.items())
    assert rows(sketches.distinct_content(made)) != rows(sketches.exact_content(df, made, 6))


def test_overlaps_are_exact_beyond_the_sketch(spark):
    df, want = many_hashes(spark)
    made = sketches.directory_sketches(df, 6)
    pairs = [(a, b) for a in want for b in want if a < b]
    got = sketches.exact_shared(df, made, spark.createDataFrame(pairs, "path_a string, path_b string"), 6)
    size = lambda a, b: (len(want[a]), len(want[b]), len(want[a] & want[b]))
    expected = [(a, b, x, y, n, n / (x + y - n), n / min(x, y)) for a, b in pairs for x, y, n in [size(a, b)]]
    assert rows(got, "path_a", "path_b", "n_a", "n_b", "shared", "score", "contained") == sorted(expected)
