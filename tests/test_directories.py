"""Hierarchy and similarity on literal rows, with the exact results that follow from their definitions."""

import random

import pytest
from helpers import files, rows
from pyspark.sql import functions as F

from twinsieve.operators import similarity as sim
from twinsieve.operators import tree

A2 = (("/root/sub1/a.txt", 100, 111), ("/root/sub1/b.txt", 200, 222), ("/root/sub2/c.txt", 300, 333))


def pairs(df, **how):
    got = sim.set_similarity(tree.directory_elements(df), all_pairs=True, **how).collect()
    return {(r["entity_a"], r["entity_b"]): (round(r["score"], 6), r["shared_weight"], r["match_type"]) for r in got}


def test_nothing(spark):
    none = files(spark)
    assert rows(tree.directory_tree(none)) == [] and rows(tree.directory_sets(none)) == [] and pairs(none) == {}


def test_nested_totals_and_sets(spark):
    df = files(spark, *A2)
    assert rows(tree.directory_tree(df), "path", "parent", "depth", "file_count", "total_size") == [
        ("/", None, 1, 3, 600), ("/root", "/", 2, 3, 600), ("/root/sub1", "/root", 3, 2, 300), ("/root/sub2", "/root", 3, 1, 300),
    ]
    sets = dict(rows(tree.directory_sets(df)))
    assert sets["/root"] == ["111", "222", "333"]
    assert [r[0] for r in tree.children(tree.directory_tree(df), "/root").select("path").collect()] == ["/root/sub1", "/root/sub2"]
    assert pairs(df) == {("/", "/root"): (1.0, 600, "exact"), ("/", "/root/sub1"): (0.666667, 300, "subset"), ("/root", "/root/sub1"): (0.666667, 300, "subset")}


def test_fingerprints_do_not_depend_on_order_or_partitions(spark):
    df = files(spark, ("/d/x", 1, 333), ("/d/y", 2, 111), ("/d/z", 3, 222))
    a = rows(tree.fingerprints(tree.directory_sets(df)))
    assert a == rows(tree.fingerprints(tree.directory_sets(df.orderBy(F.desc("file_size")).repartition(7))))


def test_equal_directories(spark):
    df = files(spark, *[(f"/dir_{d}/{n}.txt", s, h) for d in "ab" for n, s, h in (("x", 100, 111), ("y", 200, 222))])
    assert set(pairs(df).values()) == {(1.0, 300, "exact")} and len(pairs(df)) == 3
    found = sim.set_similarity(tree.directory_elements(df), all_pairs=True)
    assert sim.without_nested_pairs(found, strict_prefix=False).count() == 0
    assert list(pairs(df, exclude_nested=True)) == [("/dir_a", "/dir_b")]


def test_partial_overlap(spark):
    df = files(spark, ("/dir_a/s", 100, 111), ("/dir_a/u", 200, 222), ("/dir_b/s", 100, 111), ("/dir_b/u", 200, 333))
    assert pairs(df, threshold=0.1) == {("/", "/dir_a"): (0.666667, 300, "subset"), ("/", "/dir_b"): (0.666667, 300, "subset"), ("/dir_a", "/dir_b"): (0.333333, 100, "threshold")}


def test_below_threshold(spark):
    df = files(spark, *[(f"/dir_a/{h}", 100, h) for h in (1, 2, 3, 10)], *[(f"/dir_b/{h}", 100, h) for h in (4, 5, 6, 10)])
    assert pairs(df) == {("/", "/dir_a"): (0.571429, 400, "subset"), ("/", "/dir_b"): (0.571429, 400, "subset")}


X4 = (("/p/a/f", 10, 1), ("/p/b/f", 10, 1), ("/q/c/f", 10, 1), ("/q/c/g", 5, 2), ("/q/d/g", 5, 2), ("/q/d/k", 7, 3))
EQUAL = {("/p", "/p/a"): 10, ("/p", "/p/b"): 10, ("/p/a", "/p/b"): 10}


@pytest.mark.parametrize(
    ("cap", "scored"),
    [
        (2, {}),
        (3, {("/", "/q"): (1.0, 22, "exact"), ("/", "/q/d"): (0.666667, 12, "subset"), ("/q", "/q/d"): (0.666667, 12, "subset")}),
        (4, {("/", "/q"): (1.0, 22, "exact"), ("/", "/q/d"): (0.666667, 12, "subset"), ("/q", "/q/d"): (0.666667, 12, "subset"), ("/", "/q/c"): (0.666667, 15, "subset"), ("/q", "/q/c"): (0.666667, 15, "subset"), ("/q/c", "/q/d"): (0.333333, 5, "threshold")}),
    ],
)
def test_frequency_cap(spark, cap, scored):
    e = tree.directory_elements(files(spark, *X4))
    got = sim.scored(e, max_frequency=cap).where("score >= 0.3").collect()
    assert rows(sim.candidate_overlaps(e, cap), "entity_a", "entity_b", "shared", "shared_weight") == rows(sim.overlaps(e, sim.candidate_pairs(e, cap)), "entity_a", "entity_b", "shared", "shared_weight")
    assert {(r["entity_a"], r["entity_b"]): (round(r["score"], 6), r["shared_weight"], r["match_type"]) for r in got} == scored
    every = pairs(files(spark, *X4), threshold=0.3, max_frequency=cap)
    by_print = {k: v[1] for k, v in every.items() if k not in scored}
    assert by_print == (EQUAL | {("/", "/q"): 22} if cap == 2 else EQUAL)


def test_cap_of_50_finds_all(spark):
    got = pairs(files(spark, *X4), threshold=0.3)
    kinds = [v[2] for v in got.values()]
    assert len(got) == 18 and (kinds.count("exact"), kinds.count("subset"), kinds.count("threshold")) == (4, 13, 1)


def test_nested_pairs_strict(spark):
    p = spark.createDataFrame([("/a", "/b"), ("/a/x", "/b/y"), ("/ab", "/c")], "entity_a string, entity_b string")
    assert rows(sim.without_nested_pairs(p)) == [("/a", "/b"), ("/ab", "/c")]
    assert rows(sim.without_nested_pairs(p, strict_prefix=False)) == [("/a", "/b")]


def test_diff(spark):
    df = files(spark, ("/l/1", 1, 11), ("/l/2", 1, 22), ("/l/3", 1, None), ("/r/1", 1, 11), ("/r/3", 1, None))
    d = sim.directory_diff(df, "/l", "/r")
    assert rows(sim.diff_summary(d)) == [(1, 2, 1, 40.0)]
    assert rows(sim.diff_summary(sim.directory_diff(df, "/no", "/none"))) == [(0, 0, 0, 0.0)]


def test_relative_and_bare_paths(spark):
    df = files(spark, ("a/b/f", 1, 1), ("f", 2, 2))
    assert {r[0] for r in tree.directory_nodes(df).select("path").collect()} == {"/", "a", "a/b"}


def test_uncapped_similarity_and_what_a_cap_loses(spark):
    """Without a cap the pairs are those of all sets against all; the cap loses pairs that share only frequent elements."""
    rng = random.Random(4)
    sets = {f"/s{i}": {f"e{rng.randrange(12) if rng.random() < 0.6 else rng.randrange(12, 200)}" for _ in range(rng.randrange(1, 9))} for i in range(60)}
    e = spark.createDataFrame([(k, x, 1) for k, s in sets.items() for x in s], "entity string, element string, weight long")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    found = lambda cap: {(r[0], r[1]) for r in rows(sim.scored(e, max_frequency=cap).where("score >= 0.3"), "entity_a", "entity_b")}
    assert found(None) == want
    capped = found(5)
    assert capped < want and len(capped) / len(want) < 1  # the recall of a cap of 5 on such sets
    assert found(50) == want


def test_equal_sets_as_classes(spark):
    e = spark.createDataFrame([(f"/d{i}", x, 1) for i in range(30) for x in ("a", "b")] + [("/x", "a", 1)], "entity string, element string, weight long")
    assert rows(sim.equal_classes(e), "entity", "representative", "members") == sorted((f"/d{i}", "/d0", 30) for i in range(30))
    assert len(rows(sim.equal_sets(e), "entity_a", "entity_b")) == 29
    assert len(rows(sim.equal_sets(e, all_pairs=True), "entity_a", "entity_b")) == 30 * 29 // 2
    star = rows(sim.set_similarity(e, 0.9, max_frequency=2), "entity_a", "entity_b", "score", "match_type")
    assert star == sorted(("/d0", f"/d{i}", 1.0, "exact") for i in range(1, 30))


def test_sets_are_dealt_by_their_number_of_rows(spark, monkeypatch):
    """Parts of set_prints come from the rows, not from a setting, and no table is kept before rows are dealt."""
    monkeypatch.setattr(sim, "PART", 50)
    e = spark.createDataFrame([(f"/d{i}", f"h{j}", 1) for i in range(30) for j in range(10)], "entity string, element string, weight long").repartition(3)
    plan = sim.set_prints(e)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "7), REPARTITION" in plan
    assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM") :]
    assert rows(sim.equal_classes(e), "entity", "representative", "members") == sorted((f"/d{i}", "/d0", 30) for i in range(30))


def test_pairs_are_counted_without_a_row_for_each_element(spark, monkeypatch):
    """What is sent for pairs: rows by (element, entity), not by (element, pair); an entity of many elements comes in parts."""
    monkeypatch.setattr(sim, "PIECE", 20)
    rng = random.Random(12)
    sets = {f"e{i:02}": {f"x{rng.randrange(60)}" for _ in range(30)} for i in range(20)}
    e = spark.createDataFrame([(k, x, len(k) + int(x[1:])) for k, s in sets.items() for x in s], "entity string, element string, weight long").repartition(3)
    want = sorted((a, b, len(sets[a] & sets[b]), sum(3 + int(x[1:]) for x in sets[a] & sets[b])) for a in sets for b in sets if a < b)
    for cap in (100, 10):  # below it all elements, above it the frequent ones are looked up
        few = {x for x in set().union(*sets.values()) if sum(x in s for s in sets.values()) <= cap}
        linked = [w for w in want if sets[w[0]] & sets[w[1]] & few]
        assert rows(sim.candidate_overlaps(e, cap), "entity_a", "entity_b", "shared", "shared_weight") == linked
    plan = sim._pairs_of_lists(e)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "Exchange hashpartitioning(entity_a" in line]
    assert len(sent) == 1 and "part#" in sent[0] and "entity_b" not in sent[0]


def test_pairs_of_blocks_are_those_of_all_sets(spark, monkeypatch):
    """Blocks, parts, and sorting in pieces give what looking up each pair gives; a frequent element or none, sent or joined;
    rows with null entities, elements and weights, and sets without a weight."""
    rng = random.Random(21)
    some = [(f"e{rng.randrange(25):02}" if i % 40 else None, f"x{rng.randrange(70)}" if i % 37 else None, rng.choice((None, 0, 3, 9))) for i in range(700)]
    some = list({r[:2]: r for r in some + [("big", f"x{i}", 5) for i in range(70)] + [("few", f"x{i}", None) for i in range(4)]}.values())
    e = spark.createDataFrame(some, "entity string, element string, weight long").repartition(3)
    names = ("entity_a", "entity_b", "shared", "shared_weight")
    want = {cap: rows(sim.overlaps(e, sim.candidate_pairs(e, cap)), *names) for cap in (9, 40)}
    for piece, part, most, frequent in ((20, 1000, 50, 100), (60, 20, 7, 1)):
        for name, value in (("PIECE", piece), ("PART", part), ("SORTED", most), ("FREQUENT", frequent)):
            monkeypatch.setattr(sim, name, value)
        for cap in want:
            assert rows(sim.candidate_overlaps(e, cap), *names) == want[cap], (piece, cap)
    assert rows(sim.candidate_overlaps(e.drop("weight"), 9), *names) == [(a, b, n, n) for a, b, n, _ in want[9]]
    high = {(r.entity_a, r.entity_b, r.score) for r in sim.scored(e, max_frequency=9).where("score >= 0.2").collect()}
    assert high and {(r.entity_a, r.entity_b, r.score) for r in sim.scored(e, max_frequency=9, least=0.2).where("score >= 0.2").collect()} == high


def test_pairs_that_fall_short_are_not_written(spark, monkeypatch):
    """Pairs below the threshold end where they are counted."""
    written = {}
    stash = sim.stash

    def counting(df, name):
        out = stash(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(sim, "stash", counting)
    sets = {f"/s{i:02}": {"all", f"own{i // 2}", f"own{i // 2}+", *(f"x{j}" for j in range(30) if (i * j) % 7 == 1)} for i in range(40)}
    e = spark.createDataFrame([(k, x, 1) for k, s in sets.items() for x in s], "entity string, element string, weight long")
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b] - {"all"}}
    want = {k: v for k, v in alike.items() if v >= 0.95}
    found = {(r.entity_a, r.entity_b): r.score for r in sim.set_similarity(e, 0.95, 39).where("score < 1").collect()}
    assert {k for k, v in want.items() if v < 1} == set(found)
    assert written["pair_counts"] < len(alike) / 4
