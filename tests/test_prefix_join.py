"""The exact join against all pairs."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from twinsieve.operators import prefix_join, similarity

SF = "/root/testdata/sf0.001"


def frame(spark, sets):
    return spark.createDataFrame([(e, x, 1) for e, s in sets.items() for x in s], "entity string, element string, weight long").repartition(3)


def random_sets(seed, n=80):
    """Sets of which many are near copies, and some elements are in nearly all."""
    rng, out = random.Random(seed), {}
    base = [{f"x{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60]))} for _ in range(12)]
    for i in range(n):
        s = {x for x in rng.choice(base) if rng.random() < rng.choice([0.7, 0.9, 1])} | {f"y{rng.randrange(2000)}" for _ in range(rng.choice([0, 0, 1, 3]))}
        if rng.random() < 0.8:
            s |= {"everywhere", "nearly"} if rng.random() < 0.7 else {"everywhere"}
        if s:
            out[f"e{i:03}"] = s
    return out


def brute(sets, threshold):
    names = sorted(sets)
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return [(a, b, s) for i, a in enumerate(names) for b in names[i + 1 :] if (s := score(a, b)) >= threshold]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.6, 0.8, 0.9, 1.0])
def test_all_pairs(spark, threshold):
    sets = random_sets(int(threshold * 10))
    pairs, classes = prefix_join.exact_similarity(frame(spark, sets), threshold)
    assert rows(prefix_join.expanded(pairs, classes)) == brute(sets, threshold)
    first = {}
    for e in sorted(sets):
        first.setdefault(frozenset(sets[e]), e)
    alone = {e: sets[e] for e in first.values()}
    assert rows(pairs, "entity_a", "entity_b", "score") == brute(alone, threshold)


def test_as_without_a_cap_on_lineitem(spark):
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("element"), F.lit(1).cast("long").alias("weight")).distinct()
    want = rows(similarity.scored(parts, max_frequency=None).where("score >= 0.2"), "entity_a", "entity_b", "shared", "score")
    pairs, classes = prefix_join.exact_similarity(parts, 0.2)
    assert rows(pairs, "entity_a", "entity_b", "shared", "score") == want and classes.count() == 0 and want


def test_the_join_has_far_fewer_rows(spark):
    sets = random_sets(3, 200)
    df = frame(spark, sets)
    all_rows = similarity._ordered_pairs(df).count()
    smaller, larger = prefix_join.prefixes(df, 0.8)
    joined = smaller.alias("x").join(larger.alias("y"), ["interval", "element"]).count()
    assert joined * 5 < all_rows


def test_places_are_one_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_join, "BANDS", 3)
    sets = random_sets(5, 60)
    got = {}
    for e, x, n, p in rows(prefix_join.ordered(frame(spark, sets)), "entity", "element", "n", "place"):
        got.setdefault(e, []).append((p, x))
        assert n == len(sets[e])
    position, often = {}, {}
    for s in sets.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    for e, own in got.items():
        assert [p for p, _ in sorted(own)] == list(range(1, len(sets[e]) + 1))
        powers = [often[x].bit_length() for _, x in sorted(own)]
        assert powers == sorted(powers)  # rare elements first
        for (_, a), (_, b) in zip(sorted(own), sorted(own)[1:], strict=False):
            assert position.setdefault((a, b), True) and (b, a) not in position  # and the same order in all sets


def test_edges(spark):
    none = frame(spark, {"a": {"x"}}).where("1 = 0")
    pairs, classes = prefix_join.exact_similarity(none, 0.5)
    assert pairs.count() == 0 and classes.count() == 0
    odd = spark.createDataFrame([("a", "x", 1), ("b", None, 1), (None, "x", 1), ("c", "x", 1), ("d", "x", 1), ("d", "y", 1)], "entity string, element string, weight long")
    pairs, classes = prefix_join.exact_similarity(odd, 0.5)
    assert rows(pairs, "entity_a", "entity_b", "score") == [("a", "d", 0.5)] and rows(classes) == [("a", "a", 2), ("c", "a", 2)]
    with pytest.raises(ValueError, match="threshold"):
        prefix_join.candidates(none, 0)


def test_no_window_spans_a_whole_set(spark):
    """Windows over rows of elements are within a band; windows over an entity see a row a band."""
    plan = prefix_join.ordered(frame(spark, random_sets(1)))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    windows = [line for line in plan.split("\n") if "Window [row_number()" in line]
    assert windows and all("power" in line and "band" in line for line in windows)


def test_small_sets_are_compared_where_they_meet(spark):
    """Sets of four of which many share one frequent element and few share two: only those become candidates."""
    rng = random.Random(9)
    sets = {f"e{i:03}": {f"x{rng.randrange(60)}" for _ in range(4)} for i in range(150)}
    got = rows(prefix_join.candidates(frame(spark, sets), 0.3).distinct())
    reach = [(a, b) for i, a in enumerate(sorted(sets)) for b in sorted(sets)[i + 1 :] if len(sets[a] & sets[b]) >= 0.3 / 1.3 * (len(sets[a]) + len(sets[b])) - 1e-9]
    assert set(got) <= set(reach) and {p[:2] for p in brute(sets, 0.3) if p[2] < 1} <= set(got)


def test_hashes_that_agree_lose_no_pair(spark, monkeypatch):
    real = prefix_join.F.hash
    monkeypatch.setattr(prefix_join.F, "hash", lambda col: real(col) % 3)
    sets = random_sets(4)
    pairs, classes = prefix_join.exact_similarity(frame(spark, sets), 0.4)
    assert rows(prefix_join.expanded(pairs, classes)) == brute(sets, 0.4)
