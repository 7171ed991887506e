"""Running numbers in two levels, and caches, trees, pages, searches and codes built on joins, against plain loops."""

import random

import pytest
from helpers import files, rows
from pyspark.sql import functions as F

from twinsieve.operators import groups, hamming, review, running, tree, trigrams


def test_running_totals(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, *range(20)]), i, rng.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(data, "a long, b long, v long").repartition(5)
    got = {r["b"]: r["before"] for r in running.running(df, [F.col("a").desc_nulls_last(), F.col("b").asc()], F.col("v")).collect()}
    want, total = {}, 0
    for a, b, v in sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        want[b] = total
        total += v or 0
    assert got == want
    assert running.running(df.where("1 = 0"), [F.col("b").asc()]).collect() == []


@pytest.mark.parametrize("budget", [0, 1, 37, 400, 10_000])
def test_a_cache_keeps_what_was_used_last(spark, budget):
    rng = random.Random(2)
    cache = [(f"/f{i:03}", rng.choice([None, 5, 6, 7]), rng.choice([0, 1, 3, 9])) for i in range(120)]
    df = spark.createDataFrame(cache, "canonical_path string, last_used long, size long")
    want, total = [], 0
    for p, t, n in sorted(cache, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])):
        total += n
        if total > budget:
            break
        want.append(p)
    assert [r[0] for r in rows(running.trim(df, budget, F.col("size")), "canonical_path")] == sorted(want)
    kept = running.trim(running.touch(df, df.where("canonical_path = '/f007'"), F.lit(99)), 1)
    assert rows(kept, "canonical_path", "last_used") == [("/f007", 99)]


def test_subtrees_are_ranges(spark, tmp_path):
    rng = random.Random(3)
    names = ["a", "a-x", "a.b", "b", "c d", "é"]
    paths = sorted({"/" + "/".join(rng.choice(names) for _ in range(rng.randrange(0, 5))) for _ in range(60)})
    df = files(spark, *[(f"{p if p != '/' else ''}/f{i}", i % 7, None) for i, p in enumerate(paths)])
    numbers = running.numbered_tree(df)
    found = {r["path"]: (r["first"], r["last"]) for r in numbers.collect()}
    assert sorted(f for f, _ in found.values()) == list(range(1, len(found) + 1))
    below = lambda p: {q for q in found if p == "/" or q == p or q.startswith(p + "/")}
    for p, (first, last) in found.items():
        assert {q for q, (f, _) in found.items() if first <= f <= last} == below(p)
    assert rows(running.subtree_totals(running.numbered_files(df, numbers), numbers)) == rows(tree.directory_tree(df), "path", "file_count", "total_size")
    own = running.numbered_files(df, numbers)
    for p in ("/a", "/b", "/a/b", "/none"):
        assert rows(running.in_subtree(own, numbers, p), "canonical_path") == rows(review.mark_subtree(df, p), "canonical_path")
    own.repartitionByRange(4, "node").sortWithinPartitions("node").write.parquet(f"{tmp_path}/files")
    plan = running.in_subtree(spark.read.parquet(f"{tmp_path}/files"), numbers, "/a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(node" in plan.split("PushedFilters")[1]
    relative = files(spark, ("a/b/f", 1, None), ("f", 2, None))
    assert {r["path"] for r in running.numbered_tree(relative).collect()} == {"/", "a", "a/b"}


def test_a_page_reads_at_most_two_files(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.col("id").alias("v"))
    order = [F.desc("k"), F.asc("v")]
    running.write_pages(df, order, str(tmp_path / "p"), 1_000)
    for offset, limit in ((0, 50), (990, 50), (10_000, 1), (19_990, 50), (30_000, 10)):
        got = running.read_page(spark, str(tmp_path / "p"), order, offset, limit)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in groups.page(df, order, offset, limit).collect()]
        assert len(got.inputFiles()) <= 2 or offset >= 20_000
    running.write_pages(df.where("k < 0"), order, str(tmp_path / "none"))
    assert running.read_page(spark, str(tmp_path / "none"), order, 0, 5).collect() == []


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "a_b", "100%", "ABCD", "\\x", "straße", "ÉTÉ", "nothing at all", "aaaa"])
def test_trigrams_find_what_a_scan_finds(spark, tmp_path, text):
    names = ["abcd", "xABCy", "a_b", "axb", "100%", "1000", "\\x", "a\\xb", "STRASSE", "straße", "été", "Été", "aaaa", "aaa", "ab", "b", "", None]
    df = spark.createDataFrame([(f"/p{i}", n) for i, n in enumerate(names)], "canonical_path string, file_name string")
    trigrams.write_index(trigrams.trigram_index(df, "file_name"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    from twinsieve.functions.scalars import like_pattern

    want = rows(df.where(F.col("file_name").ilike(like_pattern(text))), "canonical_path")
    assert rows(trigrams.search(df, index, text, "file_name"), "canonical_path") == want


@pytest.mark.parametrize(("radius", "most"), [(0, 1000), (3, 1000), (3, 2), (7, 5), (12, 3)])
def test_near_codes(spark, radius, most):
    rng = random.Random(radius)
    codes, base = [], [rng.getrandbits(64) for _ in range(6)]
    for i in range(160):  # most codes share their high half, a hot band at any width
        c = rng.choice(base) if rng.random() < 0.6 else (base[0] >> 32 << 32) | rng.getrandbits(32)
        for _ in range(rng.randrange(0, 10)):
            c ^= 1 << rng.randrange(64)
        codes.append((i, c - (1 << 64) if c >> 63 else c))
    df = spark.createDataFrame([*codes, (500, codes[0][1]), (None, 5), (501, None)], "id long, code long")
    pairs, members = hamming.near_codes(df, radius, most)
    distinct = sorted({c for _, c in codes})
    want = [(a, b, (a ^ b & (1 << 64) - 1).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    want = [(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a, b, _ in want]
    assert rows(pairs) == want
    assert rows(members, "id", "code") == sorted([*codes, (500, codes[0][1])])


def test_hot_bands_are_dealt_again(spark):
    codes = spark.range(3_000).select((F.lit(0x1234 << 48) + F.col("id") * 0x9E3779B1).alias("code"))
    for most, largest in ((100_000, 3_000), (50, 600)):
        sizes = hamming.keys(codes, 3, most).groupBy("mask", "value").count()
        assert sizes.agg(F.max("count")).first()[0] <= largest
    with pytest.raises(ValueError, match="radius"):
        hamming.near_codes(codes.withColumn("id", F.col("code")), 64)


def test_codes_of_signs(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([-1.0, 2.0],), (None,)], "v array<float>")
    planes = [[1, 0], [0, 1], [1, 1]]
    got = [r[0] for r in df.select(hamming.sign_codes(F.col("v"), planes)).collect()]
    assert got == [-(1 << 63), 0b011 << 61, None]


def test_narrow_bands_are_compared_in_tiles(spark, monkeypatch):
    """At radius 11 a code has 12 keys, however many codes there are; a hot key is compared a tile at a time."""
    monkeypatch.setattr(hamming, "BLOCK", 40)
    rng = random.Random(5)
    near = [rng.getrandbits(63) for _ in range(40)]
    own = sorted({c ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for c in near for _ in range(8)} | {rng.getrandbits(63) for _ in range(80)})
    codes = spark.createDataFrame([(c,) for c in own], "code long")
    assert hamming.keys(codes, 11, 5).groupBy("code").count().agg(F.max("count")).first()[0] <= 12
    want = [(a, b, n) for i, a in enumerate(own) for b in own[i + 1 :] if (n := (a ^ b).bit_count()) <= 11]
    assert rows(hamming.near_codes(codes.withColumn("id", F.col("code")), 11, 5)[0]) == want
