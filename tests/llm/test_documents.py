"""Operators that judge, mix or search documents."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import decontaminate as dec
from twinsieve.llm import minhash, mixing, ngram_join, queries
from twinsieve.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIDE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 1, quality rules


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, edge_docs, sf, plain):
    for docs in (edge_docs, spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted(((r["doc_id"], *measures(r["text"])) for r in docs.collect()), key=str)
        assert sorted((tuple(r) for r in rules.measured(docs).select("doc_id", *rules.MEASURES[:5]).collect()), key=str) == want


def test_verdicts(spark, edge_docs, no_docs, sf):
    got = rules.quality_rules(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert rules.quality_rules(no_docs).collect() == []
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    own = [r for r in queries.queries()["op1_quality_rules"](spark, sf).collect() if not r["base_failed"] and r["doc_id"] in labels]
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in own]) > 0.97


def test_verdicts_by_loops(spark, sf):
    """The posterior and the verdict of every row, by expectation-maximisation in plain loops over rows."""
    names = [f"vote_{r.name}" for r in rules.default_rules()]
    rows = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    votes = [[r[n] for n in names] for r in rows]
    good, on_good, on_bad = 0.9, [0.97] * len(names), [0.3] * len(names)
    strength, clip = max(10.0, 0.01 * len(rows)), lambda x, lo, hi: min(max(x, lo), hi)

    def posterior(v):
        odds = math.log(good / (1 - good))
        for k, x in enumerate(v):
            odds += math.log(on_good[k] / (1 - on_bad[k])) if x > 0 else -math.log(on_bad[k] / (1 - on_good[k])) if x < 0 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(500):
        post, new_good, new_bad = [posterior(v) for v in votes], [], []
        for k in range(len(names)):
            up_g, down_g = (sum(p for p, v in zip(post, votes, strict=True) if v[k] == x) for x in (1, -1))
            up_b, down_b = (sum(1 - p for p, v in zip(post, votes, strict=True) if v[k] == x) for x in (1, -1))
            new_good.append(clip((up_g + 0.97 * strength) / (up_g + down_g + strength), 0.5, 0.9995))
            new_bad.append(clip((down_b + 0.3 * strength) / (up_b + down_b + strength), 1.02 - new_good[k], 0.99))
        share = clip((sum(post) + 1) / (len(rows) + 2), 0.05, 0.99)
        moved = max(abs(share - good), *(abs(a - b) for a, b in zip(new_good + new_bad, on_good + on_bad, strict=True)))
        good, on_good, on_bad = share, new_good, new_bad
        if moved < 1e-9:
            break
    for r, v in zip(rows, votes, strict=True):
        assert r["quality"] == pytest.approx(posterior(v), abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    on_good, on_bad, y = np.array([0.99, 0.95, 0.97, 0.9]), np.array([0.6, 0.8, 0.5, 0.7]), rng.random(100_000) < 0.8
    says_good = rng.random((len(y), 4)) < np.where(y[:, None], on_good, 1 - on_bad)
    votes = np.where(rng.random(says_good.shape) < 0.9, np.where(says_good, 1, -1), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    got = rules.fit(patterns.astype(float), counts.astype(float), prior_strength=1e-4)
    assert abs(got.good - 0.8) < 0.03 and abs(got.on_good - on_good).max() < 0.03 and abs(got.on_bad - on_bad).max() < 0.05
    assert rules.fit(np.zeros((0, 4)), np.zeros(0)).good == 0.9


# 2, mixing


def test_mix(spark, edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and mixing.mix(no_docs).collect() == []
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in edge_docs.collect() if r["doc_id"] is not None)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(t["words"] for t in r["takes"])
        assert all(0 <= t["position"] < 1 for t in r["takes"])
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] for s in target)
    again = mixing.mix(edge_docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_shifts_sources_in_time(spark):
    docs = spark.createDataFrame([(i, "a b c d", f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    order = mixing.training_order(mixing.mix(docs)).join(docs.select("doc_id", "source"), "doc_id").orderBy("position").collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    early = Counter(r["source"] for r in order if r["position"] < 0.5)
    every = Counter(r["source"] for r in order)
    share = {s: early[s] / every[s] for s in every}  # demand at half time: 1/2 - slope / 8
    assert share["s0"] == pytest.approx(0.625, abs=0.01) and share["s1"] == pytest.approx(0.5, abs=0.01) and share["s2"] == pytest.approx(0.375, abs=0.01)


# 7, decontamination

BENCH = [("b1", "One two three four five six seven eight nine TEN eleven"), ("b2", "short item"), ("b3", None), ("b4", "..."), (None, "four five six seven eight nine ten eleven twelve thirteen"), ("b1", "short, item")]
TEXTS = [
    (1, "x one, two three four five six seven eight nine ten y"), (2, "a short Item; here"), (3, None), (4, "one two three four five six seven eight nine"), (5, "shortitem"), (None, "short item short item"),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen"),
]


def brute(texts, bench, size=10):
    items = defaultdict(set)
    for i, t in bench:
        w = SIDE.findall((t or "").translate(LOW))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            items[tuple(w[k : k + n])].add(i or "")
    out = []
    for i, t in texts:
        w, hit, found = SIDE.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in items}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in items:
                    hit |= set(range(k, k + n))
                    found |= items[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.fixture
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


@pytest.mark.parametrize("most", [200_000, 2])
def test_scan(spark, edge_docs, bench, plain, monkeypatch, most):
    monkeypatch.setattr(dec, "BLOCK_WINDOWS", most)
    index = dec.build_index(bench)
    assert (len(index) > 1) == (most == 2)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = sorted(brute(TEXTS, BENCH), key=str)
    assert sorted((tuple(r) for r in dec.scan(docs, index).collect()), key=str) == want
    edge = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted((tuple(r) for r in dec.scan(edge_docs, index).collect()), key=str) == sorted(brute(edge, BENCH), key=str)


def test_common_window_and_small_caches(spark, monkeypatch):
    """A window that all items have, many blocks, few lookups at once."""
    monkeypatch.setattr(dec, "BLOCK_WINDOWS", 40)
    monkeypatch.setattr(dec, "PASSED", 3)
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(f"i{k:03d}", f"{common} own{k} words{k}") for k in range(150)] + [("i007", common), ("none", None)]
    texts = [(1, f"x {common} y"), (2, f"{common} own3 words3 {common}"), (3, "nothing here"), (4, None), (5, (common + " own9 ") * 500)]
    index = dec.build_index(spark.createDataFrame(items, "item_id string, text string").repartition(4))
    assert len(index) > 5
    got = sorted((tuple(r) for r in dec.scan(spark.createDataFrame(texts, "doc_id long, text string"), index).collect()), key=str)
    assert got == sorted(brute(texts, items), key=str)


def test_the_filter_passes_few_and_blocks_are_loaded_seldom(spark, monkeypatch):
    """Six blocks, many batches: blocks stay in the worker, and below that a block is loaded only for windows that pass."""
    monkeypatch.setattr(dec, "BLOCK_WINDOWS", 400)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(f"i{k}", " ".join(word() for _ in range(33))) for k in range(100)]
    index = dec.build_index(spark.createDataFrame(items, "item_id string, text string").repartition(3))
    assert len(index) == 6
    reader = dec.IndexReader(index)
    h = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    assert len(reader.maybe(h)) / len(h) < 0.005
    for most, loads in ((1 << 30, 6), (0, None)):
        monkeypatch.setattr(dec, "HELD_BYTES", most)
        reader = dec.IndexReader(index)
        for batch in range(40):
            hits = dec._Hits(reader)
            for _ in range(50):  # a window of an item, and windows that are in none
                words = items[batch % 100][1].split()[:10]
                b = next(dec.blocks(pa.array([" ".join(words + [word() for _ in range(20)])])))
                w = dec.Words(b, dec.ALNUM, lower=True)
                at, own = dec.windows(w, 10)
                for k in reader.maybe(own).tolist():
                    hits.add(int(own[k]), w.text(int(at[k]), int(at[k]) + 10), 0, int(at[k]), 10, len(w))
            hits.look_up()
            assert hits.words[0][:10].all() and hits.items[0]
        assert reader.loads <= (loads or 40 * 3)


def test_windows_of_one_hash_are_told_apart():
    own = dec.Block(pa.table({"hash": pa.array([-5, 3, 3, 9]), "words": pa.array([b"a ", b"b ", b"c ", b"d "], pa.binary()), "items": [["1"], ["2"], ["3", "4"], ["5"]]}))
    assert [own.items_of(h, w) for h, w in ((3, b"b "), (3, b"c "), (3, b"x "), (-5, b"a "), (4, b"a "), (10, b"d "))] == [["2"], ["3", "4"], None, ["1"], None, None]


@pytest.mark.parametrize("call", [lambda d: dec.scan(d, None, keep=("n_hit",)), lambda d: rules.measured(d, keep=("N_Words",)), lambda d: ngram_join.ngram_join(d, keep=("class",)), lambda d: minhash.minhash_join(d, keep=("kept",))])
def test_columns_to_keep_may_not_be_results(edge_docs, call):
    with pytest.raises(ValueError, match="names of results"):
        call(edge_docs)


def test_rows_without_an_id_do_not_lie_in_one_range_of_the_mix(spark):
    texts = F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 4000).cast("int")))
    docs = spark.range(12_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), texts.alias("text"), F.lit("s").alias("source"))
    sizes = mixing.mix(docs)
    keys = docs.select(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.size(F.split("text", " ")).cast("string"), F.lit(""))), 1, 3).alias("r"))
    assert keys.groupBy("r").count().agg(F.max("count")).first()[0] < 60
    assert sizes.count() == 12_000


def test_removal(spark, no_docs, bench):
    docs = spark.createDataFrame([(*t, "keep") for t in TEXTS], "doc_id long, text string, items string")
    spans = {r["doc_id"]: r["text"] for r in dec.decontaminate(docs, bench, remove="spans").where("items = 'keep' and doc_id > 0").collect() if r["doc_id"] != 1}
    assert spans == {2: "a ; here", 3: None, 4: TEXTS[3][1], 5: "shortitem"} or spans[3] in (None, "")
    whole = dec.decontaminate(docs, bench)
    assert whole.columns == docs.columns and sorted(r["doc_id"] for r in whole.collect()) == [3, 4, 5]
    assert dec.decontaminate(no_docs, bench).columns == no_docs.columns and dec.decontaminate(no_docs, bench).count() == 0
    assert dec.decontaminate(docs, bench.where("1 = 0")).count() == docs.count()
    with pytest.raises(ValueError):
        dec.decontaminate(docs, bench, remove="words")


def test_op7_digest(spark, sf):
    bench_rows = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in brute(docs, bench_rows))
    assert sorted(tuple(r) for r in queries.queries()["op7_decontamination"](spark, sf).collect()) == want
