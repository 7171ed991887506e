"""Importance resampling against plain loops."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from twinsieve.llm import importance as im

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, order):
    w = WORD.findall((text or "").translate(LOW))
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, order=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    bucket = lambda r: zlib.crc32(r.encode()) % buckets
    s, t = (Counter(bucket(r) for text in texts for r in runs(text, order)[0]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (all_s + buckets) / ((s[k] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        features, n = runs(text, order)
        weight = sum(gain(bucket(r)) for r in features) // len(features) if features else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = len(may) * percent // 100
    return sorted([(*r, k + 1) for k, r in enumerate(may[:drawn])] + [(*r, None) for r in may[drawn:]] + [(*r, None) for r in out if r[1] < least_words], key=str)


def some(seed, n):
    rng, words = random.Random(seed), ["alpha", "Beta", "gamma3", "délta", "漢字", "x-y", "it's"] + [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 30, 60])))
    ids = [None, None, 3, *range(n)]
    docs = [(rng.choice(ids), rng.choice([text(), text(), text(), None])) for _ in range(n)]
    return docs + docs[: n // 3], [text() for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 35), (2, 7, 100)])
def test_loops(spark, monkeypatch, order, buckets, percent):
    monkeypatch.setattr(im, "UNFOLD", 2)
    docs, target = some(order, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = im.resample(df, goal, order, buckets, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, order, buckets, percent)


def test_edges_of_input(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    for target in (edge_docs, no_docs):
        texts = [r["text"] for r in target.collect()]
        assert sorted((tuple(r) for r in im.resample(edge_docs, target, percent=60).collect()), key=str) == brute(docs, texts, percent=60)
    assert im.resample(no_docs, edge_docs).collect() == []


def test_a_repeated_row_is_one_row_until_the_end(spark):
    df = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three " * 7).alias("text"))
    ranks = im.resample(df, df.limit(1)).select("rank").collect()
    assert sorted(r["rank"] for r in ranks if r["rank"]) == list(range(1, 3_001)) and len(ranks) == 30_000


def test_words_of_order_one_are_not_shuffled(spark):
    texts = im._texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.col("doc_id"), "text", 1)
    plan = im.runs(texts, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
