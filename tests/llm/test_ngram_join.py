import random
import re

import numpy as np
import pyarrow as pa
import pytest

from twinsieve.llm import ngram_join as nj
from twinsieve.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        k = min(size, len(w))
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    return out


def brute(docs, size, num, den):
    """(doc_id, shingles, component_id) by comparing all pairs."""
    s, up = sets_of([t for _, t in docs], size), list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a] & s[b])
            if s[a] and s[b] and den * both >= num * (len(s[a]) + len(s[b]) - both):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(s[k]), low.get(root(k))) for k, (i, _) in enumerate(docs)), key=str)


def near_copies(seed, groups=60):
    rng, words = random.Random(seed), [f"w{i}" for i in range(300)]
    docs = [(1, None), (2, ""), (3, " \n"), (None, None), (None, "alone here")]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 9, 10, 12, 20, 40, 80, 150]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                j = rng.randrange(len(w))
                w[j : j + rng.randrange(2)] = [rng.choice(words)]
            docs.append((rng.choice([None, *range(2000)]), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return docs


def test_runs_of_any_length():
    rng = np.random.default_rng(2)
    for limit in (1, 3, 10, 10_000):
        for _ in range(60):
            key = np.sort(rng.choice([1, 2, 3, 5, 9], rng.integers(0, 40), p=[0.6, 0.1, 0.1, 0.1, 0.1]))
            rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key)))], names=["k", "v"])
            cuts = np.sort(rng.integers(0, len(key) + 1, 5)).tolist()
            batches = [rows.slice(i, j - i) for i, j in zip([0, *cuts], [*cuts, len(key)], strict=True)]
            got = list(nj._runs(batches, 2, limit))
            assert np.concatenate([np.zeros(0, int), *(v for _, (_, v) in got)]).tolist() == list(range(len(key)))
            whole = [set(k.tolist()) for long, (k, _) in got if not long]
            parts = [set(k.tolist()) for long, (k, _) in got if long]
            assert all(len(x) == 1 for x in parts) and (limit < 10_000 or not parts)
            assert sum(map(len, whole)) == len(set().union(*whole)) and not set().union(*whole) & set().union(*parts)


@pytest.mark.parametrize("rows", [2, 7])
def test_long_runs_stream_by(spark, monkeypatch, rows):
    monkeypatch.setattr(nj, "RUN_ROWS", rows)
    monkeypatch.setattr(nj, "SEEN_CLASSES", 5)
    docs = near_copies(5, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_join(df).collect()), key=str) == brute(docs, 3, 90, 100)


@pytest.mark.parametrize(("size", "num", "den", "tile"), [(3, 90, 100, 1000), (5, 80, 100, 4), (1, 60, 100, 3)])
def test_all_pairs(spark, monkeypatch, size, num, den, tile):
    monkeypatch.setattr(nj, "TILE_CLASSES", tile)
    docs = near_copies(size)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_join(df, size, num, den).collect()), key=str)
    assert got == brute(docs, size, num, den)


def test_edges_of_input(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_join(edge_docs).collect()), key=str)
    assert got == brute(docs, 3, 90, 100)
    assert nj.ngram_join(no_docs).collect() == []


def test_keys_meet_every_pair_above_the_threshold():
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (50, 100)):
        th = nj.Threshold(num, den, 10_000)
        for n in (9, 10, 11, 19, 37, 100, 300):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                m = int(rng.integers(0, n))
                drop = int(rng.integers(0, n))
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, m).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if len(b) and den * both >= num * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    ka, kb = (set(nj.keys(np.zeros(len(x), np.int64), np.sort(x), 1, th)[1].tolist()) for x in (a, b))
                    assert ka & kb
                    for x in (a, b):
                        need = nj.keys(np.zeros(len(x), np.int64), np.sort(x), 1, th)[2]
                        assert any(sum(k & 1 == odd for k in ka & kb) >= need[odd, 0] for odd in (0, 1))


def test_tree_drops_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(200) < 0.95], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)))) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(60)]
    th = nj.Threshold(80, 100)
    got = {tuple(sorted(p)) for a, b in nj.SignatureTree(sets).pairs(th) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in got
    assert len(got) < 120 * 119 / 2 / 2  # and most others are pruned


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["label"] for r in components(df).collect()} == want
    assert components(df.where("1 = 0")).collect() == []
