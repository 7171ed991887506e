"""MinHash near-duplicates against all pairs."""

import numpy as np
import pytest

from test_ngram_join import brute, near_copies
from twinsieve.llm import minhash as mh
from twinsieve.llm import ngram_join as nj


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "num", "tile"), [(4, 80, 1000), (3, 60, 4), (1, 80, 3)])
def test_all_pairs(spark, monkeypatch, size, num, tile):
    monkeypatch.setattr(nj, "TILE_CLASSES", tile)
    monkeypatch.setattr(mh, "SEEN_CLASSES", 5)
    docs = near_copies(size + 10)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = mh.minhash_join(df, size, num)
    assert got(found) == brute(docs, size, num, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_edges_of_input(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(mh.minhash_join(edge_docs, 4)) == brute(docs, 4, 80, 100)
    assert mh.minhash_join(no_docs, 4).collect() == []


def test_matches_lose_less_than_asked():
    rng = np.random.default_rng(1)
    assert mh.matches_at(80, 100) == 31
    for num, k in ((80, 64), (60, 32), (90, 16)):
        t, p = mh.matches_at(num, 100, k, 1e-3), num / 100
        lost = (rng.random((200_000, k)) < p).sum(1) < t
        assert lost.mean() < 1.3e-3


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 2**63, int(400 * share)).astype(np.uint64)
            own = [rng.integers(0, 2**63, (400 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
            a, b = (np.sort(np.concatenate((both, x))) for x in own)
            ka, kb = (mh.signatures(np.zeros(len(x), np.int64), x, 1) for x in (a, b))
            agree.append((ka == kb).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_merging_gives_every_pair_with_enough_collisions():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(120) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 25))).astype(np.uint64)))) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(40)]
    th, matches = nj.Threshold(80, 100), 31
    keys = mh.signatures(np.repeat(np.arange(80), [len(s) for s in sets]), np.concatenate(sets), 80)
    size = [len(s) for s in sets]
    pairs = {(int(a), int(b)) for x, y in mh.colliding(64, matches)(sets, th, np.arange(80)) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if (keys[i] == keys[j]).sum() >= matches and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])}
    assert pairs == want
    # what is connected is skipped
    assert not list(mh.colliding(64, matches)(sets, th, np.zeros(80, np.int64)))


def test_a_shared_passage_is_no_list_of_the_prefix(spark):
    rng = np.random.default_rng(4)
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, " ".join(f"own{x}" for x in rng.integers(0, 10**6, 150)) + " " + passage) for i in range(120)]
    rows = mh.measured(spark.createDataFrame(docs, "doc_id long, text string"), 4, 64, "text", "doc_id")
    assert mh.prefix_lists(rows.where("keys is not null").select("class", "keys"), 31).count() == 0
