"""The trained operators: numbers that can be computed, held-out accuracy, and odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import language_model as lm
from twinsieve.llm import quality_mil as mil
from twinsieve.llm import queries
from twinsieve.llm import toxicity as tox
from twinsieve.llm.labelled import sample

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def held(spark, name, label, n, k):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = queries.queries()[name](spark, MEDIUM).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == k) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    return np.array([r["score"] for r in own]), np.array([labels[r["doc_id"]] for r in own]), np.array([r["predicted"] for r in own])


def test_toxicity_held_out(spark):
    s, y, p = held(spark, "op5_toxicity", "toxic", 3, 1)
    assert auc(s, y) > 0.93 and p[y == 0].mean() < 0.02 and p[y == 1].mean() > 0.75


def test_quality_held_out(spark):
    s, y, p = held(spark, "op6_quality_classifier", "quality", 4, 2)
    assert auc(s, y) > 0.99 and p[y == 1].mean() > 0.95 and p[y == 0].mean() < 0.1


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = tox.Trees(rounds=40).fit(x[:2000], y[:2000])
    assert ((t.decide(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    places, heights = tox.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert heights.tolist() == [0.0, 0.5, 1.0] and places.tolist() == [1, 2.5, 4.5]


def test_isotonic_is_the_least_squares_fit():
    """Against projected gradient steps on the quadratic problem, with ties in x; equal x have one height."""
    places, heights = tox.isotonic(np.array([1.0, 1, 1, 1, 2]), np.array([0.0, 0, 1, 1, 1]))
    assert places.tolist() == [1, 2] and heights.tolist() == [0.5, 1.0]
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, y = rng.integers(0, 6, 30).astype(float), rng.integers(0, 2, 30).astype(float)
        places, heights = tox.isotonic(x, y)
        own = np.unique(x)
        mean, n = np.array([y[x == v].mean() for v in own]), np.array([(x == v).sum() for v in own])
        # minimax formula of the isotonic regression
        average = lambda i, j, mean=mean, n=n: (mean[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum()
        want = [max(min(average(i, j) for j in range(k, len(own))) for i in range(k + 1)) for k in range(len(own))]
        assert (np.diff(heights) > 0).all()
        loss = sum(n[k] * (min(heights, key=lambda h, k=k: abs(h - want[k])) - want[k]) ** 2 for k in range(len(own)))
        assert loss == pytest.approx(0) and sorted(set(np.round(want, 9))) == sorted(set(np.round(heights, 9)))


def test_features_by_loops():
    """The toxicity features that have a plain definition, and passages' measures, against loops over words."""
    texts = ["You are an IDIOT, you fool!! s0 st@pid", "", "plain words here", "AA bb aa"]
    low = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW)) for t in texts]
    bad = {"idiot": 4.0, "fool": 2.0}
    h = tox._hashes(list(bad))
    one = {w: tox._hashes([w])[0] for w in bad}
    lexicon = tox.Lexicon(h, np.array([bad[next(w for w in bad if one[w] == x)] for x in h]))
    got = tox.features(next(tox.blocks(pa.array(texts))), lexicon)
    at = {f: k for k, f in enumerate(tox.FEATURES)}
    for k, words in enumerate(low):
        n = max(len(words), 1)
        hits = [w for w in words if w in bad]
        assert got[k, at["n_words"]] == pytest.approx(math.log1p(len(words))) and got[k, at["hits"]] == pytest.approx(math.log1p(len(hits)))
        assert got[k, at["hit_weight"]] == pytest.approx(math.log1p(sum(bad[w] for w in hits))) and got[k, at["density"]] == pytest.approx(100 * len(hits) / n)
        assert got[k, at["distinct"]] == pytest.approx(math.log1p(len(set(hits)))) and got[k, at["second"]] == pytest.approx(100 * sum(w in tox.SECOND_PERSON for w in words) / n)
        near = [i for i, w in enumerate(words) if w in bad and any(v in tox.SECOND_PERSON for v in words[max(0, i - 3) : i] + words[i + 1 : i + 4])]
        assert got[k, at["near_second"]] == pytest.approx(100 * len(near) / n)


def test_network_by_loops():
    rng = np.random.default_rng(6)
    m = len(mil.FEATURES)
    x, row = rng.normal(size=(23, m)), np.sort(rng.integers(0, 5, 23))
    row[:5] = range(5)
    row = np.sort(row)
    net = mil.Network.fit(x, row, np.array([0.0, 1, 0, 1, 1]), epochs=3)
    s, a = net.scores(x, row, 5)
    p, sigmoid = net.p, lambda v: 1 / (1 + np.exp(-v))
    for d in range(5):
        own = [(x[i] - net.mean) / net.scale for i in range(23) if row[i] == d]
        h = [np.tanh(v @ p["W"] + p["b"]) for v in own]
        e = [float((np.tanh(v @ p["V"]) * sigmoid(v @ p["U"])) @ p["u"]) for v in h]
        weight = np.exp(e) / np.exp(e).sum()
        z = sum(w * v for w, v in zip(weight, h, strict=True))
        assert s[d] == pytest.approx(float(sigmoid(z @ p["c"] + p["d"][0]))) and np.allclose(a[row == d], weight)


def test_passages_are_measured_alone():
    """A passage's features do not depend on the rest of its document."""
    rng = random.Random(3)
    words = [rng.choice(["aa", "Bb!", "c1", "dd.\n", "##", "ee", "FFF"]) for _ in range(mil.PASSAGE * 3 + 10)]
    parts = [" ".join(words[i : i + mil.PASSAGE]) for i in range(0, len(words), mil.PASSAGE)]
    row, x = mil.passages(next(mil.blocks(pa.array(["zz", " ".join(words)]))))
    assert row.tolist() == [0, 1, 1, 1, 1]
    alone = mil.passages(next(mil.blocks(pa.array(parts))))[1]
    line = [k for k, f in enumerate(mil.FEATURES) if f not in ("lines", "repeated_lines")]  # lines may run on over the border
    assert np.allclose(x[1:][:, line], alone[:, line])


def test_repeated_labelled_ids_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(200)] + [(1, "same")] * 50 + [(2, "w " * 20_000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    assert sample(docs, labels, "toxic", F.lit(True), 10).count() <= 10
    first = sorted((r["doc_id"], r["text"][:9]) for r in sample(docs, labels, "toxic", F.lit(True), 1000).collect())
    assert [i for i, _ in first] == [1, 2]
    assert first == sorted((r["doc_id"], r["text"][:9]) for r in sample(docs.repartition(1), labels, "toxic", F.lit(True), 1000).collect())
    for op, label in ((tox, "toxic"), (mil, "quality")):
        model = op.fit(docs, labels, F.lit(True), label, most=20)
        assert op.score(docs, model).count() == docs.count()


def test_attention_finds_the_passage():
    """Documents of ten passages are bad if one of them is: labels of documents are enough to find it."""
    rng = np.random.default_rng(2)
    n, k, m = 600, 10, len(mil.FEATURES)
    x = rng.normal(size=(n * k, m))
    y, at = rng.integers(0, 2, n), rng.integers(0, k, n)
    x[np.arange(n) * k + at, 3] += np.where(y == 0, 6.0, 0)
    row = np.repeat(np.arange(n), k)
    net = mil.Network.fit(x, row, y.astype(float))
    s, a = net.scores(np.clip((x - net.mean) / net.scale, -8, 8) * net.scale + net.mean, row, n)
    assert ((s > 0.5) == y).mean() > 0.95
    assert (a.reshape(n, k).argmax(1) == at)[y == 0].mean() > 0.9


@pytest.mark.parametrize(("op", "label"), [(tox, "toxic"), (mil, "quality")])
def test_odd_labels_and_texts(spark, edge_docs, no_docs, op, label):
    schema = f"doc_id long, {label} int, text string"
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(1, 10)] + [(None, 1, None), (3, None, None), (4, 1, None)], schema)
    for chosen in (labels, labels.where("1 = 0"), labels.where(f"{label} = 1")):
        model = op.fit(edge_docs, chosen, F.lit(True), label)
        got = op.score(edge_docs, model).collect()
        assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert op.score(no_docs, model).collect() == []
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in op.score(edge_docs, op.fit(no_docs, labels, F.lit(True), label)).collect())


def test_sample_is_bounded_and_takes_the_largest_label(spark, edge_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (7, None), (8, 0), (None, 1)], "doc_id long, y int")
    got = {(r["doc_id"], r["y"]) for r in sample(edge_docs.drop("y"), labels, "y", F.lit(True), 100).collect()}
    assert got == {(1, 1), (5, 0), (8, 0)}
    assert len({r["doc_id"] for r in sample(edge_docs, labels, "y", F.lit(True), 2).collect()}) == 2


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), None]


@pytest.mark.parametrize(("known", "size"), [(100_000, 1_023), (20, 5)])
def test_language_model(spark, sf, monkeypatch, known, size):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (size, known))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op10_language_model"](spark, sf).collect()
    c = Counter(t for i, x in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    total, floor = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    assert len(got) == len(docs)
    for r in got:
        own = tokens(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[t] > 0 for t in own), total)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10(c[t] + 0.5) for t in own) - len(own) * floor, abs=1e-6)


def test_language_model_held_out(spark):
    late = [r for r in queries.queries()["op10_language_model"](spark, MEDIUM).collect() if r["held_out"]]
    assert sum(r["score"] for r in late) > sum(r["base_score"] for r in late) + 0.03 * sum(r["n_tokens"] for r in late)
    assert np.mean([r["score"] > r["base_score"] for r in late]) > 0.85


def test_language_model_normalises():
    unigram = np.arange(1.0, 41.0)
    model, rng = lm.Model.start(unigram, 6), np.random.default_rng(0)
    lm.train(model, rng.integers(0, 41 * 41 * 40, 5000), unigram, rng, 0.1)
    contexts = np.repeat(rng.integers(0, 41 * 41, 7), 40)
    p = np.exp(model.log_probability(contexts, np.tile(np.arange(40), 7))).reshape(7, 40)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    again = lm.Model.of_table(model.table(), model)
    assert all(np.allclose(a, b) for a, b in zip(again.parameters, model.parameters, strict=True))


def test_language_model_normalises_over_classes():
    n = lm.HEAD + 700
    unigram = 1e4 / np.arange(1.0, n + 1)
    model, rng = lm.Model.start(unigram, 6), np.random.default_rng(0)
    lm.train(model, rng.integers(0, (n + 1) ** 2 * n, 5000), unigram, rng, 0.1)
    contexts = np.repeat(rng.integers(0, (n + 1) ** 2, 3), n)
    p = np.exp(model.log_probability(contexts, np.tile(np.arange(n), 3))).reshape(3, n)
    assert lm.n_classes(n) == 14 and np.allclose(p.sum(1), 1, atol=1e-4) and (p > 0).all()
    again = lm.Model.of_table(model.table(), model)
    assert all(np.array_equal(a, b) for a, b in zip(again.parameters + again.squares, model.parameters + model.squares, strict=True))


def test_language_model_probabilities_by_loops():
    """log_probability against plain loops: P(unit | context) * P(word | its class, context)."""
    n = lm.HEAD + 40
    unigram = 1e4 / np.arange(1.0, n + 1)
    model, rng = lm.Model.start(unigram, 5), np.random.default_rng(4)
    lm.train(model, rng.integers(0, (n + 1) ** 2 * n, 3000), unigram, rng, 0.2)
    contexts, words = rng.integers(0, (n + 1) ** 2, 60), rng.integers(0, n, 60)
    words[:30] = rng.integers(lm.HEAD, n, 30)
    contexts[10:20], words[10:20] = contexts[:10], words[:10]
    k = lm.n_classes(n)
    classes = [[w for w in range(lm.HEAD, n) if (w - lm.HEAD) % k == c] for c in range(k)]
    for c, w, got in zip(contexts, words, model.log_probability(contexts, words), strict=True):
        r = sum(model.scale[i].astype(float) * model.embed[x] for i, x in enumerate(divmod(int(c), n + 1)))
        power = lambda row, r=r: math.exp(float(r @ model.output[row]) + float(model.bias[row]))
        units = [*range(lm.HEAD), *(n + c for c in range(k))]
        own = int(w) if w < lm.HEAD else n + (int(w) - lm.HEAD) % k
        want = math.log(power(own) / sum(map(power, units)))
        if w >= lm.HEAD:
            want += math.log(power(int(w)) / sum(map(power, classes[(int(w) - lm.HEAD) % k])))
        assert got == pytest.approx(want, abs=1e-3)
    huge = model.copy()
    huge.bias += 200  # scores whose powers do not fit a float
    assert np.allclose(huge.log_probability(contexts, words), model.log_probability(contexts, words), atol=1e-3)


def test_language_model_tells_rarer_words_apart(spark):
    """The vocabulary grows with the corpus, and a word far behind the first 1,023 follows from the word before it."""
    counts = spark.range(6000).selectExpr("id as h", "40L as c")
    assert (lm.vocabulary(counts).id > 0).sum() == 6000 and len(lm.vocabulary(counts).unigram) == 6001
    texts = [(f"a{i} b{i} " * 40,) for i in range(2000)]
    model, table = lm.fit(spark.createDataFrame(texts, "text string").repartition(2), rounds=6)
    right, wrong = (spark.createDataFrame([(i, f"a{i} b{(i + k) % 2000}") for i in range(0, 2000, 50)], "doc_id long, text string") for k in (0, 1))
    likely, unlikely = ({r["doc_id"]: r["score"] for r in lm.score(x, model, table).collect()} for x in (right, wrong))
    assert np.mean([likely[i] > unlikely[i] for i in likely]) > 0.9


def test_vocabulary_of_words_that_tie(spark):
    ties = spark.range(500).selectExpr("id as h", "1L as c")
    for counts, known, first in ((ties, 100, range(50)), (spark.createDataFrame([(900, 7)], "h long, c long").union(ties), 100, [900, *range(49)])):
        v = lm.vocabulary(counts, 50, known)
        assert sorted(v.h[v.id > 0].tolist()) == sorted(first) and len(v.unigram) == 51


def test_noise_contrast_learns_what_follows_what():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 20, 40_000)
    words[1::2] = (words[::2] + 1) % 20  # every second word follows from the one before
    contexts = (np.roll(words, 1) * 21 + np.roll(words, 2))[1::2]
    unigram = np.bincount(words, minlength=20).astype(float)
    model = lm.Model.start(unigram, 16)
    for _ in range(15):
        lm.train(model, contexts * 20 + words[1::2], unigram, rng, 0.1)
    assert model.log_probability(contexts, words[1::2]).mean() > np.log(0.5)  # chance: log(1 / 20)


def test_tokens_and_contexts_of_texts():
    words = [f"w{i}" for i in range(30)]
    h = lm.Words(next(lm.blocks(pa.array([" ".join(words)])))).hash
    known, n = np.append(h, np.uint64(lm.END)), 32
    voc = lm.Vocabulary(1000, 31, known, np.arange(100, 131), np.arange(1, n), np.ones(n), 1.0)
    texts = ["w0 w1 zz w2", "", None, "w29", "W5 w6"]
    _, count, ids, row, contexts = lm.encode(next(lm.blocks(pa.array(texts))), voc)
    end, want = 31, [([1, 2, 0, 3, 31]), [31], [31], [30, 31], [6, 7, 31]]
    assert ids.tolist() == sum(want, []) and row.tolist() == [0] * 5 + [1, 2, 3, 3, 4, 4, 4] and count.tolist()[2] == -1 and count.tolist()[-1] == 130
    assert contexts.tolist() == [near * (n + 1) + far for own in want for near, far in (((own[k - 1] if k else n), (own[k - 2] if k > 1 else n)) for k in range(len(own)))]
    assert end in ids


def test_language_model_odd_input(spark, edge_docs, no_docs):
    for train in (edge_docs, no_docs):
        model, counts = lm.fit(train)
        got = lm.score(edge_docs, model, counts).collect()
        assert len(got) == edge_docs.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
        assert lm.score(no_docs, model, counts).collect() == []
