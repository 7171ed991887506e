import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from twinsieve.llm import pieces, queries
from twinsieve.llm import prefix_tokens as pt
from twinsieve.llm import token_files as tf
from twinsieve.llm.arrays import blocks

PATH = pieces.default_path()
LIB = pieces.tokenizer(PATH)
PARTS = [" ", "\n", "\t", "'", "s", "re", "!", "1", "é", "漢", "\x1c", "\x85", " ", "　", "a", "<|endoftext|>", "<|endo", "'ll", "   ", " the", "ing", "🙂", ".", "×", "##"]


def strange(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(16))) for _ in range(n)] + ["", "'ve", "''ll", " 'r e", "x  ", "\n\n  'd ", "é, è.", "a" * 3000]


def lib(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_librarys_ids(monkeypatch):
    texts = strange(3000)
    enc = pieces.Encoder(PATH)
    enc.pieces.most = (500, 5_000, 9_000)  # the cache shrinks many times
    got = []
    for b in blocks(pa.array([None, *texts]), 700):
        ids, offs = enc.encode(b)
        got += [x.tolist() for x in np.split(ids, offs[1:-1])]
    assert got == [lib(t) for t in [None, *texts]]


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_structured_words_and_colliding_hashes(monkeypatch):
    words = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), thue_morse(n, "b", "a"))]
    texts = [*words, " ".join(words), *(w + " x" for w in words)]

    def check(enc):
        for b in [*blocks(pa.array(texts)), *blocks(pa.array(texts[::-1]))]:
            ids, offs = enc.encode(b)
            assert [x.tolist() for x in np.split(ids, offs[1:-1])] == [lib(b.text(i)) for i in range(len(b))]

    check(pieces.Encoder(PATH))
    # hashes that collide often: pieces are told apart by their bytes, within a block and against the cache
    monkeypatch.setattr(pieces.Pieces, "hash", staticmethod(lambda hasher, i, j: hasher.spans(i, j) % np.uint64(7)))
    check(pieces.Encoder(PATH))
    enc = pieces.Encoder(PATH)
    for b in blocks(pa.array(strange(300)), 500):
        ids, offs = enc.encode(b)
        assert [x.tolist() for x in np.split(ids, offs[1:-1])] == [lib(b.text(i)) for i in range(len(b))]


def test_prefix_counts_are_the_librarys_for_every_prefix():
    counter = pt.PrefixCounter(PATH)
    for b in blocks(pa.array(strange(600)), 2000):
        flat, offs = counter.counts(b)
        for i in range(len(b)):
            t = b.text(i)
            if len(t) < 100:
                assert flat[offs[i] : offs[i + 1]].tolist() == [len(lib(t[:k])) for k in range(1, len(t) + 1)], t
            else:
                assert flat[offs[i + 1] - 1] == len(lib(t))


def test_long_runs_take_one_pass():
    for run in (" ", "\n", "'", " \n", "'re ", "é", "'r", "'' "):
        text = ("x" + run * 100_000)[:100_000] + "y"
        counter, t0 = pt.PrefixCounter(PATH), time.perf_counter()
        flat, _ = counter.counts(next(blocks(pa.array([text]))))
        assert time.perf_counter() - t0 < 20
        assert len(flat) == 100_001 and all(flat[k - 1] == len(lib(text[:k])) for k in (*range(1, 300), 5000, 99_998, 99_999, 100_000, 100_001)), run


def test_every_prefix_of_runs_and_contractions():
    rng = random.Random(9)
    texts = ["".join(rng.choice(["'", "''", "'re", "'ve", "'ll", "'r", " ", "  ", "\n", " \n ", "a", "!", "3", "'s", "'.", " "]) for _ in range(12)) for _ in range(1500)]
    counter = pt.PrefixCounter(PATH)
    for b in blocks(pa.array(texts), 3000):
        flat, offs = counter.counts(b)
        for i in range(len(b)):
            t = b.text(i)
            assert flat[offs[i] : offs[i + 1]].tolist() == [len(lib(t[:k])) for k in range(1, len(t) + 1)], t


def test_budgets_from_stored_counts(edge_docs, no_docs):
    for budget in (0, 1, 7, 1024):
        table = pt.prefix_counts(edge_docs, budget=budget, steps=True)
        want = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["fits_chars"]) for r in table.collect()}
        assert {tuple(r) for r in pt.within(table, budget).select("doc_id", "n_bytes", "n_tokens", "fits_chars").collect()} == want
    assert pt.within(pt.prefix_counts(no_docs, steps=True)).collect() == []


def test_prefix_table(spark, edge_docs, no_docs):
    rows = pt.prefix_counts(edge_docs.withColumn("full", edge_docs["text"]), budget=20, steps=True, keep=("doc_id", "full")).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        t = r["full"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(lib(t)))
        k = r["fits_chars"]
        assert k == pt.longest_prefix(bytes(r["steps"]), 20) and len(lib(t[:k])) <= 20 and pt.tokens_before(bytes(r["steps"]), k) == len(lib(t[:k]))
        assert all(len(lib(t[: k + j])) > 20 for j in range(1, 6) if k + j <= len(t))
    assert pt.prefix_counts(no_docs).collect() == []


def test_op8(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.queries()["op8_prefix_tokens"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(lib(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_coding_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data, size = tf.encode_values(v)
        assert len(control) == -(-n // 4) and len(data) == size.sum() == sum(max(1, (int(x).bit_length() + 7) // 8) for x in v)
        assert tf.decode_values(control, data, np.arange(4 * len(control)) < n).tolist() == v.tolist()


def test_files(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 50)
    got = sorted(tf.read_corpus(*tf.write_corpus(edge_docs), with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, [*lib(r["text"]), 2]) for r in edge_docs.collect()], key=lambda x: (x[0], x[1], len(x[2])))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, len(r["ids"])) for r in got] == [(a, b, len(c)) for a, b, c in want]
    assert sorted(map(str, (r["ids"] for r in got))) == sorted(str(c) for *_, c in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert tf.read_corpus(*tf.write_corpus(no_docs)).collect() == []


def test_files_of_a_hot_id_and_of_nulls(spark, monkeypatch):
    monkeypatch.setattr(tf, "LEAST_IDS", 40)
    rows = [(7, f"w{i} x") for i in range(120)] + [(7, "same") for _ in range(60)] + [(None, f"n{i}") for i in range(60)] + [(i, "y z") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest, ranks = tf.write_corpus(docs)
    files = manifest.collect()
    assert len(files) > 3 and max(r["n_docs"] for r in files) < 120 and sum(r["n_docs"] for r in files) == len(rows)
    got = sorted(tf.read_corpus(manifest, ranks, with_ids=True).collect(), key=lambda r: r["start"])
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(str((i, [*lib(t), 2])) for i, t in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_bounds():
    b = tf.Bounds([(None, 5, 1), (None, 9, 1), (1, 3, 1), (4, 2, 1), (4, 8, 1), (4, 9, 1), (6, 1, 1)], 7)
    rows = [(None, 1), (None, 5), (None, 9), (0, 1), (1, 2), (1, 3), (4, 1), (4, 8), (4, 8), (4, 9), (5, 0), (6, 0), (6, 1), (7, 0)]
    got = b.files(pa.array([r[0] for r in rows], pa.int64()), np.array([r[1] for r in rows])).tolist()
    assert got == sorted(got) and got[0] == 0 and got[-1] == len(b) - 1 and got[7] == got[8] == got[6] + 2
    assert len(tf.Bounds([], 3)) == 1 and tf.Bounds([], 3).files(pa.array([None, 1], pa.int64()), np.array([0, 0])).tolist() == [0, 0]


def test_op4(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at, want = 0, []
    for i, t in docs:
        ids = [*lib(t), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.queries()["op4_token_files"](spark, sf).collect()) == want


def test_wrong_file(tmp_path):
    (tmp_path / "x").write_bytes(b"something else")
    with pytest.raises(ValueError):
        next(tf.read_blocks(f"file://{tmp_path}/x", np.zeros(1, "<u4")))
