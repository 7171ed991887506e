import random
import re

import numpy as np
import pyarrow as pa

from twinsieve.llm.arrays import ALNUM, NOT_SPACE, Words, blocks, repeated, windows

KINDS = ((NOT_SPACE, re.compile(rb"[^\x20\x09-\x0D]+")), (ALNUM, re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = [None, "", " ", "a", "\x00b \x7f", "É é x"] + ["".join(rng.choice(" \n\tAbZ09é漢🙂.!\x00") for _ in range(rng.randrange(40))) for _ in range(400)]
    column = pa.array(["skipped", *texts])[1:]  # a slice, as Spark sends them
    for table, pattern in KINDS:
        got = []
        for b in blocks(column, 64):
            w = Words(b, table, lower=True)
            got += [[w.text(k, k + 1)[:-1] for k in range(w.first[i], w.first[i + 1])] for i in range(len(b))]
        low = lambda t: bytes(c + 32 if 65 <= c < 91 else c for c in (t or "").encode())
        assert got == [pattern.findall(low(t)) for t in texts]


def test_hashes_tell_words_apart_and_do_not_depend_on_place():
    words = [f"w{i}" for i in range(20_000)] + ["a", "aa", "\x01", "\x01\x01"]
    w = Words(next(blocks(pa.array([" ".join(words)]))))
    assert len(set(w.hash.tolist())) == len(words)
    again = Words(next(blocks(pa.array(["x yy " + " ".join(reversed(words))]))))
    assert again.hash[2:][::-1].tolist() == w.hash.tolist()


def test_structured_words_have_hashes_of_their_own():
    flip = [i.bit_count() & 1 for i in range(8192)]
    words = [bytes(97 + (f ^ x) for f in flip[:n]) for n in (1, 2, 3, 7, 8, 9, 16, 64, 512, 513, 1024, 2048, 4096, 8192) for x in (0, 1)]
    words += [b"a" * n for n in range(2, 600)]
    column = pa.array([b" ".join(words).decode(), *(w.decode() for w in words)])
    for size in (1 << 20, 700):
        hashes = [b_ for b in blocks(column, size) for b_ in Words(b).hash.tolist()]
        assert len(set(hashes)) == len(set(words)) and hashes[: len(words)] == hashes[len(words) :]


def test_windows_and_repeats():
    w = Words(next(blocks(pa.array(["a b c a b", "a b", "c a b"]))))
    at, h = windows(w, 2)
    assert at.tolist() == [0, 1, 2, 3, 5, 7, 8] and h[0] == h[3] == h[4] == h[6]
    times, later = repeated(w.row[at], h)
    assert times.tolist() == [2, 1, 1, 2, 1, 1, 1] and later.tolist() == [False] * 3 + [True] + [False] * 3
    assert repeated(np.zeros(0, int), np.zeros(0, np.uint64))[0].tolist() == []
