"""Content-defined chunks against plain loops and all pairs."""

import hashlib
import random

import numpy as np
import pytest
from helpers import rows

from twinsieve.operators import chunks


def plain_cuts(data, least, average, most):
    """The same cuts, a byte at a time."""
    gears = [int(g) for g in chunks.GEARS]
    ends, start, w = [], 0, chunks.WINDOW
    for i in range(1, len(data) + 1):
        here = i == len(data)
        if i >= w and not here:
            h = sum(gears[data[i - w + k]] * (2 * (w - k) * 0x01000193 | 1) for k in range(w)) & 0xFFFFFFFF
            here = (h ^ h >> 15) & (average - 1) == 0 and i - start >= least
        if here or i - start == most:
            ends.append(i)
            start = i
    return ends


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100, 3000])
def test_cuts(n):
    data = random.Random(n).randbytes(n)
    for sizes in ((1, 4, 16), (8, 32, 128), (64, 256, 2048)):
        got = chunks.cuts(np.frombuffer(data, np.uint8), *sizes)
        assert got == plain_cuts(data, *sizes)
        assert all(b - a <= sizes[2] for a, b in zip([0, *got], got, strict=False)) and (got[-1:] or [0]) == [n]
    same = np.zeros(5000, np.uint8)  # no marks, or one everywhere
    assert chunks.cuts(same, 8, 32, 128) == plain_cuts(bytes(5000), 8, 32, 128)


def test_inserted_bytes_change_few_chunks():
    rng = random.Random(2)
    data = rng.randbytes(200_000)

    def digests(d):
        ends = chunks.cuts(np.frombuffer(d, np.uint8))
        return {hashlib.md5(d[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)}

    whole = digests(data)
    assert 200_000 / len(whole) < 1_000
    for at in (0, 777, 100_000, 199_999):
        assert len(whole - digests(data[:at] + b"some new bytes" + data[at:])) <= 4


def test_pairs_are_those_of_all_against_all(spark):
    rng = random.Random(3)
    base = [rng.randbytes(rng.choice([30, 500, 4000])) for _ in range(8)]
    common = rng.randbytes(1500)  # in most files
    contents = {}
    for i in range(50):
        data = bytearray(rng.choice(base))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(data) + 1)
            data[at:at] = rng.randbytes(rng.choice([1, 40]))
        if rng.random() < 0.6:
            data += common
        if rng.random() < 0.3:
            data = data[: len(data) // 2]
        contents[f"/f{i:02}"] = bytes(data)
    contents |= {"/empty": b"", "/null": None}
    df = spark.createDataFrame(list(contents.items()), "canonical_path string, content binary").repartition(3)
    sizes = (8, 32, 128)
    sets = {}
    for p, d in contents.items():
        ends = chunks.cuts(np.frombuffer(d or b"", np.uint8), *sizes)
        sets[p] = {hashlib.md5(d[a:b]).hexdigest(): b - a for a, b in zip([0, *ends], ends, strict=False)}
    sets = {p: s for p, s in sets.items() if s}
    first = {}
    for p in sorted(sets):
        first.setdefault(frozenset(sets[p]), p)
    for threshold in (0.2, 0.5, 0.9, 1.0):
        pairs, classes = chunks.near_duplicate_files(df, threshold, *sizes)
        want = []
        own = sorted(first.values())
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared = sum(n for x, n in sets[a].items() if x in sets[b])
                share = shared / min(sum(sets[a].values()), sum(sets[b].values()))
                if share >= threshold:
                    want.append((a, b, shared, share))
        assert rows(pairs) == want and want
    assert {r["entity"]: r["representative"] for r in classes.collect()} == {p: first[frozenset(s)] for p, s in sets.items() if list(map(frozenset, sets.values())).count(frozenset(s)) > 1}


def test_edges(spark):
    none = spark.createDataFrame([("/a", None)], "canonical_path string, content binary")
    pairs, classes = chunks.near_duplicate_files(none)
    assert pairs.count() == classes.count() == 0
    with pytest.raises(ValueError, match="threshold"):
        chunks.contained(none, 0)
