"""Whole batches of texts as numpy arrays: word bounds and 64-bit hashes without a Python object per word.

A batch's texts are one array of UTF-8 bytes plus offsets, just as Arrow stores them.  Every word class used here is
decided by single bytes (white space and punctuation are ASCII, all bytes of other characters are word bytes), so
splitting bytes gives exactly the words that splitting characters would.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the arrays derived from them take about 60 times as much.  A longer text is one block.
BLOCK_BYTES = 1 << 20

#: Spans of more bytes are hashed one by one, by BLAKE2b.
LONG_SPAN = 512
#: Entry k keeps the lowest k bytes of eight.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(9, 14)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: First bytes of characters, so that counting them counts code points.
FIRST = np.ones(256, dtype=bool)
FIRST[0x80:0xC0] = False

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a byte array on, as integers (unaligned, not copied)."""
    return np.ndarray((max(len(padded) - 7, 0),), "<u8", padded, strides=(1,))


class Hasher:
    """Hashes of any spans of one byte array: eight bytes at a time, each put through `mix` with what came before.

    Spans of one length of at most 8 bytes never collide; of other different spans, two do with a chance of 2**-64.  There
    is no algebra over the bytes that structured texts (such as Thue-Morse words) could meet.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.eight = eights(padded)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        h = mix((self.eight[start] & _LOWEST[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at, k = np.flatnonzero((n > 8) & (n <= LONG_SPAN)), 8
        while len(at):
            x = self.eight[start[at] + k] & _LOWEST[np.minimum(n[at] - k, 8)]
            h[at] = mix((h[at] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)) ^ x)
            k += 8
            at = at[n[at] > k]
        for i in np.flatnonzero(n > LONG_SPAN).tolist():
            h[i] = int.from_bytes(blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return h


def same_bytes(a: Hasher, start_a: np.ndarray, b: Hasher, start_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of a from start_a on are those of b from start_b on, for each span."""
    out, k = np.ones(len(n), bool), 0
    at = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    while len(at):
        differ = (a.eight[start_a[at] + k] ^ b.eight[start_b[at] + k]) & _LOWEST[np.minimum(n[at] - k, 8)]
        out[at[differ != 0]] = False
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        out[i] = np.array_equal(a.data[start_a[i] : start_a[i] + n[i]], b.data[start_b[i] : start_b[i] + n[i]])
    return out


class Block:
    """Some consecutive rows of a batch: `data` (bytes), `offs` (row i is data[offs[i]:offs[i+1]]), `rows` (a slice)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, rows: slice):
        self.data, self.offs, self.rows = data, offs, rows

    def __len__(self) -> int:
        return len(self.offs) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the mask marks."""
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, side="right") - 1

    def text(self, i: int) -> str:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column, null as empty, in runs of at most `max_bytes` (one row at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
        to = min(to, n)
        yield Block(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at], slice(at, to))
        at = to


class Words:
    """The words of a block: `start` and `end` in its bytes, `row`, `hash`; `first[i]:first[i+1]` are those of row i."""

    def __init__(self, block: Block, is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        data = block.data
        if lower:
            data = data + (((data >= 65) & (data < 91)).view(np.uint8) << np.uint8(5))
        self.block, self.data = block, data
        inside = (data != 32) & ((data < 9) | (data > 13)) if is_word is NOT_SPACE else is_word[data]
        self.inside = inside
        n = len(data)
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if n:  # the ends of the bytes are changes too, where a word is there
            change = np.concatenate((np.zeros(int(inside[0]), np.int64), change, np.full(int(inside[-1]), n)))
        self.start, self.end = change[::2], change[1::2]
        cut = np.unique(block.offs[1:-1])
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inside[cut] & inside[cut - 1]]  # rows that part a run of word bytes
        if len(cut):
            at = np.searchsorted(self.start, cut)
            self.start, self.end = np.insert(self.start, at, cut), np.insert(self.end, at - 1, cut)
        self.first = np.searchsorted(self.start, block.offs)
        self.row = np.repeat(np.arange(len(block)), np.diff(self.first))
        self.hasher = Hasher(data)
        self.hash = self.hasher.spans(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, each followed by one space: equal just when the word sequences are equal."""
        return b"".join(self.data[self.start[k] : self.end[k]].tobytes() + b" " for k in range(i, j))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of `size` words that lies in one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = words.hash[:n].copy()
    for j in range(1, size):
        g *= np.uint64(0x9FB21C651E98DF25)
        g += words.hash[j : j + n]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    return at, mix(g[at] + np.uint64(size))


def repeated(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each entry's (row, hash) occurs, whether an earlier entry has the same)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    group = np.concatenate(([0], np.cumsum(~same)))
    times, later = np.empty(len(h), np.int64), np.zeros(len(h), bool)
    times[order] = np.bincount(group)[group]
    later[order[1:]] = same
    return times, later


def group_sums(row: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights=weight, minlength=n)
