"""Byte-level BPE of whole texts by the tokenizers library, with the work shared among equal pieces of text.

The tokenizer splits a text by a pattern before it merges, and no match of the pattern runs from a character that is
not white space into white space, or from a letter into punctuation.  So a text may be cut there, and the tokens of the
text are those of its pieces ("␣word", "...") in order.  `Pieces` cuts whole blocks with numpy, looks distinct
pieces up in a bounded cache and asks the library for the rest.  Texts that hold the string of a special token, which
the library finds before it splits, go to the library as they are.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from .arrays import NOT_SPACE, Block, Hasher, eights, same_bytes

#: Pieces kept in a worker's cache, tokens and bytes in it: about 100 MB at most.
CACHE_PIECES, CACHE_TOKENS, CACHE_BYTES = 1_000_000, 10_000_000, 20_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


_LETTER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT[33:127] = True
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = False


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Positions where pieces begin: each row that is not empty, white space behind a character that is surely none, and
    ASCII punctuation behind what is surely a letter (A-Z, a-z, U+00C0-U+00FF).

    Behind a control character, or behind one of the blocks U+1000-U+3FFF and U+0080-U+00BF that have white space of
    their own, there is no cut; the piece is only longer.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    prev, prev2, prev3 = (np.concatenate((np.zeros(k, np.uint8), data[: n - k] if k < n else data[:0]))[:n] for k in (1, 2, 3))
    sure = (prev > 0x20) & (prev != 0x7F) & ~((prev >= 0x80) & ((prev2 == 0xC2) | ((prev3 >= 0xE1) & (prev3 <= 0xE3))))
    letter = _LETTER[prev] | ((prev2 == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7))
    begin = ~NOT_SPACE[data] & sure | _PUNCT[data] & letter
    begin[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(begin)


def whole_rows(block: Block, specials: list[str]) -> list[int]:
    """Rows that hold the string of a special token."""
    raw, found = block.data.tobytes(), set()
    for s in specials:
        at, s = -1, s.encode()
        while (at := raw.find(s, at + 1)) >= 0:
            i = int(block.row_of(np.array([at]))[0])
            if at + len(s) <= block.offs[i + 1]:
                found.add(i)
    return sorted(found)


class Pieces:
    """A cache from pieces to slices of one pool of values; `values(texts)` gives the array of each new piece.

    Pieces are found by hash and then compared byte by byte; one that only its hash shares is worked out anew."""

    def __init__(self, values, most_pieces: int = CACHE_PIECES, most_values: int = CACHE_TOKENS, kind=np.int32, most_bytes: int = CACHE_BYTES):
        self.values, self.most, self.kind = values, (most_pieces, most_values, most_bytes), kind
        self.clear()

    def clear(self) -> None:
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2  # sorted hashes and their places; a long and a short list
        self.count = 0
        self.start, self.size, self.uses, self.at, self.length = (np.zeros(1024, np.int32) for _ in range(5))
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.data, self.filled = np.zeros(1 << 16, np.uint8), 0  # the pieces themselves; 8 bytes are spare

    @property
    def eight(self) -> np.ndarray:
        return eights(self.data)

    def _places(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is new."""
        out = np.full(len(h), -1, np.int32)
        for keys, places in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out = np.where(keys[at] == h, places[at], out)
        return out

    def _shrink(self) -> None:
        """Keep the pieces used most often, a quarter of the places at most, and of the values and bytes likewise."""
        hashes = np.empty(self.count, np.uint64)
        for keys, places in self.known:
            hashes[places] = keys
        order = np.argsort(-self.uses[: self.count], kind="stable")[: self.most[0] // 4]
        few = (np.cumsum(self.size[order], dtype=np.int64) <= self.most[1] // 4) & (np.cumsum(self.length[order], dtype=np.int64) <= self.most[2] // 4)
        order = order[few]
        size, uses, length = self.size[order], self.uses[order], self.length[order]
        values = self.gather(self.start[order].astype(np.int64), size.astype(np.int64))
        data = _gather(self.data, self.at[order].astype(np.int64), length.astype(np.int64))
        keys = hashes[order]
        self.clear()
        self._store(keys, size, values, length, data)
        self.uses[: len(keys)] = uses // 2

    def _pool(self, values: np.ndarray) -> int:
        """Put values into the pool; where they begin."""
        if self.used + len(values) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool) // 2, len(values)), self.kind)))
        self.pool[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)

    def _store(self, h: np.ndarray, size: np.ndarray, values: np.ndarray, length: np.ndarray, data: np.ndarray) -> None:
        n, k = self.count, len(h)
        while n + k > len(self.start):
            self.start, self.size, self.uses, self.at, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.uses, self.at, self.length))
        self.start[n : n + k] = self._pool(values) + np.cumsum(size) - size
        self.size[n : n + k] = size
        if self.filled + len(data) + 8 > len(self.data):
            self.data = np.concatenate((self.data, np.zeros(max(len(self.data) // 2, len(data) + 8), np.uint8)))
        self.data[self.filled : self.filled + len(data)] = data
        self.at[n : n + k] = self.filled + np.cumsum(length) - length
        self.length[n : n + k] = length
        self.count, self.filled = n + k, self.filled + len(data)

        def merged(a, b):
            keys, places = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
            order = np.argsort(keys, kind="stable")
            return keys[order], places[order]

        long, short = self.known
        short = merged(short, (h, np.arange(n, n + k, dtype=np.int32)))
        if len(short[0]) > len(long[0]) // 8:
            long, short = merged(long, short), (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.known = [long, short]

    def look_up(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end) of the block's pieces and (start, size) of their values in the pool."""
        begin = cuts(block.data, block.offs)
        end = np.append(begin[1:], len(block.data)) if len(begin) else begin
        hasher, n = Hasher(block.data), end - begin
        h = self.hash(hasher, begin, end)
        distinct, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if self.count + len(distinct) > self.most[0] or self.used > self.most[1] or self.filled > self.most[2]:
            self._shrink()

        def work_out(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(sizes, values) of the pieces at these places."""
            i, j = begin[at].tolist(), end[at].tolist()
            got = self.values([block.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(i, j, strict=True)])
            size = np.fromiter(map(len, got), np.int64, len(got))
            return size, np.fromiter(chain.from_iterable(got), self.kind, int(size.sum()))

        slot = self._places(distinct)
        old, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        other = np.zeros(len(distinct), bool)  # hashes of cached pieces with other bytes
        i = first[old]
        other[old] = (n[i] != self.length[slot[old]]) | ~same_bytes(hasher, begin[i], self, self.at[slot[old]].astype(np.int64), np.minimum(n[i], self.length[slot[old]]))
        if len(new):
            size, values = work_out(first[new])
            slot[new] = np.arange(self.count, self.count + len(new))
            length = n[first[new]]
            self._store(distinct[new], size, values, length, _gather(block.data, begin[first[new]], length))
        self.uses[slot] += times.astype(np.int32)
        model = first[which]
        odd = other[which] | (n != n[model])
        at = np.flatnonzero(~odd)
        odd[at] = ~same_bytes(hasher, begin[at], hasher, begin[model[at]], n[at])
        start, size = self.start[slot][which].astype(np.int64), self.size[slot][which].astype(np.int64)
        if odd.any():
            at = np.flatnonzero(odd)
            size[at], values = work_out(at)
            start[at] = self._pool(values) + np.cumsum(size[at]) - size[at]
        return begin, end, start, size

    @staticmethod
    def hash(hasher: Hasher, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hasher.spans(begin, end)

    def gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The values of all pieces, one behind another."""
        return _gather(self.pool, start, size)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of pool, one behind another."""
    total = int(size.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) if total else np.zeros(0, np.int64)
    return pool[np.arange(total) + shift]


class Encoder:
    """Token ids of blocks of texts, exactly as the library gives them for each whole text."""

    def __init__(self, path: str):
        self.lib, self.specials = tokenizer(path), special_strings(path)
        self.pieces = Pieces(lambda texts: [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows in them)."""
        begin, _, start, size = self.pieces.look_up(block)
        row = block.row_of(begin)
        counts = np.bincount(row, weights=size, minlength=len(block)).astype(np.int64)
        special = whole_rows(block, self.specials)
        if not special:
            return self.pieces.gather(start, size), np.concatenate(([0], np.cumsum(counts)))
        ids = np.split(self.pieces.gather(start, size), np.cumsum(counts)[:-1])
        for i in special:
            ids[i] = np.array(self.lib.encode(block.text(i), add_special_tokens=False).ids, np.int32)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
