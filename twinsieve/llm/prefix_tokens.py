"""Exact token counts of every prefix of a text by dynamic programming, for truncation and budgets without re-encoding.

A sequence of tokens is the byte-pair encoding of its string just when every two neighbours are that of theirs.  So
each prefix of a word has one last token: the one that goes well behind the last token of the prefix before it, and
count(prefix) = count(shorter prefix) + 1.  One forward pass over a word gives the counts of all its prefixes.

Texts are cut into pieces whose counts add up (see `pieces`); equal pieces share one bounded cache, and the counts of
all prefixes of all texts in a block are then one gather and one add in numpy.  Prefixes are counted in code points.

Null texts are empty (0 tokens).  Rows are independent: repeated ids, ties and extra columns do not matter, and an
empty table gives an empty result.  Texts of any length are counted whole, in time that grows with their length: also
runs of white space and of apostrophes take one pass.  Columns of `keep` that bear the name of a result are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import FIRST, Block, blocks
from .columns import no_clash
from .pieces import Pieces, cuts, default_path, special_strings, tokenizer, whole_rows
from .scratch import stash

#: The pattern of the byte-level BPE vocabularies (a fixed value; the tokenizer file names it by `use_regex`).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|(\s+(?!\S))|\s+"
#: The pattern's contractions of two letters.
TWO_LETTERS = ("'re", "'ve", "'ll")
MOST_PAIRS = 1_000_000


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class PrefixCounter:
    """Counts of the prefixes of pieces."""

    def __init__(self, path: str):
        self.lib, self.specials = tokenizer(path), special_strings(path)
        self.model = self.lib.model
        self.vocab = {k: v for k, v in self.lib.get_vocab(with_added_tokens=False).items()}
        self.name = {v: k for k, v in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.bytes = _byte_names()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)
        self.pieces = Pieces(lambda texts: [self.piece(t) for t in texts])

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b stays behind token a (-1: at the start)."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            want = [b] if a < 0 else [a, b]
            known = self.pairs[a, b] = [t.id for t in self.model.tokenize("".join(self.name[t] for t in want))] == want
        return known

    def word(self, raw: bytes) -> list[int]:
        """Counts of the prefixes of 1, 2, ... bytes of one match of the pattern."""
        s = raw.decode("latin-1").translate(self.bytes)
        last, count = [-1], [0]
        vocab, pairs = self.vocab, self.pairs
        for i in range(1, len(s) + 1):
            for j in range(i - 1, max(-1, i - self.longest - 1), -1):
                t = vocab.get(s[j:i])
                if t is not None:
                    ok = pairs.get((last[j], t))
                    if ok is None:
                        ok = self._fits(last[j], t)
                    if ok:
                        last.append(t)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError(f"no token ends at byte {i} of {raw[:80]!r}")
        return count[1:]

    def _chars(self, match: str) -> list[int]:
        """Counts of the prefixes (code points) of one match."""
        raw = match.encode("utf-8", "surrogatepass")
        counts = self.word(raw)
        if len(raw) == len(match):
            return counts
        first = FIRST[np.frombuffer(raw, np.uint8)]
        return [c for c, closes in zip(counts, [*first[1:].tolist(), True], strict=True) if closes]

    def piece(self, text: str) -> list[int]:
        """Counts of the prefixes (code points) of a piece, in one pass.

        A prefix's matches are those of the whole text up to the match it ends in, and the part of that match, but for two
        cases: it ends just behind a run of white space (the whole text leaves the run's last character to the next match,
        the prefix does not), or between the two letters of a contraction (the apostrophe is then a match of its own).
        """
        out, base, behind = [], 0, 0
        for m in self.split.finditer(text):
            match = m.group()
            run = m.group(1) is not None and m.end() < len(text)  # one character of this run of white space is left over
            counts = self._chars(match + text[m.end()] if run else match)
            own = counts[: len(match)]
            if match in TWO_LETTERS:
                own = [own[0], own[0] + self.word(match[1].encode())[-1], own[2]]
            at = len(out)
            out += [base + c for c in own]
            if behind:
                out[at] = behind
            behind = base + counts[-1] if run else 0
            base += own[-1]
        return out

    def whole(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text that holds strings of special tokens, which stand alone."""
        out, base, at = [], 0, 0
        marks = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        for m in [*marks.finditer(text), None]:
            section = text[at : m.start() if m else len(text)]
            got = self._section(section)
            out += [base + c for c in got]
            if m:
                s = m.group()
                out += [base + c for c in self._section(section + s[:-1])[len(section) :]]
                base += (got[-1] if got else 0) + 1
                out.append(base)
                at = m.end()
        return np.array(out, np.int64)

    def _section(self, text: str) -> list[int]:
        out, base = [], 0
        if not text:
            return out
        raw = text.encode("utf-8", "replace")
        data = np.frombuffer(raw, np.uint8)
        begin = cuts(data, np.array([0, len(raw)])).tolist()
        for i, j in zip(begin, [*begin[1:], len(raw)], strict=True):
            got = self.piece(raw[i:j].decode())
            out += [base + c for c in got]
            base = out[-1]
        return out

    def counts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(counts of all prefixes of all rows, offsets of the rows in them)."""
        begin, _, start, size = self.pieces.look_up(block)
        row = block.row_of(begin)
        tokens = self.pieces.pool[start + size - 1].astype(np.int64)
        before = np.cumsum(tokens) - tokens
        head = np.searchsorted(row, np.arange(len(block)))
        before -= before[head[row]] if len(row) else 0
        flat = self.pieces.gather(start, size) + np.repeat(before, size)
        offs = np.concatenate(([0], np.cumsum(np.bincount(row, weights=size, minlength=len(block)).astype(np.int64))))
        special = whole_rows(block, self.specials)
        if not special:
            return flat, offs
        parts = np.split(flat, offs[1:-1])
        for i in special:
            parts[i] = self.whole(block.text(i))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, path: str | None = None, budget: int = 1024, steps: bool = False, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes, n_tokens, fits_chars (code points of the longest prefix of at most `budget` tokens), and with
    `steps` the counts of all prefixes as 16-bit little-endian differences (see `tokens_before`)."""
    no_clash(keep, "n_bytes", "n_tokens", "fits_chars", "steps")
    path = path or default_path()
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = src.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(len(fields)), 2 << 20):
                flat, offs = counter(path).counts(b)
                total = np.where(offs[1:] > offs[:-1], flat[np.maximum(offs[1:], 1) - 1] if len(flat) else 0, 0)
                fit = np.flatnonzero(flat <= budget)
                k = np.searchsorted(fit, offs[1:]) - 1
                last = fit[np.maximum(k, 0)] if len(fit) else np.zeros(len(b), np.int64)
                fits = np.where((k >= 0) & (last >= offs[:-1]), last - offs[:-1] + 1, 0)
                out = [batch.column(i).slice(b.rows.start, len(b)) for i in range(len(fields))]
                out += [pa.array(np.diff(b.offs)), pa.array(total.astype(np.int64)), pa.array(fits.astype(np.int64))]
                if steps:
                    out.append(pa.array([np.diff(flat[i:j], prepend=0).astype("<i2").tobytes() for i, j in zip(offs[:-1], offs[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields] + ["n_bytes", "n_tokens", "fits_chars"] + ["steps"] * steps)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes long", "n_tokens long", "fits_chars long"] + ["steps binary"] * steps)
    return src.mapInArrow(run, schema)


def tokens_before(steps: bytes, chars: int) -> int:
    """Tokens of the first `chars` code points, from the steps of `prefix_counts`."""
    return int(np.frombuffer(steps, "<i2")[:chars].sum())


def longest_prefix(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    fit = np.flatnonzero(np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64) <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def within(table: DataFrame, budget: int = 1024) -> DataFrame:
    """`table` (from `prefix_counts` with steps) with `steps` replaced by n_tokens and fits_chars (code points of the longest
    prefix of at most `budget` tokens), both read off the stored counts: no text is seen."""
    src = table.select(*(c for c in table.columns if c not in ("n_tokens", "fits_chars", "steps")), "steps")
    fields = src.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            column = batch.column(len(fields))
            offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            raw = column.buffers()[2]
            total, fits = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            at = 0
            while at < len(column):  # about 2 MB of steps at once
                to = min(len(column), max(at + 1, int(np.searchsorted(offs, offs[at] + (2 << 20), side="right")) - 1))
                steps = np.frombuffer(raw, "<i2", (offs[to] - offs[at]) // 2, offs[at]) if offs[to] > offs[at] else np.zeros(0, "<i2")
                first, last = (offs[at:to] - offs[at]) // 2, (offs[at + 1 : to + 1] - offs[at]) // 2
                sums = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
                total[at:to] = sums[last] - sums[first]
                fit = np.flatnonzero(sums[1:] - np.repeat(sums[first], last - first) <= budget)
                k = np.searchsorted(fit, last) - 1
                found = fit[np.maximum(k, 0)] if len(fit) else np.zeros(to - at, np.int64)
                fits[at:to] = np.where((k >= 0) & (found >= first) & (last > first), found - first + 1, 0)
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(total), pa.array(fits)], names=[*(f.name for f in fields), "n_tokens", "fits_chars"])

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, fits_chars long"]))


def op8_prefix_tokens(spark, sf_dir: str) -> DataFrame:
    """The counts of all prefixes are stored once; totals and the budget of 1,024 tokens are then read off them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = within(stash(prefix_counts(docs, steps=True), "prefix_counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_chars")
