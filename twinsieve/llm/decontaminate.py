"""Benchmark decontamination: a hash set of normalised benchmark word windows, probed by every window of every text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A benchmark item gives each run of `size` words, or
all its words as one window if it has fewer.  Tasks write the windows with their items to block files of about
BLOCK_WINDOWS in the shared folder, and a bloom filter of each block.  A worker holds the filters of all blocks
(FILTER_BYTES at most, so they are the broadcast set), hashes the windows of a batch of texts once (numpy, no object per
word), and loads a block only for windows that pass: 1 in 400 of those that are in no item, up to 32 million benchmark
windows.  A block is arrays (sorted hashes, words, items) in an Arrow file, and a worker keeps blocks up to HELD_BYTES.  Hits are
verified by comparing the words themselves.  Texts are never shuffled.

Null texts and items have no words; a null item_id counts as the id ''.  Equal item_ids are one item, repeated
documents are each judged alone; texts of any length are scanned whole.  Extra columns are not looked at (those of `keep`
that bear the name of a result are an error); an empty benchmark or table works.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, Words, blocks, mix, windows
from .columns import hide, no_clash, restore
from .scratch import filesystem, fresh, put, stash

SIZE = 10
#: Windows in a block: about 20 MB; bytes of blocks that a worker keeps (the block in use is kept in any case).
BLOCK_WINDOWS, HELD_BYTES = 200_000, 256 << 20
#: Bits that a window sets in its block's filter.
PROBES = 4
#: Bytes of all filters together, at most: 16 bits a window as long as these suffice.
FILTER_BYTES = 64 << 20
#: Windows that passed the filter and are looked up together.
PASSED = 50_000


def _filter_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) places of hashes in a filter of `bits` bits, all told by the one hash."""
    step = mix(hashes) | np.uint64(1)
    return np.stack([((mix(hashes + np.uint64(k) * step) >> np.uint64(20)) % np.uint64(bits)).astype(np.int64) for k in range(PROBES)])


class Block:
    """The windows of a block: hashes (sorted), and for each its words and items."""

    def __init__(self, table: pa.Table):
        self.bytes = table.nbytes
        self.hash = table.column("hash").to_numpy()
        self.words, self.items = (table.column(k).combine_chunks() for k in ("words", "items"))

    def items_of(self, h: int, words: bytes) -> list[str] | None:
        """The items that have the window; of windows of one hash that with these words."""
        at = int(np.searchsorted(self.hash, h))
        while at < len(self.hash) and self.hash[at] == h:
            if self.words[at].as_py() == words:
                return self.items[at].as_py()
            at += 1
        return None


class Index:
    """The block files below `base`; block of a window: its hash modulo the number of blocks."""

    def __init__(self, base: str, blocks: int, bits: int, lengths: list[int]):
        self.base, self.blocks, self.bits, self.lengths = base, blocks, bits, lengths

    def __len__(self) -> int:
        return self.blocks

    def worker(self) -> IndexReader:
        """This process's reader."""
        if self.base not in _readers:
            _readers.clear()
            _readers[self.base] = IndexReader(self)
        return _readers[self.base]


class IndexReader:
    def __init__(self, index: Index):
        self.index, self.held, self.loads = index, {}, 0
        self.filters = np.zeros((index.blocks, index.bits // 8), np.uint8)
        for k in range(index.blocks):
            raw = self._read(f"{k}.filter")
            if raw is not None:
                self.filters[k] = np.frombuffer(raw, np.uint8)

    def _read(self, name: str) -> bytes | None:
        system, path = filesystem(f"{self.index.base}/{name}")
        try:
            with system.open_input_stream(path) as f:
                return f.readall()
        except FileNotFoundError:  # a block without windows has no files
            return None

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of the hashes that pass their block's filter."""
        block = (h % np.uint64(self.index.blocks)).astype(np.int64)
        left = np.arange(len(h))
        for place in _filter_bits(h, self.index.bits):
            bit = place[left]
            left = left[((self.filters[block[left], bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)]
        return left

    def block(self, k: int) -> Block | None:
        """The block; None if it has no windows."""
        if k in self.held:
            self.held[k] = self.held.pop(k)  # the last to go
            return self.held[k]
        raw = self._read(f"{k}.block")
        self.loads += 1
        self.held[k] = None if raw is None else Block(pa.ipc.open_file(pa.py_buffer(raw)).read_all())
        while len(self.held) > 1 and sum(b.bytes for b in self.held.values() if b) > HELD_BYTES:
            self.held.pop(next(iter(self.held)))
        return self.held[k]


_readers: dict[str, IndexReader] = {}


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """hash, length, words, item: the windows of a benchmark's items."""
    src = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for b in blocks(batch.column(1)):
                w = Words(b, ALNUM, lower=True)
                out = []
                counts = w.counts
                for n in sorted({size, *counts[(counts > 0) & (counts < size)].tolist()}):
                    at, h = windows(w, n)
                    if n < size:
                        own = counts[w.row[at]] == n
                        at, h = at[own], h[own]
                    out += [(k, n, w.text(i, i + n), ids[b.rows.start + w.row[i]]) for i, k in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("hash", "length", "words", "item"), x, strict=True)) for x in out],
                    schema=pa.schema([("hash", pa.int64()), ("length", pa.int32()), ("words", pa.binary()), ("item", pa.string())]),
                )

    return src.mapInArrow(run, "hash long, length int, words binary, item string")


def build_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> Index:
    """The index of a benchmark, written by the tasks that hold a block's windows."""
    spark = benchmark.sparkSession
    table = stash(item_windows(benchmark, item_id, text, size), "benchmark_windows")
    sizes = table.groupBy("length").count().collect()  # a row a window length, at most `size`
    n = max(1, -(-sum(r["count"] for r in sizes) // BLOCK_WINDOWS))
    bits = min(16 * BLOCK_WINDOWS, FILTER_BYTES * 8 // n) // 8 * 8
    base = fresh(spark, "benchmark_index")

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for block, own in groupby(rows, key=lambda r: r[0]):
            hashes, texts, items = [], [], []
            for _, h, words, item in own:  # sorted, so an item that a window has twice comes twice in a row
                if not hashes or hashes[-1] != h or texts[-1] != words:
                    hashes.append(h)
                    texts.append(words)
                    items.append([item])
                elif items[-1][-1] != item:
                    items[-1].append(item)
            filt, h = np.zeros(bits // 8, np.uint8), np.array(hashes, np.int64)
            for place in _filter_bits(h.view(np.uint64), bits):
                np.bitwise_or.at(filt, place >> 3, (1 << (place & 7)).astype(np.uint8))
            put(f"{base}/{block}.filter", [filt.tobytes()])
            table, out = pa.table({"hash": h, "words": pa.array(texts, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}), pa.BufferOutputStream()
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table)
            put(f"{base}/{block}.block", [out.getvalue()])
            yield pa.RecordBatch.from_pylist([{"block": block, "windows": len(h)}], schema=pa.schema([("block", pa.int32()), ("windows", pa.int64())]))

    # the hash as an unsigned number modulo n, which is the signed one's and that of 2**64 where it is negative
    unsigned = F.pmod(F.pmod("hash", F.lit(n)) + F.when(F.col("hash") < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))
    rows = table.select(unsigned.cast("int").alias("block"), "hash", "words", "item").repartitionById(n, F.col("block"))
    rows.sortWithinPartitions("block", "hash", "words", "item").mapInArrow(run, "block int, windows long").agg(F.sum("windows")).collect()
    return Index(base, n, bits, sorted(r["length"] for r in sizes))


class _Hits:
    """Hit words and items of the rows of a batch."""

    def __init__(self, reader: IndexReader):
        self.reader, self.words, self.items, self.waiting = reader, {}, {}, []

    def add(self, h: int, words: bytes, row: int, at: int, size: int, row_words: int) -> None:
        """A window that passed: `size` words of a row of `row_words`, from its word `at` on."""
        self.waiting.append((h % self.reader.index.blocks, h - ((h >> 63) << 64), words, row, at, size, row_words))
        if len(self.waiting) >= PASSED:
            self.look_up()

    def look_up(self) -> None:
        self.waiting.sort(key=lambda x: x[0])  # each block is loaded once
        for block, h, words, row, at, size, row_words in self.waiting:
            own = self.reader.block(block)
            found = own and own.items_of(h, words)
            if found:
                if row not in self.words:
                    self.words[row], self.items[row] = np.zeros(row_words, bool), set()
                self.words[row][at : at + size] = True
                self.items[row].update(found)
        self.waiting = []


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit runs (from a run's first word to its last)."""
    b = next(blocks(pa.array([text])))
    w = Words(b, ALNUM, lower=True)
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    parts, at = [], 0
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        parts.append(b.data[at : w.start[s]].tobytes())
        at = w.end[e - 1]
    parts.append(b.data[at:].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def scan(docs: DataFrame, index: Index, text: str = "text", keep: tuple[str, ...] = ("doc_id",), cleaned: bool = False) -> DataFrame:
    """`keep`, n_words, n_hit, items (array), and with `cleaned` the text without the hit spans as `cleaned`."""
    no_clash(keep, "n_words", "n_hit", "items", "cleaned")
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = src.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            texts, hits, counts = batch.column(len(fields)), _Hits(index.worker()), []
            for b in blocks(texts):
                w = Words(b, ALNUM, lower=True)
                counts.append(w.counts)
                for n in index.lengths:
                    at, h = windows(w, n)
                    for k in hits.reader.maybe(h).tolist():
                        i = int(at[k])
                        row = int(w.row[i])
                        hits.add(int(h[k]), w.text(i, i + n), b.rows.start + row, i - int(w.first[row]), n, int(counts[-1][row]))
            hits.look_up()
            n_hit = np.zeros(batch.num_rows, np.int64)
            for row, hit in hits.words.items():
                n_hit[row] = hit.sum()
            out = [pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.array(n_hit), pa.array([sorted(hits.items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string()))]
            if cleaned:
                if not hits.words:
                    out.append(texts.cast(pa.string()))
                else:
                    now = texts.to_pylist()
                    for row, hit in hits.words.items():
                        now[row] = _without(now[row], hit)
                    out.append(pa.array(now, pa.string()))
            names = [f.name for f in fields] + ["n_words", "n_hit", "items"] + ["cleaned"] * cleaned
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), *out], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_words long", "n_hit long", "items array<string>"] + ["cleaned string"] * cleaned)
    return src.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", size: int = SIZE) -> DataFrame:
    """docs without the documents that share a window with the benchmark, or (remove="spans") without the spans."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    index = build_index(benchmark, size=size)
    hidden, names = hide(docs)
    if remove == "documents":
        return restore(scan(hidden, index, names[text], tuple(names.values())).where("n_hit = 0"), names)
    kept = tuple(new for old, new in names.items() if old != text)
    return restore(scan(hidden, index, names[text], kept, cleaned=True), names | {text: "cleaned"})


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs, build_index(bench))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
