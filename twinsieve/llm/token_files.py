"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus, so the most frequent 256 take one byte.  Two bits an id give its number of
bytes; four of them are a control byte, and control bytes and data bytes lie apart, so numpy decodes a block by looking
its control bytes up in a table of 256 rows and gathering.

1. Texts are tokenized once; the ids go to the shared folder, each row with a random number.  2. Ids are counted in each
task, then summed: a row a vocabulary entry.  3. A bounded sample gives bounds of (doc_id, random number) that cut the
corpus into files of about equal size, also where one doc_id has a third of all rows.  Documents are coded once, sent to
their file's task and written whole or not at all, in ascending doc_id.  4. Sums over files give where each file starts.
Reading needs the manifest and the rank table alone.

Null texts are empty: one document of the end id.  Null doc_ids come first.  Repeated doc_ids and equal rows each get
their own range of ids, in a file shorter documents first, equal ones in either order.  Texts of any length are coded
whole.  Empty tables give no files and an empty result.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .pieces import default_path, encoder
from .scratch import filesystem, fresh, put, stash

END_ID = 2
BLOCK_IDS = 2_000_000
#: Ids in a file: so many at most on average, unless there would be more than MOST_FILES; and so many at least in one of several.
FILE_IDS, LEAST_IDS, MOST_FILES = 64_000_000, 1_000_000, 20_000
#: Rows of the sample that bounds come from, for each file.
SAMPLE = 50
MAGIC = b"TSVB0001"
#: Row c: the byte lengths that control byte c stands for.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def encode_values(values: np.ndarray, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each place) of unsigned 32-bit values, four to a control byte; places
    that `real` does not mark are padding without data."""
    values = values.astype(np.uint32)
    pad = -len(values) % 4
    real = np.ones(len(values), bool) if real is None else real
    if pad:
        values, real = np.concatenate((values, np.zeros(pad, np.uint32))), np.concatenate((real, np.zeros(pad, bool)))
    size = np.ones(len(values), np.int64)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        size += values > top
    codes = (size - 1).astype(np.uint8).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    size *= real
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        data[at[own] + k] = (values[own] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data, size


def decode_values(control: np.ndarray, data: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
    """The values; `real` marks which of the four places of each control byte hold one (None: all)."""
    size = LENGTHS[control].ravel().astype(np.int64)
    if real is not None:
        size = size[real]
    at = np.cumsum(size) - size
    out = np.zeros(len(size), np.uint32)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[own] |= data[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_ids(docs: DataFrame, path: str, end_id: int | None = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, draw (a random number) and ids (unsigned 32-bit or, for vocabularies below 65,536, 16-bit integers,
    little-endian) of each row."""
    from .pieces import tokenizer

    kind = np.dtype("<u2") if tokenizer(path).get_vocab_size() < 65_536 else np.dtype("<u4")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    end = [] if end_id is None else [end_id]

    def run(batches):
        rng = np.random.default_rng([17, TaskContext.get().partitionId()])  # a task that runs again draws the same
        for batch in batches:
            for b in blocks(batch.column(1), 2 << 20):
                ids, offs = encoder(path).encode(b)
                ids = np.insert(ids, offs[1:], end[0]) if end else ids
                offs = offs + np.arange(len(offs)) if end else offs
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                offs = pa.py_buffer((offs * kind.itemsize).astype(np.int32).tobytes())
                column = pa.Array.from_buffers(pa.binary(), len(b), [None, offs, raw])
                draw = pa.array(rng.integers(0, 1 << 62, len(b)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.rows.start, len(b)), draw, column], names=["doc_id", "draw", "ids"])

    return src.mapInArrow(run, "doc_id long, draw long, ids binary")


class Bounds:
    """Where files begin: file k holds rows from bound k - 1 on, in the order of doc_id (null first), draw."""

    def __init__(self, rows: list[tuple[int | None, int, int]], files: int):
        """From a sample of rows (doc_id, draw, size)."""
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        size = np.cumsum([r[2] for r in rows], dtype=float) if rows else np.zeros(0)
        at = np.unique(np.searchsorted(size, np.arange(1, files) * (size[-1] / files))) if len(size) else np.zeros(0, int)
        cut = [rows[i] for i in at.tolist() if i < len(rows)]
        self.nulls = np.array([r[1] for r in cut if r[0] is None], np.int64)
        self.ids, self.draws = (np.array([r[k] for r in cut if r[0] is not None], np.int64) for k in (0, 1))

    def __len__(self) -> int:
        """How many files."""
        return len(self.nulls) + len(self.ids) + 1

    def files(self, doc_id: pa.Array, draw: np.ndarray) -> np.ndarray:
        null = doc_id.is_null().to_numpy(zero_copy_only=False)
        ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(self.ids, ids, side=side) for side in ("left", "right"))
        out = len(self.nulls) + high
        for k in np.unique(low[(low < high) & ~null]).tolist():  # bounds within one doc_id
            own = np.flatnonzero((low == k) & (high > k) & ~null)
            out[own] = len(self.nulls) + k + np.searchsorted(self.draws[k : high[own[0]]], draw[own], side="right")
        out[null] = np.searchsorted(self.nulls, draw[null], side="right")
        return out


def file_bounds(ids: DataFrame, total: int) -> Bounds:
    """For about equal files of `total` ids, from SAMPLE rows a file."""
    files = max(-(-total // FILE_IDS), min(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_IDS)), 1)
    files, rows = min(files, MOST_FILES), ids.count()
    if files == 1 or not rows:
        return Bounds([], 1)
    share = min(1.0, SAMPLE * files / rows)
    drawn = ids.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "draw", F.octet_length("ids"))
    return Bounds([tuple(r) for r in drawn.collect()], files)  # about SAMPLE * MOST_FILES rows at most


def _ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of a binary column, offsets of the rows in them)."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (offs - offs[0]) // kind.itemsize


def _slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes in a binary column (one row at least)."""
    col = batch.column(column)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = min(len(col), max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def id_counts(ids: DataFrame, kind: np.dtype, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in (x for b in batches for x in _slices(b, 0)):
            total += np.bincount(_ids(batch.column(0), kind)[0], minlength=vocabulary)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int64)), pa.array(total[have])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id at most
        out[r["id"]] = r["n"]
    return out


def coded(ids: DataFrame, kind: np.dtype, rank: np.ndarray, bounds: Bounds) -> DataFrame:
    """shard (number of the file), doc_id, n, control, data: each document coded by itself."""

    def run(batches):
        for batch in (x for b in batches for x in _slices(b, 2)):
            own, offs = _ids(batch.column(2), kind)
            n = np.diff(offs)
            places = -(-n // 4) * 4  # the codes of each document fill whole control bytes
            first = np.concatenate(([0], np.cumsum(places)))
            values = np.zeros(int(first[-1]), np.uint32)
            real = np.zeros(len(values), bool)
            at = np.arange(len(own)) + np.repeat(first[:-1] - offs[:-1], n)
            values[at], real[at] = rank[own], True
            control, data, size = encode_values(values, real)
            ends = np.concatenate(([0], np.cumsum(size)))[first]
            column = lambda raw, offs: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            shard = bounds.files(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
            cols = [pa.array(shard.astype(np.int32)), batch.column(0), pa.array(n), column(control, first // 4), column(data, ends)]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "doc_id", "n", "control", "data"])

    return ids.mapInArrow(run, "shard int, doc_id long, n long, control binary, data binary")


def _block(rows: list[tuple]) -> bytes:
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], np.uint8)
    n = np.array([r[1] for r in rows], "<i8")
    control, data = b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)
    return struct.pack("<QQQ", len(rows), len(control), len(data)) + ids.tobytes() + null.tobytes() + n.tobytes() + control + data


def write_files(docs: DataFrame, base: str) -> DataFrame:
    """Files of rows (shard, doc_id, n, control, data), which lie sorted in the partitions, a shard in one: file, shard, n_docs,
    n_ids."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            uri, docs_in, ids_in = f"{base}/{shard:06d}.ids", 0, 0

            def parts(own=own) -> Iterator[bytes]:
                nonlocal docs_in, ids_in
                yield MAGIC
                held, size = [], 0
                for row in own:
                    held.append(row[1:])
                    size += row[2]
                    docs_in, ids_in = docs_in + 1, ids_in + row[2]
                    if size >= BLOCK_IDS:
                        yield _block(held)
                        held, size = [], 0
                if held:
                    yield _block(held)

            put(uri, parts())
            yield pa.RecordBatch.from_pylist([{"file": uri, "shard": shard, "n_docs": docs_in, "n_ids": ids_in}])

    return docs.mapInArrow(run, "file string, shard long, n_docs long, n_ids long")


def read_blocks(uri: str, by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids in each, all ids) of the blocks of a file."""
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        while head := f.read(24):
            docs, n_control, n_data = struct.unpack("<QQQ", head)
            ids, null = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), np.uint8)
            n = np.frombuffer(f.read(8 * docs), "<i8")
            control, data = np.frombuffer(f.read(n_control), np.uint8), np.frombuffer(f.read(n_data), np.uint8)
            places = -(-n // 4) * 4
            real = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places) < np.repeat(n, places)
            yield [None if z else i for i, z in zip(ids.tolist(), null.tolist(), strict=True)], n, by_rank[decode_values(control, data, real)]


def write_corpus(docs: DataFrame, base: str | None = None, path: str | None = None, end_id: int | None = END_ID) -> tuple[DataFrame, str]:
    """(manifest: file, shard, n_docs, n_ids, start; URI of the rank table) of the files written for docs."""
    from .pieces import tokenizer

    path, base = path or default_path(), base or fresh(docs.sparkSession, "token_files")
    vocabulary = max(tokenizer(path).get_vocab_size(), (end_id or 0) + 1)
    kind = np.dtype("<u2") if tokenizer(path).get_vocab_size() < 65_536 else np.dtype("<u4")
    ids = stash(token_ids(docs, path, end_id), "token_ids")
    counts = id_counts(ids, kind, vocabulary)
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    put(f"{base}/ranks", [by_rank.tobytes()])
    bounds = file_bounds(ids, int(counts.sum()))
    rows = coded(ids, kind, rank, bounds).repartitionById(len(bounds), F.col("shard"))
    rows = rows.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n", "control", "data")
    manifest = stash(write_files(rows, base), "token_manifest")
    at, starts = 0, []
    for shard, n in sorted(tuple(r) for r in manifest.select("shard", "n_ids").collect()):  # a row a file
        starts.append((shard, at))
        at += n
    starts = docs.sparkSession.createDataFrame(starts, "shard long, start long")
    return manifest.join(F.broadcast(starts), "shard"), f"{base}/ranks"


def read_corpus(manifest: DataFrame, ranks: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of all documents, from the files."""

    def run(batches):
        system, path = filesystem(ranks)
        with system.open_input_stream(path) as f:
            by_rank = np.frombuffer(f.readall(), "<u4")
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids, n, flat in read_blocks(uri, by_rank):
                    offs = np.concatenate(([0], np.cumsum(n)))
                    raw = flat.astype("<u4").tobytes()
                    own = [raw[4 * i : 4 * j] for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                    cols = [pa.array(ids, pa.int64()), pa.array(offs[:-1] + at), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in own], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    at += int(n.sum())

    files = manifest.select("file", "start", "shard")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    n = (files.agg(F.max("shard")).first()[0] or 0) + 1  # a task a file
    return files.repartitionById(n, F.col("shard").cast("int")).mapInArrow(run, schema)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    return read_corpus(*write_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")))
