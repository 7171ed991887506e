"""Near-duplicate files by content-defined chunks: bytes that are inserted change the chunks around them and no others.

A rolling hash over the last WINDOW bytes says where a chunk ends: where its lowest bits are zero, so that chunks have about
`average` bytes, `least` at least and `most` at most.  Equal stretches of two files therefore come to be cut at equal places
whatever lies before them.  A chunk is told by its MD5 digest; two files are near-duplicates if the smaller one's bytes lie in chunks of
the other for a share of `threshold` at least (containment, weighted by bytes).

The join is exact, without a cap on how frequent a chunk may be: chunks stand in one order, rare ones first, and a file
that reaches the threshold with a larger one has one of its own first chunks in common with it, those before the bytes
that it may miss run out.  Only these are looked up in other files, and the bytes in common are counted for the
pairs found.  Files of equal chunk sets are one class, of which the smallest path alone is joined.

Null and empty contents have no chunks and are in no pair.  A chunk that a file has several times counts once.  A row's
content is cut whole, in memory; the chunks of one file are ordered in one task, which spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stash
from .similarity import equal_classes, frequencies

LEAST, AVERAGE, MOST, WINDOW = 64, 256, 2_048, 16


def _gears() -> np.ndarray:
    """A 32-bit number for each byte, by a rule (the finisher of a common mixing function)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def marks(data: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Places (behind a byte) where a chunk may end: told by the WINDOW bytes before it alone."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    g = GEARS[data]
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):  # each byte by its distance from the end
        h += g[k : k + n] * np.uint32(2 * (WINDOW - k) * 0x01000193 | 1)
    h ^= h >> np.uint32(15)
    return np.flatnonzero(h & np.uint32(average - 1) == 0) + WINDOW


def cuts(data: np.ndarray, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[int]:
    """Where the chunks of a file end.  `average` is a power of two."""
    out, at, n = [], 0, len(data)
    for m in [*marks(data, average).tolist(), n]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or (m == n and m > at):
            at = m
            out.append(at)
    return out


def file_chunks(files: DataFrame, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> DataFrame:
    """canonical_path, chunk (MD5), weight (bytes), of the distinct chunks of files (canonical_path, content)."""
    import pyarrow as pa

    def run(batches: Iterator):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_buffer() if content.is_valid else b""
                data = np.frombuffer(content, np.uint8)
                ends, found, start = cuts(data, least, average, most), {}, 0
                for end in ends:
                    found[hashlib.md5(data[start:end]).hexdigest()] = end - start
                    start = end
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["canonical_path", "chunk", "weight"])

    return files.select("canonical_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "canonical_path string, chunk string, weight long")


def first_chunks(elements: DataFrame, threshold: float) -> DataFrame:
    """The rows (entity, element, weight, total) of each set that a set which holds `threshold` of its weight has one of: in the common
    order, rare elements first, those with less than what may be missing before them."""
    c = F.col
    order = [c("frequency").asc(), c("element").asc()]
    placed = elements.join(frequencies(elements), "element")
    before = F.coalesce(F.sum("weight").over(W.partitionBy("entity").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__before", before).withColumn("total", F.sum("weight").over(W.partitionBy("entity")))
    return placed.where(c("__before") <= c("total") * F.lit(1 - threshold) + 1e-6).select("entity", "element", "weight", "total")


def contained(elements: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(entity_a < entity_b, shared (weight), containment: pairs of sets of elements (entity, element, weight) of which the lighter has
    `threshold` of its weight in the other; entity, representative, members of equal sets).  Of equal sets the smallest entity alone
    is in pairs."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    c = F.col
    elements = stash(elements, "chunks")
    classes = stash(equal_classes(elements), "chunk_classes")
    own = stash(elements.join(classes.where("entity <> representative").select("entity"), "entity", "left_anti"), "chunk_sets")
    keys = first_chunks(own, threshold).select(c("entity").alias("small"), "element", c("total").alias("small_total"))
    totals = own.groupBy("entity").agg(F.sum("weight").alias("large_total"))
    others = own.select(c("entity").alias("large"), "element").join(totals.withColumnRenamed("entity", "large"), "large")
    lighter = (c("small_total") < c("large_total")) | ((c("small_total") == c("large_total")) & (c("small") < c("large")))
    met = stash(keys.join(others, "element").where(lighter).select("small", "large", "small_total").distinct(), "chunk_pairs")
    a = own.select(c("entity").alias("small"), "element", "weight")
    b = own.select(c("entity").alias("large"), "element")
    shared = met.join(a, "small").join(b, ["large", "element"]).groupBy("small", "large", "small_total").agg(F.sum("weight").alias("shared"))
    shared = shared.withColumn("containment", c("shared") / c("small_total")).where(c("containment") >= threshold)
    return shared.select(F.least("small", "large").alias("entity_a"), F.greatest("small", "large").alias("entity_b"), "shared", "containment"), classes


def near_duplicate_files(files: DataFrame, threshold: float = 0.5, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """`contained` of the chunks of files (canonical_path, content)."""
    chunks = file_chunks(files, least, average, most)
    return contained(chunks.select(F.col("canonical_path").alias("entity"), F.col("chunk").alias("element"), "weight"), threshold)
