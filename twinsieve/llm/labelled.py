"""Bounded samples of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null stays null."""
    return F.crc32(doc_id.cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, text: str = "text", salt: int = 7) -> DataFrame:
    """doc_id, text, y of at most `most` labelled doc_ids for which `allowed` (over labels) holds, drawn by a hash of the id, a
    row for each: of an id's texts that with the smallest hash.  Null ids and labels do not count; of contradicting labels
    the largest counts.  At most `most` ids, labels and hashes are sent to the executors."""
    c = F.col
    ids = labels.where(c("doc_id").isNotNull() & c(label).isNotNull() & F.coalesce(allowed, F.lit(False)))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(salt)))
    total = ids.count()
    if total > most:  # a range of hashes that holds a twentieth less than `most`, so that no more than that is collected
        ids = ids.where(F.pmod("h", F.lit(1 << 30)) < int(0.95 * most / total * (1 << 30)))
    found = sorted((tuple(r) for r in ids.select(F.pmod("h", F.lit(1 << 30)), "doc_id", "y").limit(2 * most).collect()))[:most]
    found = [r[1:] for r in found]
    known = docs.sparkSession.createDataFrame(found, "doc_id long, y int")
    named = docs.select("doc_id", c(text).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    own = named.join(F.broadcast(known), "doc_id")
    # the text of an id is chosen by its key, without the texts; equal rows have one key
    chosen = own.groupBy("doc_id").agg(F.min("key").alias("key"))  # a row an id: `most` at most
    return own.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
