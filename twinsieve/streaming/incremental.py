"""Incremental scans: a new snapshot against the last one, and an inventory that arrives as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import once_repeated, repeated


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """canonical_path, change (added, removed, modified, same) between two inventories, by path, size and time."""
    a = previous.select("canonical_path", F.struct("file_size", "last_modified").alias("__a"))
    b = current.select("canonical_path", F.struct("file_size", "last_modified").alias("__b"))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "modified").otherwise("same")
    return a.join(b, "canonical_path", "full").select("canonical_path", kind.alias("change"))


def rescan(previous: DataFrame, current: DataFrame, hashed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Duplicates of `current` (canonical_path, file_size, last_modified): hashes of unchanged files are taken from
    `previous` (with content_hash), and only changed files of a size that repeats are read by `hashed`, once."""
    key = ["canonical_path", "file_size", "last_modified"]
    sized = repeated(current.where("file_size > 0"), ["file_size"])
    known = sized.join(previous.where("content_hash is not null").select(*key, "content_hash").dropDuplicates(key), key)
    fresh = hashed(sized.join(known.select(*key), key, "left_anti"))
    return once_repeated(known.select(*fresh.columns).unionByName(fresh), ["file_size", "content_hash"]).where("content_hash is not null")


def latest_files(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The latest version of each path of a stream (canonical_path, file_size, content_hash, seen_at), as an aggregate that
    a `complete` or `update` sink can hold."""
    rows = stream.withWatermark("seen_at", watermark)
    return rows.groupBy("canonical_path").agg(F.max_by(F.struct("file_size", "content_hash"), "seen_at").alias("it"), F.max("seen_at").alias("seen_at")).select("canonical_path", "it.*", "seen_at")


def duplicate_counts(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """file_size, content_hash, file_count, wasted_bytes of a stream of files; paths repeated inside the watermark count once."""
    once = stream.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["canonical_path", "content_hash"])
    counted = once.groupBy("file_size", "content_hash").agg(F.count("*").alias("file_count"))
    return counted.withColumn("wasted_bytes", F.col("file_size") * (F.col("file_count") - 1))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call a batch function on each new piece of a stream; the checkpoint keeps what has been done over restarts."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress:
    """Progress and cancellation of a job in named phases: tasks of a phase carry its tag and can be interrupted."""

    PHASES = ("scan", "hash", "write", "analysis")

    def __init__(self, spark, report: Callable[[str, str], None] = lambda phase, what: None):
        self.spark, self.report, self.cancelled = spark, report, False

    def run(self, phase: str, work: Callable[[], object]):
        """work()'s result; between phases a cancelled job stops."""
        if phase not in self.PHASES:
            raise ValueError(f"unknown phase {phase!r}")
        if self.cancelled:
            raise RuntimeError("cancelled")
        self.spark.addTag(f"twinsieve-{phase}")
        self.report(phase, "start")
        try:
            return work()
        finally:
            self.report(phase, "end")
            self.spark.removeTag(f"twinsieve-{phase}")

    def cancel(self) -> None:
        self.cancelled = True
        for phase in self.PHASES:
            self.spark.interruptTag(f"twinsieve-{phase}")
