"""Exact duplicates by a cascade: size, then a digest of the first bytes, then a digest of all bytes.

Contents are read and digested once, in the scan, and dropped before any shuffle: the slim rows of path, size and digests
are written to the shared folder, counted there by key, and kept by a semi-join with the keys that repeat, so a group of
any size is never gathered.  The price is that contents of all sizes are digested (one pass at the speed of the digest),
where a cascade over files that can be opened again (`sources.inventory.find_duplicate_files`) reads only what the stage
before has left.  A key is (size, digest), with the columns of `within`
(such as a session) in front.  Empty files are no duplicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digest
from ..sources.shared import stash

PREFIX_BYTES = 1024


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys occur more than once.  `df` is evaluated twice, for the keys and for the rows: pass a table, or what
    is as cheap (`once_repeated` for anything else)."""
    often = df.groupBy(*keys).count().where("count > 1").select(*keys)
    return df.join(often, list(keys), "left_semi")


def once_repeated(df: DataFrame, keys: Sequence[str], name: str = "digests") -> DataFrame:
    """`repeated`, with df evaluated once and written to the shared folder, now."""
    return repeated(stash(df, name), keys)


def same_size(files: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    return repeated(files.where("file_size > 0"), [*within, "file_size"])


def digested(files: DataFrame, algorithm: str = "md5", prefix: int | None = PREFIX_BYTES, whole: bool = True) -> DataFrame:
    """Files that are not empty, with partial_hash (unless prefix is None) and content_hash (if whole) instead of the content."""
    out = files.where("file_size > 0")
    if prefix is not None:
        out = out.withColumn("partial_hash", digest(F.substring("content", 1, prefix), algorithm))
    if whole:
        out = out.withColumn("content_hash", digest(F.col("content"), algorithm))
    return out.drop("content")


def same_prefix(files: DataFrame, within: Sequence[str] = (), algorithm: str = "md5", prefix: int = PREFIX_BYTES) -> DataFrame:
    """Rows of `files` that agree in size and in a digest of their first bytes, with partial_hash, without the content."""
    return once_repeated(digested(files, algorithm, prefix, whole=False), [*within, "file_size", "partial_hash"])


def find_duplicates(files: DataFrame, within: Sequence[str] = (), algorithm: str = "md5", prefix: int = PREFIX_BYTES) -> DataFrame:
    """Rows of `files` that agree in size and content (and so in their first bytes), with partial_hash and content_hash,
    without the content."""
    return duplicates(stash(digested(files, algorithm, prefix), "digests"), within)


def duplicates(digests: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The duplicates among a table that `digested` has given."""
    return repeated(digests, [*within, "file_size", "content_hash"])


def groups(duplicates: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """within, file_size, content_hash, file_count, wasted_bytes."""
    counted = duplicates.groupBy(*within, "file_size", "content_hash").agg(F.count("*").alias("file_count"))
    return counted.withColumn("wasted_bytes", F.col("file_size") * (F.col("file_count") - 1))


def members(duplicates: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """within, file_size, content_hash, canonical_path; one row a path, however often it is listed."""
    return duplicates.select(*within, "file_size", "content_hash", "canonical_path").dropDuplicates([*within, "file_size", "content_hash", "canonical_path"])


def scan_stats(files: DataFrame) -> DataFrame:
    """distinct_sizes, files, bytes of what a scan found."""
    return files.where("file_size > 0").agg(
        F.countDistinct("file_size").alias("distinct_sizes"), F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes")
    )


def scan_result(files: DataFrame, within: Sequence[str] = (), algorithm: str = "md5", prefix: int = PREFIX_BYTES) -> DataFrame:
    """One row: files_walked, size_candidates, prefix_candidates, duplicate_files, duplicate_groups, wasted_bytes.

    One scan: files are counted by all three keys, and the counts are added up from the longest key to the shortest."""
    c, n = F.col, F.sum("n").alias("n")
    repeats = lambda x: F.when(c("n") > 1, x).otherwise(F.lit(0).cast("long"))
    adds = lambda *names: [F.sum(x).alias(x) for x in names]
    size, ends = [*within, "file_size"], ("duplicate_groups", "duplicate_files", "wasted_bytes")
    whole = digested(files, algorithm, prefix).groupBy(*size, "partial_hash", "content_hash").agg(F.count("*").alias("n"))
    whole = whole.withColumns({"duplicate_groups": repeats(F.lit(1).cast("long")), "duplicate_files": repeats(c("n")), "wasted_bytes": repeats(c("file_size") * (c("n") - 1))})
    first = whole.groupBy(*size, "partial_hash").agg(n, *adds(*ends)).withColumn("prefix_candidates", repeats(c("n")))
    sizes = first.groupBy(*size).agg(n, *adds("prefix_candidates", *ends)).withColumn("size_candidates", repeats(c("n")))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return sizes.agg(total("n", "files_walked"), *(total(x, x) for x in ("size_candidates", "prefix_candidates", *ends)))
