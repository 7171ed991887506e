"""The stored relations as functions from relations to relations: upserts, sessions, decisions, hash cache.

Parquet has no update in place; a changed relation is written as a new snapshot (`write_snapshot`).  Natural keys stand
in for ids: a file is its path, a group (session, size, hash), a directory its path, a pair (smaller path, larger path).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep_old: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """new's rows, and old's rows without one there; `keep_old` columns of a row that both have stay as they were.
    Of new rows with one key, that with the largest `order` (a column of new, such as the time of writing) stays, so the
    last write wins; of equal ones, or without an order, that with the largest values."""
    rest = [c for c in old.columns if c not in key]
    values = F.struct(*rest)
    newest = F.max(values) if order is None else F.max_by(values, F.struct(F.col(order).alias("__order"), values.alias("__values")))
    latest = new.groupBy(*key).agg(newest.alias("__new"))
    before = old.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__old"))
    both = before.join(latest, list(key), "full")
    out = [F.when(F.col("__new").isNull() | (F.col("__old").isNotNull() & F.lit(c in keep_old)), F.col(f"__old.{c}")).otherwise(F.col(f"__new.{c}")).alias(c) for c in rest]
    return both.select(*key, *out).select(*old.columns)


def upsert_files(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """All columns but marked_deleted are overwritten."""
    return upsert(old, new, ["canonical_path"], keep_old=["marked_deleted"], order=order)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old, and those rows of new whose key old lacks (one a key)."""
    added = new.join(old.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    return old.unionByName(added.select(*old.columns))


def insert_or_replace(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return upsert(old, new, key)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def session_key(roots: Column) -> Column:
    """Sorted roots as JSON: equal for equal sets of roots."""
    return F.to_json(F.array_sort(F.array_distinct(roots)))


def find_or_create_session(sessions: DataFrame, roots: Sequence[str], session_id: str, started_at: str) -> DataFrame:
    """The session row to run under: the latest completed one of the same roots, started anew; else a new one."""
    spark = sessions.sparkSession
    key = spark.range(1).select(session_key(F.lit(list(roots)) if roots else F.array().cast("array<string>")).alias("root_paths"))
    same = sessions.where("status = 'completed'").join(F.broadcast(key), "root_paths")  # one row
    found = same.groupBy("root_paths").agg(F.max_by("session_id", F.struct("completed_at", "session_id")).alias("__found"))
    return key.join(found, "root_paths", "left").select(
        F.coalesce("__found", F.lit(session_id)).alias("session_id"), "root_paths", F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit("running").alias("status"), F.lit(0).cast("long").alias("files_scanned"), F.lit(0).cast("long").alias("total_bytes"), F.col("__found").isNotNull().alias("reused"),
    )


def complete_session(session: DataFrame, completed_at: str, duplicates: DataFrame) -> DataFrame:
    """The session's row as completed: files_scanned and total_bytes count its duplicates, as stored."""
    n = duplicates.agg(F.count("*").alias("__n"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("__b"))
    out = session.crossJoin(n)  # one row each
    return out.withColumn("status", F.lit("completed")).withColumn("completed_at", F.lit(completed_at).cast("timestamp")).withColumn("files_scanned", F.col("__n")).withColumn("total_bytes", F.col("__b")).drop("__n", "__b")


def delete_sessions(relation: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    """A relation without the rows of some sessions (None: of all); members go with their groups."""
    return relation.where("1 = 0") if ids is None else relation.where(~F.coalesce(F.col("session_id").isin(*ids), F.lit(False)) if ids else F.lit(True))


def forget_sessions(files: DataFrame, ids: Sequence[str] | None) -> DataFrame:
    """Files stay; last_seen_session_id of deleted sessions becomes null."""
    gone = F.lit(True) if ids is None else F.coalesce(F.col("last_seen_session_id").isin(*ids), F.lit(False))
    return files.withColumn("last_seen_session_id", F.when(~gone, F.col("last_seen_session_id")))


def fold_marks(log: DataFrame) -> DataFrame:
    """The plan after a log of canonical_path, kind (mark, unmark), strategy, marked_at, seq: the last event of a path;
    marking again clears executed_at."""
    last = log.groupBy("canonical_path").agg(F.max_by(F.struct("kind", "strategy", "marked_at"), "seq").alias("it"))
    return last.where("it.kind = 'mark'").select("canonical_path", "it.marked_at", "it.strategy", F.lit(None).cast("timestamp").alias("executed_at"))


def upsert_decisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Action, time and session are overwritten; the group of a known file stays."""
    return upsert(old, new, ["canonical_path"], keep_old=["group_hash"])


def migrate_plan(plan: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with a delete for each pending file that has none; group_hash '' where the file is in no group."""
    own = plan.where("executed_at is null").join(members.groupBy("canonical_path").agg(F.min("content_hash").alias("__h")), "canonical_path", "left")
    new = own.select("canonical_path", F.coalesce("__h", F.lit("")).alias("group_hash"), F.lit("delete").alias("action"))
    return insert_or_ignore(decisions.select("canonical_path", "group_hash", "action"), new, ["canonical_path"])


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("updated_at"), "id")


def with_cached_hash(files: DataFrame, cache: DataFrame, hashed) -> tuple[DataFrame, DataFrame]:
    """(files with content_hash, new cache): hashes known for (path, time) are taken, `hashed(rows)` gives the rest."""
    key = ["canonical_path", "last_modified"]
    known = cache.dropDuplicates(key)
    hits = files.join(known, key)
    misses = hashed(files.join(known.select(*key), key, "left_anti"))
    out = hits.select(*misses.columns).unionByName(misses)
    return out, known.unionByName(misses.select(*known.columns)).dropDuplicates(key)


def cache_count(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("keys"))


def clear(relation: DataFrame) -> DataFrame:
    return relation.where("1 = 0")


def write_snapshot(df: DataFrame, base: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a relation's snapshot; with partition_by only the partitions that df has (others stay)."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}/v{VERSION}")


def _paths(spark: SparkSession, base: str):
    """(file system, function from a name to its path below base)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: path(f"{base}/{name}")


def swap_snapshot(df: DataFrame, base: str) -> None:
    """Replace a snapshot by one that may be computed from it: written beside it, then renamed.  After a crash at any point
    `read_snapshot` finds the old one or the new one."""
    own = f"v{VERSION}.new-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{own}")
    fs, at = _paths(df.sparkSession, base)
    now, before = at(f"v{VERSION}"), at(f"v{VERSION}.old")
    if fs.exists(now):
        fs.delete(before, True)
        fs.rename(now, before)
    fs.rename(at(own), now)
    fs.delete(before, True)


def drop_other_versions(spark: SparkSession, base: str) -> list[str]:
    """Remove the snapshots of other layout versions, which this one cannot read; their names.  Relations are computed again."""
    fs, at = _paths(spark, base)
    if not fs.exists(at("")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(""))]
    old = sorted(n for n in names if re.fullmatch(r"v\d+(\..*)?", n) and n.split(".")[0] != f"v{VERSION}")
    for n in old:
        fs.delete(at(n), True)
    return old


def read_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    """The snapshot of this layout version; None if there is none: the relation is to be computed again."""
    from pyspark.errors import AnalysisException

    for name in (f"v{VERSION}", f"v{VERSION}.old"):
        try:
            return spark.read.parquet(f"{base}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return None
