"""Queries over duplicate groups, files, directories and sessions.

Relations: groups (session_id, file_size, content_hash, file_count, wasted_bytes), files (canonical_path, file_name,
parent_dir, drive_letter, file_size, last_modified), members (session_id, file_size, content_hash, canonical_path),
decisions (canonical_path, action), plan (canonical_path, executed_at), sessions.  A group is named by GROUP.  Every
order ends in a unique key, so pages do not overlap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CATEGORIES, extension, like_pattern

GROUP = ["session_id", "file_size", "content_hash"]


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def groups_of_session(groups: DataFrame, session: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    return page(groups.where(F.col("session_id") == session), [F.desc("wasted_bytes"), F.asc("content_hash"), F.asc("file_size")], offset, limit)


def files_in_groups(members: DataFrame, files: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """GROUP, canonical_path, file_name, last_modified and pending (whether a deletion is planned and not executed)."""
    out = members.join(files.select("canonical_path", "file_name", "parent_dir", "drive_letter", "last_modified"), "canonical_path")
    if plan is None:
        return out
    pending = plan.where("executed_at is null").select("canonical_path", F.lit(True).alias("__pending")).distinct()
    out = out.join(pending, "canonical_path", "left")
    return out.withColumn("pending", F.coalesce("__pending", F.lit(False))).drop("__pending")


def files_with_copies(members: DataFrame, files: DataFrame) -> DataFrame:
    """Files of groups with copy_count, for an order of newest first, then path."""
    counts = members.groupBy(*GROUP).agg(F.count("*").alias("copy_count"))
    return files_in_groups(members, files).join(counts, GROUP).orderBy(F.desc("last_modified"), "canonical_path")


def totals(groups: DataFrame) -> DataFrame:
    """group_count, total_wasted (0 without groups)."""
    return groups.agg(F.count("*").alias("group_count"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).cast("long").alias("total_wasted"))


def sessions_with_groups(sessions: DataFrame, groups: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sessions newest first, with group_count."""
    n = groups.groupBy("session_id").agg(F.count("*").alias("group_count"))
    out = sessions.join(n, "session_id", "left").withColumn("group_count", F.coalesce("group_count", F.lit(0)).cast("long"))
    return page(out, [F.desc("started_at"), F.asc("session_id")], offset, limit)


def latest_completed(sessions: DataFrame) -> DataFrame:
    return page(sessions.where("status = 'completed'"), [F.desc("completed_at"), F.desc("session_id")], 0, 1)


@dataclass(frozen=True)
class GroupFilter:
    """Conditions that all must hold; None: not asked.  status: unreviewed, partial or decided."""

    text: str | None = None
    file_type: str | None = None
    drive: str | None = None
    status: str | None = None
    min_wasted: int | None = None
    max_wasted: int | None = None


SORTS = {"wasted": "wasted_bytes", "size": "file_size", "count": "file_count", "name": "sample_name"}


def group_status(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """GROUP, n_files, n_decided, status: none decided, all decided, else partial."""
    decided = decisions.select("canonical_path", F.lit(1).alias("__d")).distinct()
    out = members.join(decided, "canonical_path", "left").groupBy(*GROUP).agg(F.count("*").alias("n_files"), F.count("__d").alias("n_decided"))
    status = F.when(F.col("n_decided") == 0, "unreviewed").when(F.col("n_decided") == F.col("n_files"), "decided").otherwise("partial")
    return out.withColumn("status", status)


def matching_groups(groups: DataFrame, members: DataFrame, files: DataFrame, decisions: DataFrame, session: str, by: GroupFilter) -> DataFrame:
    """The groups of a session that a filter lets through, each with sample_name (the smallest file name)."""
    out = groups.where(F.col("session_id") == session)
    if by.min_wasted is not None:
        out = out.where(F.col("wasted_bytes") >= by.min_wasted)
    if by.max_wasted is not None:
        out = out.where(F.col("wasted_bytes") <= by.max_wasted)
    own = members.where(F.col("session_id") == session).join(files.select("canonical_path", "file_name", "drive_letter"), "canonical_path")
    tests = []
    if by.text:
        tests.append(F.col("file_name").ilike(like_pattern(by.text)))
    if by.file_type is not None:
        tests.append(extension(F.col("file_name")).isin(*CATEGORIES.get(by.file_type, ("",))))
    if by.drive:
        tests.append(F.col("drive_letter") == by.drive)
    # one aggregate answers all "some member ..." conditions
    found = own.groupBy(*GROUP).agg(F.min("file_name").alias("sample_name"), *(F.max(t).alias(f"__t{i}") for i, t in enumerate(tests)))
    for i in range(len(tests)):
        found = found.where(f"__t{i}")
    out = out.join(found.select(*GROUP, "sample_name"), GROUP)
    if by.status is not None:
        if by.status not in ("unreviewed", "partial", "decided"):
            raise ValueError(f"unknown status {by.status!r}")
        wanted = group_status(members.where(F.col("session_id") == session), decisions).where(F.col("status") == by.status)
        out = out.join(wanted.select(*GROUP), GROUP, "left_semi")
    return out


def filter_groups(groups, members, files, decisions, session: str, by: GroupFilter | None = None, sort: str = "wasted", ascending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of matching groups; `sort` is one of SORTS."""
    if sort not in SORTS:
        raise ValueError(f"cannot sort by {sort!r}; one of {sorted(SORTS)}")
    key = F.col(SORTS[sort])
    found = matching_groups(groups, members, files, decisions, session, by or GroupFilter())
    return page(found, [key.asc() if ascending else key.desc(), F.asc("content_hash"), F.asc("file_size")], offset, limit)


def _copies(members: DataFrame, session: str) -> DataFrame:
    """canonical_path, content_hash, copy_count of a session's duplicates."""
    own = members.where(F.col("session_id") == session)
    return own.join(own.groupBy(*GROUP).agg(F.count("*").alias("copy_count")), GROUP).select("canonical_path", "content_hash", "copy_count")


FILE_SORTS = {"name": "file_name", "size": "file_size", "modified": "last_modified", "copies": "copy_count"}


def files_in_directory(files: DataFrame, members: DataFrame, session: str, directory: str | None, sort: str = "name", ascending: bool = True, offset: int = 0, limit: int | None = 200, duplicates_only: bool = False) -> DataFrame:
    """Files directly in a directory (None: in any) with is_duplicate, copy_count and content_hash of a session's groups."""
    if sort not in FILE_SORTS:
        raise ValueError(f"cannot sort by {sort!r}; one of {sorted(FILE_SORTS)}")
    own = files.where(F.col("parent_dir") == directory) if directory is not None else files
    out = own.select("canonical_path", "file_name", "parent_dir", "file_size", "last_modified").join(_copies(members, session), "canonical_path", "left")
    out = out.withColumn("is_duplicate", F.col("copy_count").isNotNull()).withColumn("copy_count", F.coalesce("copy_count", F.lit(0)).cast("long"))
    if duplicates_only:
        out = out.where("is_duplicate")
    key = F.col(FILE_SORTS[sort])
    return page(out, [key.asc() if ascending else key.desc(), F.asc("canonical_path")], offset, limit)


def directory_density(files: DataFrame, members: DataFrame, session: str) -> DataFrame:
    """parent_dir, duplicates, total, bytes: how many of its direct files a session's groups hold."""
    mine = members.where(F.col("session_id") == session).select("canonical_path", F.lit(1).alias("__d")).distinct()
    out = files.join(mine, "canonical_path", "left").groupBy("parent_dir")
    return out.agg(F.count("__d").alias("duplicates"), F.count("*").alias("total"), F.sum("file_size").cast("long").alias("bytes"))


def sibling_context(files: DataFrame, members: DataFrame, session: str) -> DataFrame:
    """canonical_path, siblings (other files of its directory), duplicated (of them, those in the session's groups)."""
    mine = members.where(F.col("session_id") == session).select("canonical_path", F.lit(1).alias("__d")).distinct()
    marked = files.select("canonical_path", "parent_dir").join(mine, "canonical_path", "left")
    per = marked.groupBy("parent_dir").agg(F.count("*").alias("n"), F.count("__d").alias("d"))
    out = marked.join(per, "parent_dir")
    own = F.coalesce("__d", F.lit(0))
    return out.select("canonical_path", (F.col("n") - 1).alias("siblings"), (F.col("d") - own).cast("long").alias("duplicated"))


def quick_wins(pairs: DataFrame, groups: DataFrame, members: DataFrame, files: DataFrame, session: str, k: int = 5) -> DataFrame:
    """kind, label, bytes, copies: the k exact directory pairs that share most and the k groups that waste most."""
    dirs = page(pairs.where("match_type = 'exact'"), [F.desc("shared_weight"), F.asc("entity_a"), F.asc("entity_b")], 0, k)
    dirs = dirs.select(F.lit("directory").alias("kind"), F.concat_ws(" = ", "entity_a", "entity_b").alias("label"), F.col("shared_weight").alias("bytes"), F.lit(2).cast("long").alias("copies"))
    own = groups_of_session(groups, session, 0, k)
    names = own.join(members, GROUP).join(files.select("canonical_path", "file_name"), "canonical_path").groupBy(*GROUP, "wasted_bytes", "file_count").agg(F.min("file_name").alias("label"))
    return dirs.unionByName(names.select(F.lit("group").alias("kind"), "label", F.col("wasted_bytes").alias("bytes"), F.col("file_count").alias("copies")))


def search(files: DataFrame, members: DataFrame, text: str, session: str | None = None, limit: int = 20) -> DataFrame:
    """Files whose name or path holds the text, without regard to ASCII case, by name; with the session's copy_count."""
    pattern = like_pattern(text)
    found = files.where(F.col("file_name").ilike(pattern) | F.col("canonical_path").ilike(pattern)).select("canonical_path", "file_name", "file_size")
    found = page(found, [F.asc("file_name"), F.asc("canonical_path")], 0, limit)
    if session is None:
        return found
    out = found.join(_copies(members, session).select("canonical_path", "copy_count"), "canonical_path", "left")
    return out.withColumn("copy_count", F.coalesce("copy_count", F.lit(0)).cast("long"))


def treemap_nodes(files: DataFrame, members: DataFrame, session: str, limit: int = 30) -> DataFrame:
    """parent_dir, files, duplicates, bytes, density of the directories with most bytes."""
    out = directory_density(files, members, session).where("bytes > 0")
    out = out.select("parent_dir", F.col("total").alias("files"), "duplicates", "bytes", (F.col("duplicates") / F.col("total")).alias("density"))
    return page(out, [F.desc("bytes"), F.asc("parent_dir")], 0, limit)
