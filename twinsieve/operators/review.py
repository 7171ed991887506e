"""Review and deletion planning.  Nothing here deletes a file: plans are relations, and their execution is simulated.

Paths are compared by code point; every choice between equals ends in the path, so results do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BACKUP_PATTERN, WORKSPACE_PATTERN, YEAR_PATTERN, hex16, separators
from .groups import GROUP, group_status

UNDO_LIMIT = 200
WEEK = 7 * 86_400


def _keep_first(files: DataFrame, order: list[Column]) -> DataFrame:
    """Files of groups with keep: whether a file is the first of its group by `order`, then by path.  Groups of one file
    are left out.  The first is an aggregate combined before the shuffle, so a large group is not sorted in one task."""
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)], F.col("canonical_path").alias("path"))
    first = files.groupBy(*GROUP).agg(F.min(key)["path"].alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return files.join(first, GROUP).withColumn("keep", F.col("canonical_path") == F.col("__first")).drop("__first")


def auto_mark(members: DataFrame, strategy: str = "auto") -> DataFrame:
    """GROUP, canonical_path, strategy of all files of each group but the first by path."""
    first = members.groupBy(*GROUP).agg(F.min("canonical_path").alias("__first"))  # combined before the shuffle: no sort of a large group
    return members.join(first, GROUP).where("canonical_path <> __first").select(*GROUP, "canonical_path", F.lit(strategy).alias("strategy"))


def auto_select(files: DataFrame, keep: str = "newest") -> DataFrame:
    """GROUP, canonical_path, action (keep, delete): keep the newest file, or the one with the shortest path, of each group."""
    orders = {"newest": [-F.col("last_modified")], "shortest": [F.length("canonical_path")]}
    if keep not in orders:
        raise ValueError(f"unknown strategy {keep!r}")
    return _keep_first(files, orders[keep]).select(*GROUP, "canonical_path", F.when(F.col("keep"), "keep").otherwise("delete").alias("action"))


def mark_subtree(files: DataFrame, directory: str, strategy: str = "directory", strict: bool = True) -> DataFrame:
    """canonical_path, strategy of the files in a directory and below; not strict: of directories whose path begins so."""
    own = F.col("parent_dir")
    if strict:
        base = directory.rstrip("/\\")
        test = (own == base) | own.startswith(base + "/") | own.startswith(base + "\\")
    else:
        test = F.lower(own).startswith(directory.lower())
    return files.where(test).select("canonical_path", F.lit(strategy).alias("strategy"))


def pending(plan: DataFrame) -> DataFrame:
    return plan.where("executed_at is null")


def is_marked(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The files that a plan holds and has not executed."""
    return files.join(pending(plan).select("canonical_path"), "canonical_path", "left_semi")


def plan_summary(plan: DataFrame, files: DataFrame) -> DataFrame:
    """files, bytes of the pending plan."""
    own = pending(plan).select("canonical_path").join(files.select("canonical_path", "file_size"), "canonical_path")
    return own.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def review_status(members: DataFrame, decisions: DataFrame) -> DataFrame:
    return group_status(members, decisions)


def review_progress(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """session_id, reviewed, total (distinct files), percent."""
    decided = decisions.select("canonical_path", F.lit(True).alias("__d")).distinct()
    own = members.select("session_id", "canonical_path").distinct().join(decided, "canonical_path", "left")
    out = own.groupBy("session_id").agg(F.count("__d").alias("reviewed"), F.count("*").alias("total"))
    return out.withColumn("percent", 100.0 * F.col("reviewed") / F.col("total"))


def deletion_queue(members: DataFrame, files: DataFrame, decisions: DataFrame) -> DataFrame:
    """GROUP, canonical_path, drive_letter, parent_dir, file_name, retained_path: files decided to be deleted, each with
    the smallest path of its group that is kept or undecided (null if none is)."""
    acts = decisions.select("canonical_path", "action")
    own = members.join(acts, "canonical_path", "left")
    kept = own.where("action is null or action <> 'delete'").groupBy(*GROUP).agg(F.min("canonical_path").alias("retained_path"))
    out = own.where("action = 'delete'").join(kept, GROUP, "left")
    out = out.join(files.select("canonical_path", "drive_letter", "parent_dir", "file_name"), "canonical_path")
    return out.select(*GROUP, "canonical_path", "drive_letter", "parent_dir", "file_name", "retained_path").orderBy("drive_letter", "parent_dir", "file_name", *GROUP)


def queue_summary(queue: DataFrame) -> DataFrame:
    """files, bytes, drives, has_network (some path begins with two backslashes and no '?')."""
    path = F.col("canonical_path")
    network = path.startswith("\\\\") & ~path.startswith("\\\\?\\")
    return queue.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"), F.countDistinct("drive_letter").alias("drives"),
        F.coalesce(F.max(network), F.lit(False)).alias("has_network"),
    )


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last event of each file of a log (canonical_path, action, seq)."""
    return log.groupBy("canonical_path").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def single_keep(log: DataFrame) -> DataFrame:
    """canonical_path, GROUP, action: the last decisions, in which only a group's last keep stays one; others become skip."""
    last = log.groupBy(*GROUP, "canonical_path").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    newest = last.groupBy(*GROUP).agg(F.max(F.when(F.col("action") == "keep", F.col("seq"))).alias("__newest"))
    out = last.join(newest, GROUP)
    action = F.when((F.col("action") == "keep") & (F.col("seq") < F.col("__newest")), "skip").otherwise(F.col("action"))
    return out.select(*GROUP, "canonical_path", action.alias("action"))


def suggest(files: DataFrame) -> DataFrame:
    """GROUP, delete_path, keep_path, label for groups where a rule tells copies apart; the first rule that does:
    a backup location, an active workspace, modified over a week apart, fewer path separators.  `files` are the members of
    groups with last_modified (epoch seconds); "the first" copy is that with the smallest path."""
    path, time, seps = F.col("canonical_path"), F.col("last_modified"), separators(F.col("canonical_path"))
    backup, active = path.rlike(BACKUP_PATTERN) | path.rlike(YEAR_PATTERN), path.rlike(WORKSPACE_PATTERN)
    low = lambda test: F.min(F.when(test, path))
    g = files.groupBy(*GROUP).agg(
        F.count("*").alias("n"), low(backup).alias("b1"), low(~backup).alias("b0"), low(active).alias("a1"), low(~active).alias("a0"),
        F.max(F.struct(time.alias("t"), path.alias("p"))).alias("new"), F.min(F.struct(time.alias("t"), path.alias("p"))).alias("old"),
        F.min(F.struct(seps.alias("s"), path.alias("p"))).alias("near"), F.min(F.struct((-seps).alias("s"), path.alias("p"))).alias("far"),
    )
    rules = [
        (F.col("b1").isNotNull() & F.col("b0").isNotNull(), "b1", "b0", "Backup root"),
        (F.col("a1").isNotNull() & F.col("a0").isNotNull(), "a0", "a1", "Active workspace"),
        (F.col("new.t") - F.col("old.t") > WEEK, "old.p", "new.p", "Most recent"),
        (F.col("near.s") != -F.col("far.s"), "far.p", "near.p", "Shortest path"),
    ]
    out = F.lit(None)
    for test, delete, keep, label in reversed(rules):
        out = F.when(test, F.struct(F.col(delete).alias("delete_path"), F.col(keep).alias("keep_path"), F.lit(label).alias("label"))).otherwise(out)
    return g.where("n > 1").select(*GROUP, out.alias("it")).where("it is not null").select(*GROUP, "it.*")


def age_badges(files: DataFrame) -> DataFrame:
    """GROUP, canonical_path, badge (newest, oldest or null) of groups of two or more; one file has one badge at most."""
    t = F.struct(F.col("last_modified"), F.col("canonical_path"))
    ends = files.groupBy(*GROUP).agg(F.max("last_modified").alias("__hi"), F.min("last_modified").alias("__lo"), F.max(t)["canonical_path"].alias("__new"), F.min(t)["canonical_path"].alias("__old"))
    out = files.join(ends, GROUP)
    badge = F.when(F.col("__hi") == F.col("__lo"), None).when(F.col("canonical_path") == F.col("__new"), "newest").when(F.col("canonical_path") == F.col("__old"), "oldest")
    return out.select(*GROUP, "canonical_path", badge.alias("badge"))


def undo_fold(log: DataFrame, limit: int = UNDO_LIMIT) -> DataFrame:
    """The decisions (user, canonical_path, action) after a log of events: user, seq, kind (decide, undo, redo),
    canonical_path, action.  A decision clears what could be redone and at most `limit` can be undone; undoing a first
    decision sets skip.  Logs lie sorted in partitions by user and are folded as they stream by: a task holds the latest
    decision of each file of one user, never a log."""
    columns = ("user", "kind", "canonical_path", "action")

    def run(batches):
        import pyarrow as pa

        user, begun, state, done, undone = None, False, {}, [], []

        def decided():
            paths = list(state)
            for i in range(0, len(paths), 10_000):
                part = paths[i : i + 10_000]
                cols = [[user] * len(part), part, [state[p] for p in part]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names=["user", "canonical_path", "action"])

        for batch in batches:
            for who, kind, path, action in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
                if not begun or who != user:
                    yield from decided()
                    user, begun, state, done, undone = who, True, {}, [], []
                if kind == "decide":
                    done.append((path, state.get(path), action))
                    done, undone = done[-limit:], []
                    state[path] = action
                elif kind == "undo" and done:
                    path, old, new = done.pop()
                    undone.append((path, old, new))
                    state[path] = old or "skip"
                elif kind == "redo" and undone:
                    path, old, new = undone.pop()
                    done.append((path, old, new))
                    state[path] = new
        yield from decided()

    rows = log.select(*(F.col(c).cast("string").alias(c) for c in columns), "seq")
    return rows.repartition("user").sortWithinPartitions("user", "seq").mapInArrow(run, "user string, canonical_path string, action string")


def simulate(plan: DataFrame, existing: DataFrame, use_trash: bool = False) -> DataFrame:
    """canonical_path, execution_result of the pending plan: success (trashed), or file_missing if not in `existing`;
    an entry without a path is an error."""
    there = existing.select(F.col("canonical_path").alias("__p"), F.lit(True).alias("__e")).distinct()
    out = pending(plan).join(there, F.col("canonical_path") == F.col("__p"), "left")
    result = F.when(F.col("canonical_path").isNull(), "error: unknown file").when(F.col("__e").isNull(), "file_missing").otherwise("trashed" if use_trash else "success")
    return out.select("canonical_path", result.alias("execution_result"))


def simulation_summary(results: DataFrame) -> DataFrame:
    """success, errors; missing files count as neither."""
    r = F.col("execution_result")
    return results.agg(F.count(F.when(r.isin("success", "trashed"), 1)).alias("success"), F.count(F.when(r.startswith("error"), 1)).alias("errors"))


def deletion_log(queue: DataFrame, deleted_at: Column, method: str = "trash") -> DataFrame:
    """Rows for a CSV log: path, hash (16 upper-case digits for a 64-bit hash, else as it is), size, retained_path,
    deleted_at, method.  Write it by `.write.csv(path, header=True)`."""
    h = F.col("content_hash")
    h = hex16(h, upper=True) if dict(queue.dtypes)["content_hash"] == "bigint" else F.upper(h)
    return queue.select(F.col("canonical_path").alias("path"), h.alias("hash"), F.col("file_size").alias("size"), "retained_path", deleted_at.alias("deleted_at"), F.lit(method).alias("method"))
