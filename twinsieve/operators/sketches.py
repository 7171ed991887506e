"""Content of directories as theta sketches, where a row for each (directory, hash) is too much.

A sketch keeps the k = 2 ** log_k smallest of the hashes of what it has seen.  Sketches of directories are united up the tree by
Spark's own aggregates, so a directory is one row of at most 8 k bytes whatever lies below it, and any two directories can
be compared by set operations on their rows, without their files.

Error: up to k distinct hashes all numbers are exact.  Beyond, the relative standard error of a count is 1 / sqrt(k - 1) (0.8 % for the
default of 2 ** 14), and that of what two directories share is sqrt(union / shared / k) (for shared content of a
hundredth of the union, 7.8 %); 95 in 100 estimates lie within two of them.  Null hashes count nowhere.

`exact_content` and `exact_shared` take the sketch's number where it is exact and count the hashes of the other directories,
of which there are few: each has more than k distinct hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import ancestors

LOG_K = 14


def directory_sketches(files: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """path, sketch: the distinct content hashes below every directory that has one.  Files are sketched by directory first, and the
    sketches are spread over the directories above."""
    own = files.where("content_hash is not null").groupBy("parent_dir").agg(F.theta_sketch_agg("content_hash", log_k).alias("own"))
    return merge(own.select(F.explode(ancestors(F.col("parent_dir"))).alias("path"), F.col("own").alias("sketch")), log_k)


def merge(sketches: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """path, sketch: sketches (path, sketch) of one path united.  Content that was added is united with what is stored; content
    that went needs `upkeep.contents`, as a sketch forgets nothing."""
    return sketches.groupBy("path").agg(F.theta_union_agg("sketch", log_k).alias("sketch"))


def distinct_content(sketches: DataFrame) -> DataFrame:
    """path, hashes (estimated)."""
    return sketches.select("path", F.theta_sketch_estimate("sketch").alias("hashes"))


def large_directories(sketches: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """path: directories of more than 2 ** log_k distinct hashes, whose numbers are estimates; the estimate of such a sketch is above k."""
    return sketches.where(F.theta_sketch_estimate("sketch") > 1 << log_k).select("path")


def _hashes_of(files: DataFrame, directories: DataFrame) -> DataFrame:
    """path, content_hash: a row for each hash below the given directories."""
    own = files.where("content_hash is not null").select("parent_dir", "content_hash").distinct()
    paths = own.select("parent_dir").distinct().select("parent_dir", F.explode(ancestors(F.col("parent_dir"))).alias("path"))
    asked = paths.join(directories, "path", "left_semi")
    return own.join(asked, "parent_dir").select("path", "content_hash").distinct()


def exact_content(files: DataFrame, sketches: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """path, hashes: exact, from the sketches of `files` and from the files below directories whose sketch is full."""
    large = large_directories(sketches, log_k)
    counted = _hashes_of(files, large).groupBy("path").agg(F.count("*").alias("hashes"))
    return distinct_content(sketches).join(large, "path", "left_anti").unionByName(counted)


def shared_content(sketches: DataFrame, pairs: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """path_a, path_b, n_a, n_b, shared, score (Jaccard), contained (share of the smaller that the larger has) of pairs (path_a,
    path_b), estimated."""
    c = F.col
    side = lambda k: sketches.select(c("path").alias(f"path_{k}"), c("sketch").alias(f"sketch_{k}"))
    both = pairs.select("path_a", "path_b").join(side("a"), "path_a").join(side("b"), "path_b")
    size = lambda s: F.theta_sketch_estimate(s)
    both = both.select("path_a", "path_b", size("sketch_a").alias("n_a"), size("sketch_b").alias("n_b"), size(F.theta_intersection("sketch_a", "sketch_b")).alias("shared"), size(F.theta_union("sketch_a", "sketch_b", log_k)).alias("total"))
    return both.select("path_a", "path_b", "n_a", "n_b", "shared", (c("shared") / c("total")).alias("score"), (c("shared") / F.least("n_a", "n_b")).alias("contained"))


def exact_shared(files: DataFrame, sketches: DataFrame, pairs: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """`shared_content` with exact numbers, from the sketches of `files` and from the files below the directories of
    pairs of which one has a full sketch.  The pairs are distinct."""
    c = F.col
    large = large_directories(sketches, log_k)
    full = large.withColumn("full", F.lit(True))
    side = lambda df, k: df.select(*(c(x).alias(f"{x}_{k}") for x in df.columns))
    known = pairs.select("path_a", "path_b").join(side(full, "a"), "path_a", "left").join(side(full, "b"), "path_b", "left")
    by_sketch = shared_content(sketches, known.where("full_a is null and full_b is null"), log_k).select("path_a", "path_b", "shared")
    asked = known.where("full_a or full_b").select("path_a", "path_b")
    rows = _hashes_of(files, asked.select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct())
    # by (path, hash), so that no directory comes together in one task
    left = rows.toDF("path_a", "content_hash").join(asked, "path_a")
    both = left.join(rows.toDF("path_b", "content_hash"), ["path_b", "content_hash"]).groupBy("path_a", "path_b").agg(F.count("*").alias("n"))
    counted = asked.join(both, ["path_a", "path_b"], "left").select("path_a", "path_b", F.coalesce("n", F.lit(0)).cast("long").alias("shared"))
    sizes = exact_content(files, sketches, log_k)
    named = lambda k: sizes.select(c("path").alias(f"path_{k}"), c("hashes").alias(f"n_{k}"))
    out = by_sketch.unionByName(counted).join(named("a"), "path_a").join(named("b"), "path_b")
    n, a, b = c("shared"), c("n_a"), c("n_b")
    return out.select("path_a", "path_b", "n_a", "n_b", "shared", (n / (a + b - n)).alias("score"), (n / F.least(a, b)).alias("contained"))
