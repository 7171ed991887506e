"""Running numbers over a whole table in two levels, and what is built on them: cache trimming, pre-order numbers, pages.

Rows are dealt by ranges of the order and written; a total of each range, running totals over the ranges (a row a range), and a
running total inside each range give what a window over the whole table would give in one task.  Rows that agree in all of
the order lie in one range, so an order should end in a column that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stash
from .tree import ancestors, directory_nodes


def running(df: DataFrame, order: Sequence[Column], value: Column | None = None, name: str = "before") -> DataFrame:
    """df with the total of `value` (1 if None) over the rows before each row in the order."""
    value = F.lit(1).cast("long") if value is None else value
    ranged = df.withColumn("__value", F.coalesce(value, F.lit(0))).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = stash(ranged, "ranges")
    totals = ranged.groupBy("__range").agg(F.sum("__value").alias("__total"))
    ahead = F.coalesce(F.sum("__total").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__range", ahead.alias("__ahead"))  # a row a range
    inside = F.sum("__value").over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    placed = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(totals, "__range")
    return placed.select(*df.columns, (F.col("__ahead") + F.col("__inside")).alias(name))


# Trimming a cache to a budget


def touch(cache: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """The cache (with canonical_path, last_used) in which the paths of `used` were used now."""
    paths = used.select("canonical_path").distinct().withColumn("__used", F.lit(True))
    return cache.join(paths, "canonical_path", "left").withColumn("last_used", F.when(F.col("__used"), now).otherwise(F.col("last_used"))).drop("__used").select(*cache.columns)


def trim(cache: DataFrame, budget: int, weight: Column | None = None) -> DataFrame:
    """The most recently used rows of a cache (canonical_path, last_used) whose weights (1 each if None) together are at most
    `budget`: rows are taken in order of last_used, the latest first and nulls last, then of path, up to the first that does not fit."""
    weight = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0))
    order = [F.col("last_used").desc_nulls_last(), F.col("canonical_path").asc_nulls_first()]
    return running(cache, order, weight, "__before").where(F.col("__before") + weight <= budget).drop("__before")


# Pre-order numbers of a tree


def _parts(path: Column) -> Column:
    """A path's parts; paths sort by them in pre-order, a directory right before what lies below it."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.concat(F.when(path.startswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), names)


def numbered_tree(files: DataFrame) -> DataFrame:
    """path, first, last of every directory: its number in pre-order and the largest number below it, so that a subtree is the
    range of numbers from first to last."""
    nodes = stash(directory_nodes(files).select("path"), "nodes")
    below = nodes.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("nodes"))
    numbers = running(nodes.withColumn("__parts", _parts(F.col("path"))), [F.col("__parts").asc()], name="first").drop("__parts")
    return numbers.join(below, "path").select("path", (F.col("first") + 1).alias("first"), (F.col("first") + F.col("nodes")).alias("last"))


def numbered_files(files: DataFrame, tree: DataFrame) -> DataFrame:
    """files with `node`, the number of their directory; written sorted by it, a subtree is a range that Parquet prunes by."""
    own = F.when(F.col("parent_dir") == "", "/").otherwise(F.col("parent_dir"))
    return files.withColumn("__path", own).join(tree.select(F.col("path").alias("__path"), F.col("first").alias("node")), "__path").drop("__path")


def in_subtree(numbered: DataFrame, tree: DataFrame, directory: str) -> DataFrame:
    """The rows of `numbered_files` at or below a directory; none if it is not in the tree."""
    found = tree.where(F.col("path") == directory).select("first", "last").first()
    return numbered.where(F.col("node").between(found["first"], found["last"])) if found else numbered.where(F.lit(False))


def subtree_totals(numbered: DataFrame, tree: DataFrame) -> DataFrame:
    """path, file_count, total_size with all that lies below, as differences of running totals: no row is spread over the directories
    above it, whatever the depth."""
    c = F.col
    direct = numbered.groupBy("node").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
    direct = stash(tree.join(direct, c("first") == c("node"), "left").select("path", "first", "last", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "bytes"))), "direct")
    sums = running(running(direct, [c("first").asc()], c("n"), "__n"), [c("first").asc()], c("bytes"), "__bytes")
    sums = stash(sums, "sums")
    ends = sums.select(c("first").alias("__at"), (c("__n") + c("n")).alias("__n_end"), (c("__bytes") + c("bytes")).alias("__bytes_end"))
    out = sums.join(ends, c("last") == c("__at"))
    return out.select("path", (c("__n_end") - c("__n")).alias("file_count"), (c("__bytes_end") - c("__bytes")).cast("long").alias("total_size"))


# Pages of a sorted snapshot


def write_pages(df: DataFrame, order: Sequence[Column], path: str, rows_per_file: int = 1_000_000) -> None:
    """Write df in files of about `rows_per_file` rows, sorted within and between files, and beside them how many rows lie before
    each file."""
    spark, n = df.sparkSession, df.count()
    ranged = df.repartitionByRange(max(1, -(-n // rows_per_file)), *order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").parquet(f"{path}/rows")
    # files are numbered in the order of their ranges
    counted = spark.read.schema(df.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = F.coalesce(F.sum("n").over(W.orderBy(number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted.select("file", "n", before.alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")  # a row a file


def read_page(spark: SparkSession, path: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the order, from the files that hold them."""
    files = spark.read.parquet(f"{path}/files")
    held = files.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("before").collect()
    rows = spark.read.parquet(f"{path}/rows")
    if not held:
        return rows.where(F.lit(False))
    some = spark.read.schema(rows.schema).parquet(*(r["file"] for r in held))
    return some.orderBy(*order).offset(offset - held[0]["before"]).limit(limit)
