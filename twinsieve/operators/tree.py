"""Directory hierarchy: nodes, rollups and content sets, by exploding each file into its ancestors once.

A path '/a/b' has the nodes '/', '/a' and '/a/b' at depths 1, 2 and 3.  One shuffle by ancestor takes the place of a
pass per depth; sums and counts are combined before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import file_name, parent_dir


def ancestors(directory: Column) -> Column:
    """'/a/b' -> ['/', '/a', '/a/b']; relative paths have no '/' in front; '' is the root."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    root = F.when(directory.startswith("/") | (directory == ""), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    lead = F.when(directory.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    deeper = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(lead, F.array_join(F.slice(parts, 1, i), "/"))))
    return F.concat(root, F.coalesce(deeper, F.array().cast("array<string>")))


def depth(path: Column) -> Column:
    inner = F.size(F.filter(F.split(path, "/"), lambda x: x != ""))
    return (inner + F.when(path.startswith("/"), 1).otherwise(0)).cast("long")


def parent_of(path: Column) -> Column:
    """The node above; null for '/' and for a relative path of one part."""
    up = parent_dir(path)
    return F.when(path == "/", F.lit(None)).when((up == "") & path.startswith("/"), F.lit("/")).when(up == "", F.lit(None)).otherwise(up)


def node_name(path: Column) -> Column:
    return F.when(path == "/", path).otherwise(file_name(path))


def distinct_parents(files: DataFrame) -> DataFrame:
    return files.select("parent_dir").distinct()


def directory_nodes(files: DataFrame) -> DataFrame:
    """path, name, parent, depth of every directory that holds a file or a directory that does."""
    nodes = distinct_parents(files).select(F.explode(ancestors(F.col("parent_dir"))).alias("path")).distinct()
    p = F.col("path")
    return nodes.select("path", node_name(p).alias("name"), parent_of(p).alias("parent"), depth(p).alias("depth"))


def direct_totals(files: DataFrame) -> DataFrame:
    """path, file_count, total_size of the files directly in each node; 0 for nodes without files."""
    own = files.groupBy(F.when(F.col("parent_dir") == "", "/").otherwise(F.col("parent_dir")).alias("path")).agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"))
    out = directory_nodes(files).select("path").join(own, "path", "left")
    return out.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("file_count", "total_size")))


def directory_tree(files: DataFrame) -> DataFrame:
    """path, name, parent, depth, file_count, total_size, both with all that lies below."""
    direct = files.groupBy("parent_dir").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))  # before the explosion
    spread = direct.select(F.explode(ancestors(F.col("parent_dir"))).alias("path"), "n", "bytes")
    p = F.col("path")
    totals = spread.groupBy("path").agg(F.sum("n").alias("file_count"), F.sum("bytes").cast("long").alias("total_size"))
    return totals.select("path", node_name(p).alias("name"), parent_of(p).alias("parent"), depth(p).alias("depth"), "file_count", "total_size")


def directory_elements(files: DataFrame, min_depth: int = 1) -> DataFrame:
    """entity (directory), element (content hash), weight (smallest file size with it): the long form of content sets."""
    once = files.where(F.col("content_hash").isNotNull()).groupBy("parent_dir", "content_hash").agg(F.min("file_size").alias("weight"))
    spread = once.select(F.explode(ancestors(F.col("parent_dir"))).alias("entity"), F.col("content_hash").alias("element"), "weight")
    if min_depth > 1:
        spread = spread.where(depth(F.col("entity")) >= min_depth)
    return spread.groupBy("entity", "element").agg(F.min("weight").alias("weight"))


def directory_hashes(files: DataFrame) -> DataFrame:
    """path, content_hash: a row for each hash that lies below a directory; directories without a hash have none."""
    return directory_elements(files).select(F.col("entity").alias("path"), F.col("element").alias("content_hash"))


def directory_sets(files: DataFrame) -> DataFrame:
    """path, file_hash_set (sorted, distinct): `directory_hashes` for output, a directory's set in one row."""
    return directory_hashes(files).groupBy("path").agg(F.array_sort(F.collect_set("content_hash")).alias("file_hash_set"))


def fingerprints(sets: DataFrame) -> DataFrame:
    """path, content_fingerprint (md5 over the sorted set), hashes; a set is one row here (`similarity.set_prints` needs
    no such row)."""
    return sets.select("path", F.md5(F.array_join(F.col("file_hash_set").cast("array<string>"), ",")).alias("content_fingerprint"), F.size("file_hash_set").cast("long").alias("hashes"))


def children(tree: DataFrame, parent: str | None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Nodes below one node (None: the roots), largest first, then by path."""
    out = tree.where(F.col("parent").eqNullSafe(F.lit(parent))).orderBy(F.desc("total_size"), "path").offset(offset)
    return out if limit is None else out.limit(limit)


def expand_level(tree: DataFrame, parent: str | None, limit: int = 200) -> DataFrame:
    """One level of a lazily opened tree."""
    return children(tree, parent, 0, limit)
