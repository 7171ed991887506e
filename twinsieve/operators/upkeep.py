"""Upkeep of the directory tree and of content sets by signed rows, without a look at unchanged files.

A file that was added or has changed gives rows with +1, one that was removed or has changed rows with -1, on each directory
above it.  Both tables are sums of such rows, so they take deltas in any order and in any portions, and a row whose count
comes to zero leaves:

    totals    path, file_count, total_size                        (as `tree.directory_tree`)
    contents  path, content_hash, file_size, files                (as `tree.directory_elements`: a row for each hash below it)

`contents` keeps how many files of which size have a hash, so that a hash stays while any file below has it, and its weight (the
smallest size) is found again when that file goes.  Deltas are added up by directory before they are spread over the
directories above, as in a full rollup.  Nulls: files without a path are no files; files without a hash count in
`totals` alone; a null size counts as 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stash
from .store import _paths
from .tree import ancestors

FILE = ("canonical_path", "parent_dir", "file_size", "last_modified", "content_hash")
SCHEMAS = {
    "files": "canonical_path string, parent_dir string, file_size long, last_modified long, content_hash string",
    "totals": "path string, file_count long, total_size long",
    "contents": "path string, content_hash string, file_size long, files long",
}


def signed(removed: DataFrame, added: DataFrame) -> DataFrame:
    """parent_dir, file_size, content_hash, sign of the files (the columns of FILE) that went and that came; of a changed file the old row
    is in `removed` and the new one in `added`."""
    rows = lambda df, s: df.where("canonical_path is not null").select("parent_dir", F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"), "content_hash", F.lit(s).cast("long").alias("sign"))
    return rows(removed, -1).unionByName(rows(added, 1))


def total_deltas(changes: DataFrame) -> DataFrame:
    """path, file_count, total_size: what `signed` rows add to each directory."""
    direct = changes.groupBy("parent_dir").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("file_size")).alias("bytes"))
    spread = direct.select(F.explode(ancestors(F.col("parent_dir"))).alias("path"), "n", "bytes")
    return spread.groupBy("path").agg(F.sum("n").alias("file_count"), F.sum("bytes").alias("total_size"))


def content_deltas(changes: DataFrame) -> DataFrame:
    """path, content_hash, file_size, files: what `signed` rows add to each directory's contents."""
    direct = changes.where("content_hash is not null").groupBy("parent_dir", "content_hash", "file_size").agg(F.sum("sign").alias("n")).where("n <> 0")
    spread = direct.select(F.explode(ancestors(F.col("parent_dir"))).alias("path"), "content_hash", "file_size", "n")
    return spread.groupBy("path", "content_hash", "file_size").agg(F.sum("n").alias("files"))


def _merged(stored: DataFrame, deltas: DataFrame, keys: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    both = stored.select(*keys, *counts).unionByName(deltas.select(*keys, *counts))
    return both.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in counts)).where(f"{counts[0]} <> 0")


def merge_totals(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """`totals` with deltas added; directories that hold no file any more leave."""
    return _merged(stored, deltas, ("path",), ("file_count", "total_size"))


def merge_contents(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """`contents` with deltas added; hashes that no file below a directory has any more leave it."""
    return _merged(stored, deltas, ("path", "content_hash", "file_size"), ("files",))


def elements(contents: DataFrame) -> DataFrame:
    """entity, element, weight of `contents`: the long form of `tree.directory_elements`."""
    return contents.groupBy(F.col("path").alias("entity"), F.col("content_hash").alias("element")).agg(F.min("file_size").alias("weight"))


def file_changes(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of `before` that went or changed, rows of `now` that came or changed), by path, size and time; only metadata is
    compared."""
    key = ["canonical_path", "file_size", "last_modified"]
    return before.join(now.select(*key), key, "left_anti"), now.join(before.select(*key), key, "left_anti")


def generation(spark: SparkSession, base: str) -> int:
    """The number of the last complete generation of tables below `base`; 0 if there is none."""
    fs, at = _paths(spark, base)
    if not fs.exists(at("")):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at(""))]
    return max([int(n[1:]) for n in names if re.fullmatch(r"g\d+", n) and fs.exists(at(f"{n}/complete"))], default=0)


def tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """files, totals and contents as of the last complete generation; empty before the first."""
    n = generation(spark, base)
    return {k: spark.read.schema(s).parquet(f"{base}/g{n}/{k}") if n else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}


def follow(spark: SparkSession, inventory: DataFrame, base: str, hashed: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables below `base`, brought up to an inventory (metadata).  `hashed` gives content_hash for files that came or changed,
    once each; others are not read.

    All three tables are written as a new generation, which counts once it is marked complete; then older ones are removed.  A
    run that breaks off leaves the last generation as it was."""
    last, old = generation(spark, base), tables(spark, base)
    inventory = inventory.where("canonical_path is not null").dropDuplicates(["canonical_path"])
    gone, came = file_changes(old["files"], inventory)
    came, gone = stash(hashed(came).select(*FILE), "came"), stash(gone.select(*FILE), "gone")
    changes = signed(gone, came)
    new = {
        "files": old["files"].join(gone.select("canonical_path"), "canonical_path", "left_anti").select(*FILE).unionByName(came),
        "totals": merge_totals(old["totals"], total_deltas(changes)),
        "contents": merge_contents(old["contents"], content_deltas(changes)),
    }
    fs, at = _paths(spark, base)
    for name, df in new.items():
        df.write.mode("overwrite").parquet(f"{base}/g{last + 1}/{name}")
    fs.create(at(f"g{last + 1}/complete")).close()
    if last:
        fs.delete(at(f"g{last}"), True)
    return tables(spark, base)
