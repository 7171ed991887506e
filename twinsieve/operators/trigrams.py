"""An index of character trigrams, for searches in names and paths that do not scan all of them.

The index is rows of (gram, canonical_path), sorted by gram where it is written, so that a search reads the row groups of a
few grams.  A path holds a text only if it has all of the text's trigrams; the paths that do are verified by the same
pattern that a scan uses, so the result is that of the scan.  Case does not count.  Texts below three characters have no
trigram: they are scanned for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import like_pattern


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; null for a shorter text."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def trigram_index(files: DataFrame, column: str = "canonical_path") -> DataFrame:
    """gram, canonical_path of the texts of a column."""
    return files.select(F.explode(grams(F.col(column))).alias("gram"), "canonical_path").distinct()


def write_index(index: DataFrame, path: str) -> None:
    """Write an index sorted by gram; a gram that many paths have is spread over files by path."""
    index.repartitionByRange("gram", "canonical_path").sortWithinPartitions("gram", "canonical_path").write.mode("overwrite").parquet(path)


def search(files: DataFrame, index: DataFrame, text: str, column: str = "canonical_path") -> DataFrame:
    """The rows of files whose column holds the text."""
    matches = F.col(column).ilike(like_pattern(text))
    wanted = files.sparkSession.range(1).select(grams(F.lit(text))).first()[0]
    if not wanted:
        return files.where(matches)
    found = index.where(F.col("gram").isin(wanted)).groupBy("canonical_path").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return files.join(found.select("canonical_path"), "canonical_path", "left_semi").where(matches)
