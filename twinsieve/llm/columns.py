"""Carrying a table's own columns, whatever their names, through an operator that adds columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def no_clash(keep: tuple[str, ...], *results: str) -> None:
    """Raise an error if a column to keep bears the name of a result (in any case, as Spark compares names)."""
    both = {k.lower() for k in keep} & {r.lower() for r in results}
    if both:
        raise ValueError(f"columns to keep bear the names of results: {', '.join(sorted(both))}")


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(df under names that no operator uses, the new name of each column)."""
    names = {c: f"__own{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restore(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The hidden columns under their own names again, and no others."""
    return df.select(*(F.col(new).alias(old) for old, new in names.items()))
