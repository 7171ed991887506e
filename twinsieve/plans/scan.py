"""The whole pipeline from an inventory to duplicates, directories and similar directories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import cascade, similarity, tree


@dataclass(frozen=True)
class Analysis:
    """Results of `analyze`; all are lazy but `duplicates`, which is kept because the others share it."""

    duplicates: DataFrame
    groups: DataFrame
    members: DataFrame
    tree: DataFrame
    fingerprints: DataFrame
    similar: DataFrame


def directories(files: DataFrame, threshold: float = similarity.THRESHOLD, max_frequency: int = similarity.MAX_FREQUENCY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tree, fingerprints, similar pairs) of files with content_hash."""
    elements = tree.directory_elements(files)
    prints = similarity.set_prints(elements).toDF("path", "hashes", "content_fingerprint")
    return tree.directory_tree(files), prints, similarity.set_similarity(elements, threshold, max_frequency)


def analyze(files: DataFrame, duplicates: DataFrame | None = None, universe: str = "duplicates", hashed: DataFrame | None = None, **how) -> Analysis:
    """Duplicates of an inventory with contents (or as given), and the directories of the duplicates; with universe="all"
    and all files' hashes (`hashed`), of all files."""
    dups = (cascade.find_duplicates(files) if duplicates is None else duplicates).persist()
    if universe not in ("duplicates", "all"):
        raise ValueError(universe)
    nodes, prints, pairs = directories(hashed if universe == "all" and hashed is not None else dups, **how)
    return Analysis(dups, cascade.groups(dups), cascade.members(dups), nodes, prints, pairs)
