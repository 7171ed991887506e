"""Treemap rectangles of a page of nodes: the squarified layout of Bruls, Huizing and van Wijk (2000)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squarify(areas: list[float], x: float, y: float, width: float, height: float) -> list[tuple[float, float, float, float]]:
    """(x, y, width, height) for each area, largest first; areas are scaled to fill the rectangle."""
    total = sum(areas)
    if total <= 0:
        return []
    sizes, out = [a * width * height / total for a in areas], []

    def worst(row: list[float], side: float) -> float:
        s = sum(row)
        return max(side * side * max(row) / (s * s), s * s / (side * side * min(row)))

    while sizes:
        side, row = min(width, height), [sizes[0]]
        while len(row) < len(sizes) and worst([*row, sizes[len(row)]], side) <= worst(row, side):
            row.append(sizes[len(row)])
        thick, at = sum(row) / side, 0.0
        for a in row:
            out.append((x, y + at, thick, a / thick) if width >= height else (x + at, y, a / thick, thick))
            at += a / thick
        if width >= height:
            x, width = x + thick, width - thick
        else:
            y, height = y + thick, height - thick
        sizes = sizes[len(row) :]
    return out


def treemap_rectangles(nodes: DataFrame, label: str = "parent_dir", size: str = "bytes", width: float = 1.0, height: float = 1.0, most: int = 1_000, least: float = 0.0) -> DataFrame:
    """label, x, y, width, height of the largest nodes of a page (such as `groups.treemap_nodes` gives), `most` at most,
    laid out on the driver; nodes of size 0 have none, nor those whose cell is narrower or lower than `least` (such as 5, for
    pixels), whose place stays empty."""
    page = nodes.where(F.col(size) > 0).orderBy(F.desc(size), label).limit(most).select(label, size).collect()
    boxes = squarify([float(r[1]) for r in page], 0.0, 0.0, width, height)
    shown = [(r[0], *b) for r, b in zip(page, boxes, strict=True) if min(b[2:]) >= least]
    return nodes.sparkSession.createDataFrame(shown, f"`{label}` string, x double, y double, width double, height double")
