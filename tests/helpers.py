"""Literal file rows and small comparisons."""

from __future__ import annotations

FILE = "canonical_path string, file_name string, parent_dir string, drive_letter string, file_size long, last_modified long, content_hash string, session_id string"


def files(spark, *rows, session="s"):
    """File rows from (path, size, hash) or (path, size, hash, last_modified)."""
    out = []
    for path, size, h, *more in rows:
        parent, _, name = path.rpartition("/")
        out.append((path, name, parent, "", size, more[0] if more else 1_700_000_000, None if h is None else str(h), session))
    return spark.createDataFrame(out, FILE)


def rows(df, *columns):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
