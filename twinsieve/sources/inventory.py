"""Inventories of files: from tables, and from real file trees.

Columns: canonical_path, file_name, parent_dir, drive_letter, file_size, last_modified (epoch seconds), and `content`
where it is at hand.  A physical inventory reads metadata only; contents are read later, for the survivors of the size
stage, by `read_prefix` and `full_digest`, in bounded pieces.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import drive_letter, epoch_seconds, file_name, parent_dir
from .shared import stash


@dataclass(frozen=True)
class Config:
    """root_paths and ignore_patterns, as in a TOML file of these two lists."""

    root_paths: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """The file's lists; a missing file gives the defaults."""
        try:
            with open(path, "rb") as f:
                raw = tomllib.load(f)
        except FileNotFoundError:
            return cls()
        return cls(list(raw.get("root_paths", [])), list(raw.get("ignore_patterns", [])))


def reduce_roots(roots: Iterable[str]) -> list[str]:
    """The roots that lie in no other root, in order of first mention; parts are compared, so /a is no root of /ab."""
    distinct = list(dict.fromkeys(roots))
    parts = {r: PurePosixPath(r.replace("\\", "/")).parts for r in distinct}
    inside = lambda r, o: o != r and parts[r][: len(parts[o])] == parts[o] and (len(parts[o]) < len(parts[r]) or distinct.index(o) < distinct.index(r))
    return [r for r in distinct if not any(inside(r, o) for o in distinct)]


def glob_regex(pattern: str) -> str | None:
    """A regular expression for a whole path: ** any depth, * and ? any characters (separators too), [...] a set, [!...]
    none of a set.  An invalid pattern gives None."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + ".*", i + 1
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^" + body[1:] if body[0] == "!" else "[" + body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def not_ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Whether neither the path nor a directory above it matches a pattern; invalid patterns do not count."""
    found = [r for r in map(glob_regex, patterns) if r]
    if not found:
        return F.lit(True)
    any_of = "|".join(f"(?:{r})" for r in found)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return ~F.exists(above, lambda p: p.rlike(any_of))


def located(df: DataFrame, path: str = "canonical_path") -> DataFrame:
    """df with file_name, parent_dir and drive_letter of a path column."""
    p = F.col(path)
    return df.withColumn("file_name", file_name(p)).withColumn("parent_dir", parent_dir(p)).withColumn("drive_letter", drive_letter(p))


def from_table(df: DataFrame, path: Column, content: Column, modified: Column | None = None, ignore: Sequence[str] = (), **extra: Column) -> DataFrame:
    """An inventory of any table: a path and a content for each row.  Null and empty contents are files of size 0."""
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    when = F.lit(0).cast("long") if modified is None else modified
    out = df.select(path.alias("canonical_path"), size.alias("file_size"), when.alias("last_modified"), content.alias("content"), *(c.alias(n) for n, c in extra.items()))
    out = located(out)
    return out.where(not_ignored(F.col("canonical_path"), ignore)) if ignore else out


def from_paths(spark: SparkSession, roots: Iterable[str], ignore: Sequence[str] = ()) -> DataFrame:
    """An inventory of file trees, metadata only, without empty files; missing roots give nothing.

    Links are not followed by the lister, overlapping roots count once, and a path is listed once.
    """
    import os

    kept = [r for r in reduce_roots(roots) if "://" in r or os.path.isdir(r)]
    schema = "canonical_path string, file_size long, last_modified long"
    if not kept:
        return located(spark.createDataFrame([], schema))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(kept).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^file:/*", "/")
    out = raw.where("length > 0").select(path.alias("canonical_path"), F.col("length").alias("file_size"), epoch_seconds(F.col("modificationTime")).alias("last_modified"))
    return located(out.where(not_ignored(F.col("canonical_path"), ignore)).dropDuplicates(["canonical_path"]))


def list_directory(path: str) -> list[tuple[str, str, int, int, str | None]]:
    """(kind, path, size, modified seconds, reason) of a directory's entries: "file" and "dir", and "skipped" with a reason for
    what may not be examined, which is the directory itself if it may not be listed.  Links are neither followed nor
    listed, and what vanishes meanwhile is left out; any other error is raised."""
    import os

    def skipped(where: str, e: OSError):
        return ("skipped", where, 0, 0, f"{type(e).__name__}: {e.strerror}")

    out = []
    try:
        entries = os.scandir(path)
    except FileNotFoundError:
        return out
    except PermissionError as e:
        return [skipped(path, e)]
    with entries as listed:
        for e in listed:
            try:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    out.append(("dir", e.path, 0, 0, None))
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    out.append(("file", e.path, s.st_size, int(s.st_mtime), None))
            except FileNotFoundError:
                continue
            except PermissionError as denied:
                out.append(skipped(e.path, denied))
    return out


def ignores(patterns: Sequence[str]):
    """Whether a path itself matches a pattern, as a function that can be sent to tasks; invalid patterns are logged and do not
    count."""
    import logging

    regexes = [glob_regex(p) for p in patterns]
    for p, r in zip(patterns, regexes, strict=True):
        if r is None:
            logging.getLogger(__name__).warning("invalid pattern %s", p)
    found = [r for r in regexes if r]
    if not found:
        return lambda path: False
    matches = re.compile("|".join(f"(?:{r})" for r in found), re.DOTALL).match
    return lambda path: matches(path) is not None


def walk(spark: SparkSession, roots: Iterable[str], ignore: Sequence[str] = (), lister=list_directory) -> tuple[DataFrame, DataFrame]:
    """(inventory of file trees, metadata only, without empty files; skipped: path, reason of what may not be read).

    Directories are listed by tasks, a level of the trees at a time, so a wide tree is read by all executors (which must
    see the paths).  The price is a job and a small table for each level.  A directory that matches a pattern of `ignore` is not descended
    into, and neither is a root that does or lies below one that does; a file that matches is left out.  What may not be
    read is logged and skipped, and its siblings are kept; other errors end the walk.  Missing roots give nothing (roots
    are tested on the driver)."""
    import logging
    import os

    schema = "kind string, path string, size long, modified long, reason string"
    ignored = ignores(ignore)

    def run(batches):
        import pyarrow as pa

        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [e for e in lister(path) if e[0] == "skipped" or not ignored(e[1])]
                if rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "path", "size", "modified", "reason"])

    def hidden(root: str) -> bool:
        parts = root.split("/")
        return any(ignored("/".join(parts[:i])) for i in range(1, len(parts) + 1))

    kept = [r for r in reduce_roots(roots) if os.path.isdir(r) and not hidden(r)]
    level, levels = spark.createDataFrame([(r,) for r in kept], "path string"), []
    while not level.isEmpty():
        levels.append(stash(level.repartition("path").mapInArrow(run, schema), "walk"))
        level = levels[-1].where("kind = 'dir'").select("path")
    found = levels[0] if levels else spark.createDataFrame([], schema)
    for one in levels[1:]:
        found = found.unionByName(one)
    skipped = found.where("kind = 'skipped'").select("path", "reason")
    for path, reason in skipped.limit(100).collect():
        logging.getLogger(__name__).warning("skipped %s: %s", path, reason)
    files = found.where("kind = 'file' and size > 0").select(F.col("path").alias("canonical_path"), F.col("size").alias("file_size"), F.col("modified").alias("last_modified"))
    return located(files), skipped


def open_file(path: str):
    """A file or an object of any store, opened for reading from its start."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_stream(place)


def _digests(files: DataFrame, column: str, limit: int | None, algorithm: str, opener) -> DataFrame:
    names = files.columns

    def digest_of(path: str) -> str | None:
        import hashlib
        import logging

        h = hashlib.new(algorithm)
        try:
            with opener(path) as f:
                if limit is not None:
                    h.update(f.read(limit))
                else:
                    while piece := f.read(1 << 20):
                        h.update(piece)
        except OSError as e:
            logging.getLogger(__name__).warning("cannot read %s: %s", path, e)
            return None
        return h.hexdigest()

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{column: [digest_of(p) for p in pdf["canonical_path"]]})[[*names, column]]

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + f", {column} string")


def read_prefix(files: DataFrame, prefix: int = 1024, algorithm: str = "md5", opener=open_file) -> DataFrame:
    """files with partial_hash: the digest of the first bytes, which are all that is read.  A file that cannot be read is logged
    by its task and has none."""
    return _digests(files, "partial_hash", prefix, algorithm, opener)


def full_digest(files: DataFrame, algorithm: str = "md5", opener=open_file) -> DataFrame:
    """files with content_hash, read in pieces of 1 MB whatever a file's size.  A file that cannot be read to its end is logged by
    its task and has none."""
    return _digests(files, "content_hash", None, algorithm, opener)


def find_duplicate_files(files: DataFrame, prefix: int = 1024, algorithm: str = "md5", opener=open_file) -> DataFrame:
    """The cascade over real files: metadata, then first bytes of files of one size, then all bytes of what is left.

    Each stage is written before it is counted, so that each file is opened once a stage.  Files that cannot be read go; `unreadable`
    tells them."""
    from ..operators.cascade import once_repeated, same_size

    some = read_prefix(same_size(stash(files, "inventory")), prefix, algorithm, opener)
    few = once_repeated(some, ["file_size", "partial_hash"], "prefixes").where("partial_hash is not null")
    return once_repeated(full_digest(few, algorithm, opener), ["file_size", "content_hash"]).where("content_hash is not null")


def unreadable(digested: DataFrame) -> DataFrame:
    """canonical_path of the files of `read_prefix` or `full_digest` that could not be read."""
    column = "content_hash" if "content_hash" in digested.columns else "partial_hash"
    return digested.where(F.col(column).isNull()).select("canonical_path")


def from_documents(docs: DataFrame) -> DataFrame:
    """The table of documents as an inventory: a file a document, in /source/lang, with a session for each language."""
    c = F.col
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("txt", "pdf", "jpg", "mp4", "zip", "mp3")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    path = F.concat(F.lit("/"), c("source"), F.lit("/"), c("lang"), F.lit("/doc_"), c("doc_id"), F.lit("."), kinds)
    modified = F.lit(1_700_000_000) + F.pmod(c("doc_id") * 7919, F.lit(2_000_000))
    out = from_table(docs, path, F.encode(F.coalesce("text", F.lit("")), "UTF-8"), modified.cast("long"), doc_id=c("doc_id"), session_id=c("lang"))
    return out.withColumn("drive_letter", F.chr(F.lit(67) + F.pmod("doc_id", F.lit(3))))
