"""Command line: python -m twinsieve.cli COMMAND ...

process             scan, find duplicates, analyse directories; print the summary and write the results
analyze-directories directories and similar directories of results that `process` wrote
count-hash-cache    keys in the hash cache of results
print-config        roots and ignore patterns of a configuration
truncate-db         remove results (asks first, unless --yes)
"""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import time

from .operators import cascade, store
from .plans import scan
from .sources import inventory
from .sources.shared import clean
from .streaming.incremental import Progress


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("twinsieve").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def process(spark, config: inventory.Config, out: str, threshold: float = 0.5) -> dict:
    """Run all phases over real files and write a snapshot of each relation below `out`; the summary."""
    times, start = {}, [time.perf_counter()]

    def report(phase: str, what: str) -> None:
        if what == "start":
            start[0] = time.perf_counter()
        else:
            times[phase] = round(time.perf_counter() - start[0], 2)

    progress = Progress(spark, report)
    files = progress.run("scan", lambda: inventory.walk(spark, config.root_paths, config.ignore_patterns)[0].persist())
    walked = files.count()
    cache = store.read_snapshot(spark, f"{out}/hash_cache")
    sized = inventory_candidates(files)
    if cache is None:
        hashed = inventory.full_digest(sized)
    else:
        hashed, _ = store.with_cached_hash(sized, cache.select("canonical_path", "last_modified", "content_hash"), inventory.full_digest)
    hashed = progress.run("hash", lambda: _kept(hashed))
    dups = cascade.repeated(hashed, ["file_size", "content_hash"]).persist()
    found = progress.run("analysis", lambda: scan.analyze(files, dups, threshold=threshold))

    def write() -> None:
        for name in ("duplicates", "groups", "members", "tree", "fingerprints", "similar"):
            store.write_snapshot(getattr(found, name), f"{out}/{name}")
        store.swap_snapshot(hashed.where("content_hash is not null").select("canonical_path", "last_modified", "content_hash"), f"{out}/hash_cache")
        for name in ("duplicates", "groups", "members", "tree", "fingerprints", "similar", "hash_cache"):
            store.drop_other_versions(spark, f"{out}/{name}")

    progress.run("write", write)
    groups = found.groups.agg({"*": "count", "wasted_bytes": "sum"}).first()
    for kept in (files, hashed, dups, found.duplicates):
        kept.unpersist()
    clean(spark)
    return {"files_walked": walked, "duplicate_groups": groups[0], "wasted_bytes": groups[1] or 0, "seconds": times}


def inventory_candidates(files):
    """Files that agree with another in size and in their first bytes."""
    return cascade.once_repeated(inventory.read_prefix(cascade.same_size(files)), ["file_size", "partial_hash"], "prefixes")


def _kept(df):
    df = df.persist()
    df.count()
    return df


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="twinsieve", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["process", "analyze-directories", "count-hash-cache", "print-config", "truncate-db"])
    p.add_argument("roots", nargs="*")
    p.add_argument("--config", default="twinsieve.toml")
    p.add_argument("--out", default="twinsieve-results")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--yes", action="store_true")
    a = p.parse_args(argv)
    config = inventory.Config.load(a.config)
    if a.roots:
        config = inventory.Config(a.roots, config.ignore_patterns)
    if a.command == "print-config":
        print(json.dumps({"root_paths": config.root_paths, "ignore_patterns": config.ignore_patterns}))
        return 0
    if a.command == "truncate-db":
        if not a.yes and input(f"Remove all results in {a.out}? [y/N] ").strip().lower() != "y":
            return 1
        shutil.rmtree(a.out, ignore_errors=True)
        return 0
    spark = _session()
    if a.command == "process":
        print(json.dumps(process(spark, config, a.out, a.threshold)))
        return 0
    if a.command == "count-hash-cache":
        cache = store.read_snapshot(spark, f"{a.out}/hash_cache")
        print(0 if cache is None else cache.count())
        return 0
    dups = store.read_snapshot(spark, f"{a.out}/duplicates")
    if dups is None:
        print(f"no results in {a.out}", file=sys.stderr)
        return 1
    tree, prints, similar = scan.directories(dups, a.threshold)
    for name, df in (("tree", tree), ("fingerprints", prints), ("similar", similar)):
        store.write_snapshot(df, f"{a.out}/{name}")
    print(json.dumps({"directories": tree.count(), "fingerprints": prints.count(), "similar_pairs": similar.count()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
