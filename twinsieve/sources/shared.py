"""Tables in the shared folder of a job (`spark.checkpoint.dir`), which cut lineage and are computed once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """URI of the shared folder, without a closing slash.  Only with a local master and no folder set, as in tests, a
    temporary folder stands in; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="twinsieve-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = f"file://{_own[0]}"
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A name of its own in the shared folder; `clean` removes what lies there."""
    _made.append(f"{folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stashed(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """(`stash` of df, where it lies)."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, computed once, written as Parquet to the shared folder and read from there ever after."""
    return stashed(df, name, codec)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def scope(spark: SparkSession):
    """Tables made inside are removed at its end, for work whose result has been written elsewhere by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            remove(spark, path)


def clean(spark: SparkSession) -> int:
    """Delete all that this process has put into the shared folder, when its results are written elsewhere; how many."""
    paths = list(_made)
    for path in paths:
        remove(spark, path)
    return len(paths)
