"""The shared folder of a job: tables that cut lineage (`sources.shared`), and files that executors write and read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources.shared import clean, folder, fresh, remove, scope, stash, stashed

__all__ = ["clean", "filesystem", "folder", "fresh", "prepare", "put", "remove", "scope", "stash", "stashed"]

_shipped: set[str] = set()


#: Rows of an Arrow batch at most, so that a batch of long texts stays small in a worker.
BATCH_ROWS = 2_048


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches to BATCH_ROWS, and send this package to the executors, once an application, so that it need
    not be installed there."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    where = tempfile.mkdtemp(prefix="twinsieve-package-")
    atexit.register(shutil.rmtree, where, True)
    with zipfile.ZipFile(f"{where}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{where}/{root.name}.zip")
    _shipped.add(app)


def filesystem(uri: str):
    """(file system, path) for a file that an executor opens itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, parts) -> int:
    """Write a file whole or not at all: to a name of its own, then renamed.  A task that runs again replaces it by
    the same bytes.  Gives the number of bytes."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    system.move(own, path)
    return n
