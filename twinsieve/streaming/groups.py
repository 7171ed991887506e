"""Duplicate groups of a stream of file events, kept up to date with retractions.

An event is (canonical_path, version, removed, file_size, content_hash): the file had this size and hash, or was gone, as of
`version` (a time or a number that rises with each change of a path).  Events may come in any order and more than once: the
highest version of a path counts (of one version, a removal, then the larger size and hash).

Two keyed states follow each other, both in `transformWithState`:

1. by path: the version that counts.  A change of it leaves the group it was in and enters another (-1, +1).  A removed path
   is remembered, so that an older event that comes late does not bring it back; `forget_ms` lets go of paths unheard of for so long
   (processing time), after which their files still count but a later change of them is taken for a new file; None keeps all.
2. by (file_size, content_hash): how many files are in the group.  A group that has changed and has, or had, two members
   gives a row with its new count; a count below two says that the group is gone.

State is a row a path and a number a group, in the state store of the executors (RocksDB), so nothing is bounded by memory.
Spark groups by `BUCKETS` hashes of paths and of groups, not by these themselves: each key costs a call of Python with frames of
its own, and their number grows with the stream.  In a bucket a map of the state store has an entry for each path or group, read
and written by itself, and not read while the bucket is empty.  Events of a bucket stream by in blocks; a task holds a block of
paths, or the groups of one bucket that a batch moves.  More than `BUCKETS` tasks would have nothing to do.  A group of any size
is one number, and a block's moves of it are summed before they are sent.  Empty files and files without a hash are in no group.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "canonical_path string, version long, removed boolean, file_size long, content_hash string"
MOVE = "file_size long, content_hash string, delta long"
CHANGE = "file_size long, content_hash string, file_count long, wasted_bytes long"
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processors(forget_ms: int | None):
    """The two states, as classes that are sent to the executors by value."""
    from collections import Counter

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    def order(e):  # a removal has neither size nor hash
        return (e[0], e[1], e[2], e[3] or "", e[3] is not None)

    def group(e):
        return (e[2], e[3]) if e and e[2] > 0 and e[3] is not None else None

    def whole(x):
        return x if isinstance(x, str) else None

    class Paths(StatefulProcessor):
        def init(self, handle) -> None:
            self.latest = handle.getMapState("latest", "canonical_path string", "version long, removed boolean, file_size long, content_hash string", forget_ms)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                found, moves = {}, Counter()
                columns = (pdf[x].tolist() for x in ("canonical_path", "version", "removed", "file_size", "content_hash"))
                for path, version, removed, size, content in zip(*columns, strict=True):
                    e = (version, removed, size, whole(content))
                    if path not in found or order(e) > order(found[path]):
                        found[path] = e
                known = self.latest.exists()
                for path, now in found.items():
                    was = self.latest.getValue((path,)) if known else None
                    if was is None or order(now) > order(was):
                        self.latest.updateValue((path,), now)
                        moves[group(was)] -= 1
                        moves[group(now)] += 1
                out = [(*g, d) for g, d in moves.items() if g and d]
                yield pd.DataFrame(out, columns=["file_size", "content_hash", "delta"])

        def close(self) -> None:
            pass

    class Groups(StatefulProcessor):
        def init(self, handle) -> None:
            self.count = handle.getMapState("count", "file_size long, content_hash string", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
            moves = Counter()
            for pdf in rows:
                for size, content, delta in zip(pdf["file_size"].tolist(), pdf["content_hash"].tolist(), pdf["delta"].tolist(), strict=True):
                    moves[size, content] += delta
            out, known = [], self.count.exists()
            for g, delta in moves.items():
                if not delta:
                    continue
                found = self.count.getValue(g) if known else None
                was = found[0] if found else 0
                now = was + delta
                if now:
                    self.count.updateValue(g, (now,))
                else:
                    self.count.removeKey(g)
                if max(now, was) > 1:
                    out.append((*g, now, g[0] * (now - 1) if now > 1 else 0))
            yield pd.DataFrame(out, columns=["file_size", "content_hash", "file_count", "wasted_bytes"])

        def close(self) -> None:
            pass

    return Paths(), Groups()


def group_changes(events: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """file_size, content_hash, file_count, wasted_bytes: a row for each group that a batch of the stream has changed."""
    paths, groups = _processors(forget_ms)
    mode = "ProcessingTime" if forget_ms else "None"
    bucket = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")
    gone = F.coalesce("removed", F.lit(False))
    size, content = F.coalesce(F.when(~gone, F.col("file_size")), F.lit(0)), F.when(~gone, F.col("content_hash"))
    rows = events.where("canonical_path is not null and version is not null")
    rows = rows.select(bucket("canonical_path"), "canonical_path", "version", gone.alias("removed"), size.cast("long").alias("file_size"), content.alias("content_hash"))
    moves = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=paths, outputStructType=MOVE, outputMode="Append", timeMode=mode)
    moves = moves.select(bucket("file_size", "content_hash"), "*")
    return moves.groupBy("bucket").transformWithStateInPandas(statefulProcessor=groups, outputStructType=CHANGE, outputMode="Append", timeMode=mode)


def keep_groups(events: DataFrame, table: str, checkpoint: str, forget_ms: int | None = None, **trigger) -> StreamingQuery:
    """Start to write the changes of a stream to `table`, a folder for each batch, which a batch that runs again replaces."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = group_changes(events, forget_ms).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def groups_now(spark: SparkSession, table: str) -> DataFrame:
    """file_size, content_hash, file_count, wasted_bytes of the groups as of the last batch."""
    changes = spark.read.schema(CHANGE + ", batch long").option("basePath", table).parquet(table)
    last = changes.groupBy("file_size", "content_hash").agg(F.max_by(F.struct("file_count", "wasted_bytes"), "batch").alias("it"))
    return last.select("file_size", "content_hash", "it.*").where("file_count > 1")


def groups_of_events(events: DataFrame) -> DataFrame:
    """What `groups_now` comes to, from all events at once."""
    c = F.col
    rows = events.where("canonical_path is not null and version is not null").withColumn("removed", F.coalesce("removed", F.lit(False)))
    size, content = (F.when(~c("removed"), c(x)) for x in ("file_size", "content_hash"))
    order = F.struct("version", "removed", F.coalesce(size, F.lit(0)), F.coalesce(content, F.lit("")), size.alias("file_size"), content.alias("content_hash"))
    last = rows.groupBy("canonical_path").agg(F.max(order).alias("it")).select("it.removed", "it.file_size", "it.content_hash")
    counted = last.where("not removed and file_size > 0 and content_hash is not null").groupBy("file_size", "content_hash").agg(F.count("*").alias("file_count"))
    return counted.where("file_count > 1").withColumn("wasted_bytes", c("file_size") * (c("file_count") - 1))
