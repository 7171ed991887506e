"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1.  Each source has a weight schedule over it; its integral, scaled to the source's
target, is the source's cumulative token demand.  A source's documents lie one behind another in an order drawn by
md5 of (doc_id, size), and start again at the end; inverting the demand at a document's offset gives the time at which it is
trained on.  A target may be up to `max_epochs` times what the source has.

Everything is native.  The running sum over a source, which may hold a third of all rows, is made in two levels: sums
of 4096 hash ranges of each source, running sums over these, then running sums inside one range.  Equal rows are
folded to one with a count before that and unfolded after it, so a doc_id that repeats a million times is one row.
The targets come from a loop of small aggregates over the table of sources; nothing grows on the driver.

Null texts have size 0 and are taken 0 words; a null source is a source of its own, last in the order; null doc_ids
are hashed as an empty string.  Equal rows share their lot in a fixed way, so reruns agree.  Targets are words: the take
that crosses a source's target is cut there (`words` of that take is less than the document's size).  Texts of any
length are counted whole; an empty table gives an empty result.  Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Slopes of the sources' weight schedules, repeating: weight(t) = 1 + slope * (t - 1/2).
SLOPES = (-1.0, 0.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, rank, weight, source_size, target: `share` of all words dealt by weight, each target at most `max_epochs`
    times its source; what is over is dealt again by weight among the others until none is over."""
    c = F.col
    order = c("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).repartitionByRange(order)
    totals = stash(totals.withColumn("part", F.spark_partition_id()), "source_sizes")
    # ranks in two levels, as there may be a source for every host: within ranges of sources, behind those before
    parts = totals.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    ranked = totals.join(parts, "part").withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(order)) - 1 + c("before")).drop("part", "before")
    table = stash(
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (c("rank") % len(weights) + 1).cast("int"))), "sources"
    )
    full = F.lit(float(max_epochs)) * c("source_size")
    level, n_full = 0.0, -1
    want = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    while True:
        over = full < F.lit(level) * c("weight")
        n, used, open_weight = table.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, c("weight"))), F.lit(0.0))
        ).first()
        if n == n_full or not open_weight:
            break
        n_full, level = n, (want - used) / open_weight
    return table.withColumn("target", F.least(full, F.lit(level) * c("weight")))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_epochs: int = 2, ident: Column | None = None, **how) -> DataFrame:
    """A row for each of docs: doc_id, source, size, source_size, target, taken (words, all takes together), takes (an
    array of (position, words), in order of time; empty if the mix does not need the document) and first_position; also
    ident (a column that tells rows of one doc_id apart, else null) and copy (0, 1, ... within equal rows)."""
    c = F.col
    ident = F.lit(None).cast("string") if ident is None else ident
    sizes = docs.select(c(doc_id).alias("doc_id"), c(source).cast("string").alias("source"), word_count(c(text)).alias("size"), ident.alias("ident"))
    # rows of one doc_id, or of none, lie in ranges of their own unless they are equal, and equal ones are folded
    plain = (F.coalesce(c(k).cast("string"), F.lit("")) for k in ("doc_id", "size", "ident"))
    sizes = sizes.withColumn("key", F.md5(F.concat_ws("|", *plain)))
    folded = stash(sizes.groupBy("source", "key", "doc_id", "size", "ident").agg(F.count("*").alias("copies")), "mix_sizes")
    folded = folded.withColumn("range", F.substring("key", 1, 3)).withColumn("total", c("size") * c("copies"))
    sources = source_targets(folded.select("source", c("total").alias("size")), max_epochs=max_epochs, **how)

    ranges = folded.groupBy("source", "range").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(c("source").alias("s"), c("range").alias("r"), F.coalesce(before, F.lit(0)).alias("before"))
    ranges = ranges.join(sources.select(c("source").alias("s2"), "rank", "source_size", "target"), c("s").eqNullSafe(c("s2"))).drop("s2")
    inside = F.sum("total").over(W.partitionBy("source", "range").orderBy("key", "doc_id", "size", "ident").rowsBetween(W.unboundedPreceding, -1))
    placed = folded.withColumn("inside", F.coalesce(inside, F.lit(0))).join(ranges, c("source").eqNullSafe(c("s")) & (c("range") == c("r")))
    one = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), c("copies") - 1)))
    at = c("before") + c("inside") + c("copy") * c("size")

    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), (c("rank") % len(SLOPES) + 1).cast("int"))
    takes = []
    for epoch in range(max_epochs):
        offset = at + F.lit(epoch) * c("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(c("size"), F.floor(c("target")) - offset))
        # demand(t) / target = t + slope * (t * t - t) / 2 = u, solved for t
        u, half = offset / F.nullif(c("target"), F.lit(0.0)), slope / 2
        t = F.when(half == 0, u).otherwise((half - 1 + F.sqrt((1 - half) * (1 - half) + 4 * half * u)) / (2 * half))
        takes.append(F.when(words > 0, F.struct(t.alias("position"), words.alias("words"))))
    one = one.withColumn("takes", F.array_compact(F.array(*takes)))
    return one.select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "takes", "ident", "copy",
        F.try_element_at("takes", F.lit(1))["position"].alias("first_position"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """doc_id, take, position, words: a row for each take, range-sorted by position over the whole cluster."""
    return mixed.select("doc_id", F.posexplode("takes").alias("take", "it")).select("doc_id", "take", "it.*").orderBy("position", "doc_id", "take")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position")
    return mixed.orderBy("first_position", "doc_id")


OP2_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM o),
w AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM r),
c AS (SELECT *, coalesce(sum(most) OVER b, 0)::DOUBLE AS used, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS open,
        1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS want
      FROM w WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, rank, source_size, least(most, (SELECT (want - used) / open FROM c WHERE most >= (want - used) / open * weight ORDER BY most / weight, rank LIMIT 1) * weight)
        AS target FROM w),
p AS (SELECT s.*, t.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|' || size || '|'), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - pos))::BIGINT AS one, greatest(0, least(size, floor(target)::BIGINT - pos - source_size))::BIGINT AS two,
        [-0.5, 0.0, 0.5][rank % 3 + 1]::DOUBLE AS half, pos / target AS u FROM p)
SELECT doc_id, size, source_size, target, one + two AS taken,
  CASE WHEN one > 0 THEN CASE WHEN half = 0 THEN u ELSE (half - 1 + sqrt((1 - half) * (1 - half) + 4 * half * u)) / (2 * half) END END AS first_position
FROM k
"""
