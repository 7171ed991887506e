"""Importance resampling towards a target distribution, over hashed n-grams of a position table.

`positions` has a row for every word of a text (posexplode).  The runs of two and more words come from `lead` over the
rows of one text: the texts are dealt by their key once, and the windows of all orders work inside that partitioning.
Runs of one word need no window and no shuffle of words.  A run is hashed to one of `buckets` buckets; a bucket's gain is
the log ratio of its share in the target to its share in the documents, a document's weight the mean gain of its runs.  A
Gumbel number drawn by a hash of the doc_id is added, and the highest scores are a sample without replacement whose odds
follow the weights.

Everything is native.  What is sent to every task is the table of gains, a row a bucket (`buckets` rows, a parameter).
Ranks are given in two levels: scores are whole numbers within about -50,000 and 70,000 (logarithms of counts below 2**63),
so the table of how many documents have which score is small whatever the corpus; equal scores are ranked by doc_id among
themselves, and only where a score reaches the draw.  Rows that are equal in all that is returned are folded to one with a
count before that and unfolded after it, so a doc_id that repeats a million times is one row.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Null, empty and wordless texts have no runs, weight 0
and are not eligible; null doc_ids draw as an empty text and come last among ties; repeated doc_ids are judged row by row
(rows that tie in doc_id and score are ranked by n_words, n_features and weight).  Texts of any length are counted whole;
an empty table gives an empty result, and with an empty target no bucket has a share in it.  Extra columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stash
from .sql import CRC_TABLE, crc32_sql

#: ASCII characters that are no word characters.
BREAKS = "".join(chr(i) for i in range(128) if chr(i) not in string.ascii_letters + string.digits)
#: Copies of one row unfolded at a time.
UNFOLD = 4_096


def positions(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, pos, word: the words of every text, pos rising along it, and behind them one row whose word is null."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase + BREAKS, string.ascii_lowercase + " " * len(BREAKS))
    words = F.concat(F.split(plain, " "), F.array(F.lit(None).cast("string")))
    return docs.select(*keys, F.posexplode(words).alias("pos", "word")).where("word <> '' or word is null")


def runs(texts: DataFrame, order: int) -> DataFrame:
    """doc_id, key, times, run, words: all runs of 1 to `order` consecutive words of texts (doc_id, key, times, text) joined by one
    space, and one row a text with 0 words and a null run.  Beyond order 1, (doc_id, key) tells texts apart."""
    c, row = F.col, ("doc_id", "key", "times")
    if order == 1:
        return positions(texts, "text", *row).select(*row, c("word").alias("run"), c("word").isNotNull().cast("int").alias("words"))
    along = W.partitionBy("doc_id", "key").orderBy("pos")
    ahead = positions(texts, "text", *row).select(*row, F.array("word", *(F.lead("word", k).over(along) for k in range(1, order))).alias("ahead"))
    lengths = F.when(F.get("ahead", F.lit(0)).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.size(F.array_compact("ahead"))))
    each = ahead.select(*row, "ahead", F.explode(lengths).alias("words"))
    return each.select(*row, F.when(c("words") > 0, F.array_join(F.slice("ahead", F.lit(1), c("words")), " ")).alias("run"), "words")


def _texts(docs: DataFrame, doc_id: Column, text: str, order: int) -> DataFrame:
    """doc_id, key (md5 of the text), times, text.  Beyond order 1 a row for each (doc_id, text), dealt by them, so that the windows
    find each text where it is."""
    own = docs.select(doc_id.alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    if order == 1:
        return own.withColumn("times", F.lit(1).cast("long"))
    return own.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.count("*").alias("times"))


def bucket(run: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(run), F.lit(buckets)).cast("int")


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for every bucket, from the runs of all documents and of the target."""
    c = F.col
    counted = lambda r, name: r.where("run is not null").groupBy(bucket(c("run"), buckets).alias("bucket")).agg(F.sum("times").alias(name))
    every = source.sparkSession.range(buckets).select(c("id").cast("int").alias("bucket"))
    both = every.join(counted(source, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left")
    both = stash(both.select("bucket", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in "st")), "gains")
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    ratio = ((c("t") + 1) * F.lit(all_s + buckets)) / ((c("s") + 1) * F.lit(all_t + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:doc_id)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def _unfolded(folded: DataFrame) -> DataFrame:
    """`copies` rows for each row, numbered by copy."""
    c = F.col
    some = folded.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {UNFOLD}"))))
    last = F.least(c("copies"), (c("piece") + 1) * UNFOLD) - 1
    return some.withColumn("copy", F.explode(F.sequence(c("piece") * UNFOLD, last)))


def resample(
    docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, ... among the drawn, else null) of every row.  Of the rows with
    `least_words` words at least, `percent` in a hundred (rounded down) are drawn."""
    c = F.col
    source = runs(_texts(docs, c(doc_id), text, order), order)
    table = gains(source, runs(_texts(target, F.lit(None).cast("long"), target_text, order), order), buckets)
    # a row a bucket, `buckets` in all; the row that marks a text's end has none
    with_gain = source.withColumn("bucket", bucket(c("run"), buckets)).join(F.broadcast(table), "bucket", "left")
    times = lambda which: F.sum(F.when(which, c("times")).otherwise(0))
    rows = with_gain.groupBy("doc_id", "key").agg(
        times(c("words") == 0).alias("copies"), times(c("words") == 1).alias("w"), times(c("words") > 0).alias("n"), F.sum(c("gain") * c("times")).alias("sum")
    )
    mean = F.when(c("n") > 0, F.expr("(sum - pmod(sum, n)) div n")).otherwise(F.lit(0)).cast("long")
    rows = rows.select("doc_id", "copies", F.expr("w div copies").alias("n_words"), F.expr("n div copies").alias("n_features"), mean.alias("weight"))
    rows = rows.groupBy("doc_id", "n_words", "n_features", "weight").agg(F.sum("copies").alias("copies"))
    scored = stash(rows.withColumn("score", c("weight") + gumbel(c("doc_id"), seed)), "scores")

    may = scored.where(c("n_words") >= least_words)
    levels = stash(may.groupBy("score").agg(F.sum("copies").alias("rows")), "score_levels")  # a row a score: about 120,000 at most
    draw = (levels.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] * percent) // 100
    above = F.coalesce(F.sum("rows").over(W.orderBy(c("score").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = levels.select("score", above.alias("above")).where(c("above") < draw)
    ties = W.partitionBy("score").orderBy(c("doc_id").asc_nulls_last(), "n_words", "n_features", "weight").rowsBetween(W.unboundedPreceding, -1)
    first = may.join(F.broadcast(reached), "score").withColumn("before", c("above") + F.coalesce(F.sum("copies").over(ties), F.lit(0)))
    rank = c("before") + c("copy") + 1
    names = ("doc_id", "n_words", "n_features", "weight", "score")
    drawn = _unfolded(first).select(*names, F.when(rank <= draw, rank).alias("rank"))
    others = scored.join(F.broadcast(reached.select("score", F.lit(True).alias("reached"))), "score", "left")
    others = others.where((c("n_words") < least_words) | c("reached").isNull())
    return drawn.unionByName(_unfolded(others).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
      FROM benchmark),
f AS (SELECT rid, unnest(w) AS word FROM d),
a AS (SELECT word, count(*) AS n FROM f GROUP BY word),
g AS (SELECT word, count(*) AS n FROM b GROUP BY word),
v AS (SELECT word, {crc32_sql("word")} % 10000 AS k FROM (SELECT word FROM a UNION SELECT word FROM g), crc_table),
s AS (SELECT k, sum(n)::DOUBLE AS s FROM a JOIN v USING (word) GROUP BY k),
t AS (SELECT k, sum(n)::DOUBLE AS t FROM g JOIN v USING (word) GROUP BY k),
q AS (SELECT i AS k, floor(1000.0::DOUBLE * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000))
        / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
m AS (SELECT rid, sum(gain)::BIGINT AS total, count(*) AS n FROM f JOIN v USING (word) JOIN q USING (k) GROUP BY rid),
z AS (SELECT rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
      FROM d LEFT JOIN m USING (rid)),
y AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln(u)))::BIGINT AS score FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
        count(*) OVER (PARTITION BY n_features >= 20) AS many FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= many * 10 // 100 THEN place END::BIGINT AS rank FROM o
"""
