"""From raw documents to token-id files: the stages of a training corpus, each written and read again.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights -> token-id files

Every stage but the last returns the columns of its input, whatever their names (they are hidden while an operator runs).
Null columns, empty tables, very long texts and repeated rows pass through as each operator's module says; rows that are
equal in all columns are interchangeable, and of other rows the choice is told by their contents, so reruns agree.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import hide, restore
from .decontaminate import decontaminate
from .mixing import mix
from .ngram_join import ngram_join
from .quality_rules import quality_rules
from .scratch import fresh, prepare, scope
from .token_files import read_corpus, write_corpus

HAS_WORD = r"[^\x20\x09-\x0D]"

#: SQL cannot express the quality rules' estimation or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    hidden, names = hide(docs)
    return restore(quality_rules(hidden, text=names["text"], keep=tuple(names.values())).where("kept"), names)


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(docs under hidden names with row_key, a digest of the whole row; the hidden name of each column)."""
    hidden, names = hide(docs)
    others = [new for old, new in names.items() if old != "text"]
    parts = [F.coalesce(F.md5(names["text"]), F.lit("null")), F.md5(F.to_json(F.struct(*others)) if others else F.lit(""))]
    return hidden.withColumn("row_key", F.md5(F.concat(*parts))), names


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at a similarity of 0.8: the smallest doc_id's (null last, then the
    smallest md5 of the text, then of the whole row).  Rows without words are no group and stay."""
    c = F.col
    rows, names = _hidden(docs)
    text, doc_id = names["text"], names["doc_id"]
    slim = rows.select(doc_id, text, "row_key", F.md5(text).alias("text_key"))
    groups = ngram_join(slim, size=5, num=80, den=100, text=text, doc_id=doc_id, keep=("row_key", "text_key"))
    best = F.min(F.struct(c("doc_id").isNull().alias("last"), "doc_id", "text_key", "row_key")).alias("best")
    kept = groups.where(c("group_id").isNotNull()).groupBy("group_id").agg(best).select("best.row_key")
    worded = F.coalesce(c(text).rlike(HAS_WORD), F.lit(False))
    # equal rows become one in each task, before any text is sent; both steps are dealt by row_key, so texts are sent once
    one = rows.where(worded).dropDuplicates(["row_key"]).join(kept, "row_key", "left_semi")
    return restore(one.unionByName(rows.where(~worded)), names)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window of words with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of the mix, always the whole text: the take that crosses a source's target counts if half of the
    text at least lies before it.  Documents that the mix does not need go.  Equal rows share their takes."""
    c = F.col
    rows, names = _hidden(docs)
    mixed = mix(rows, text=names["text"], doc_id=names["doc_id"], source=names["source"], ident=c("row_key"))
    whole = F.size(F.filter("takes", lambda x: 2 * x["words"] >= c("size")))
    times = mixed.groupBy("ident").agg(F.sum(whole).alias("times")).where("times > 0")
    taken = rows.dropDuplicates(["row_key"]).join(times, c("row_key") == c("ident"))
    return restore(taken.withColumn("take", F.explode(F.sequence(F.lit(1).cast("long"), c("times")))), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of all rows in ascending doc_id, read back: doc_id, start, n_tokens, ids_crc32."""
    return read_corpus(*write_corpus(docs))


def _prepared(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _prepared(quality)),
    ("n-gram Jaccard join", _prepared(near_duplicates)),
    ("benchmark decontamination", _prepared(contamination)),
    ("mixing sources to target weights", _prepared(mixture)),
    ("token-ID / binary output", _prepared(tokens)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's output stays in the shared folder; its other tables are removed."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
