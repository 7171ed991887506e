"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate each rule
is on good and on bad documents from their agreement alone, and the posterior probability of "good" replaces an all-must-pass filter.

One pass over the texts measures them (numpy over whole Arrow batches); the measures, a few dozen bytes a document, go
to the shared folder.  The votes depend on them alone, so EM runs over counts of vote patterns: at most 3 ** rules
rows whatever the corpus.  The posterior is a sum of native column expressions.

Null and empty texts have no words: they fail the base rule and all measures are 0.  Rows are independent, so repeated
ids, ties and extra columns do not matter; texts of any length are measured whole, a very long one as a block of its own,
and an empty table gives an empty result.  Columns of `keep` that bear the name of a result are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, FIRST, LOWER, Block, Words, blocks, repeated, windows
from .columns import no_clash
from .scratch import stash

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_closed_lines", "n_upper", "n_letters", "n_digits", "n_alpha_words", "n_distinct_words", "n_marks", "n_clean_words",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT = _table(b"#*$%&|<>"), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER = ALNUM[LOWER] & ~_DIGIT
_CLOSE = _table(b".!?:;\"')")
_MARK, _SIGN = _table(b"!?"), _table(b"#*$%&|<>@^~_=+\\/{}[]")


def measure(block: Block) -> list[np.ndarray]:
    """The columns MEASURES of a block's rows."""
    data, n = block.data, len(block)
    w = Words(block)
    per_word = lambda mask: np.bincount(w.row[mask], minlength=n)
    total = lambda table: block.per_row(table[data])

    # lines: from a row's start or behind a line feed, to a line feed or the row's end
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((block.offs[:-1], feeds + 1)), kind="stable")
    end = np.sort(np.concatenate((block.offs[1:], feeds)), kind="stable")
    # a feed that closes a row opens an (empty) line in it, which sorts next to the following row's first line
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    row = block.row_of(start)
    lines = np.bincount(row, minlength=n)
    _, again = repeated(row, w.hasher.spans(start, end))
    last = w.end[np.searchsorted(w.start, end) - 1] - 1
    closed = np.bincount(row[_CLOSE[data[last]]], minlength=n)

    at, h = windows(w, 3)
    times, _ = repeated(w.row[at], h)
    hit = np.zeros(len(w) + 3, dtype=bool)
    for j in range(3):
        hit[at[times > 1] + j] = True
    _, seen = repeated(w.row, w.hash)
    letters, signs = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_LETTER, _SIGN))
    return [
        w.counts, block.per_row(w.inside & FIRST[data]), total(_SYMBOL), np.bincount(row[again], minlength=n),
        per_word(hit[: len(w)]), lines, closed, total(_UPPER), block.per_row(_LETTER[data] & FIRST[data]), total(_DIGIT),
        per_word(letters[w.end] > letters[w.start]), w.counts - per_word(seen), total(_MARK),
        per_word(signs[w.end] == signs[w.start]),
    ]


@dataclass(frozen=True)
class Rule:
    """Votes "bad" where `bad` holds, else "good" where `good` holds, else abstains."""

    name: str
    bad: Column
    good: Column


def default_rules() -> list[Rule]:
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    between = lambda x, lo, hi: (x >= lo) & (x <= hi)
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    lines, repeats, upper = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "n_letters")
    marks, clean = share("n_marks", "n_words"), share("n_clean_words", "n_words")
    alpha, fresh, closed = share("n_alpha_words", "n_words"), share("n_distinct_words", "n_words"), share("n_closed_lines", "n_lines")
    return [
        Rule("word_length", ~between(length, 2.5, 14), between(length, 3, 10)),
        Rule("symbols", symbols > 0.1, symbols < 0.02),
        Rule("clean_words", clean < 0.8, clean > 0.95),
        Rule("marks", marks > 0.3, marks < 0.1),
        Rule("duplicate_lines", (lines > 0.4) & (c("n_lines") > 5), (lines == 0) & (c("n_lines") > 1)),
        Rule("repetition", repeats > 0.3, repeats < 0.1),
        Rule("capitals", upper > 0.4, upper < 0.2),
        Rule("letters", alpha < 0.7, alpha > 0.9),
        Rule("variety", (fresh < 0.15) & (c("n_words") < 2000), fresh > 0.3),
        Rule("line_ends", (closed < 0.1) & (c("n_lines") > 3), closed > 0.5),
        Rule("digits", share("n_digits", "n_letters") > 0.3, share("n_digits", "n_letters") < 0.1),
    ]


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and MEASURES for every row of docs."""
    no_clash(keep, *MEASURES, "base_failed", "quality", "kept")
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [f for f in src.schema.fields if f.name != "__text"]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for b in blocks(batch.column(batch.schema.get_field_index("__text"))):
                size = len(b)
                yield pa.RecordBatch.from_arrays(
                    [k.slice(b.rows.start, size) for k in kept] + [pa.array(m.astype(np.int64)) for m in measure(b)], names=[*names, *MEASURES]
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{m} long" for m in MEASURES])
    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents; of each rule's votes on good documents those that say good, on bad ones those that say bad."""

    good: float
    on_good: np.ndarray
    on_bad: np.ndarray

    @property
    def for_good(self) -> np.ndarray:
        """What a vote "good" adds to the log odds of good."""
        return np.log(self.on_good / (1 - self.on_bad))

    @property
    def for_bad(self) -> np.ndarray:
        """What a vote "bad" takes from them."""
        return np.log(self.on_bad / (1 - self.on_good))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.log(self.good / (1 - self.good)) + (patterns > 0) @ self.for_good - (patterns < 0) @ self.for_bad
        return 1 / (1 + np.exp(-odds))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior_strength: float = 0.01) -> Accuracies:
    """EM for one hidden good/bad label behind votes -1, 0, 1 (a row a pattern; counts: documents of each).

    Abstaining tells nothing.  The priors, worth `prior_strength` of the documents (10 at least), say that a rule clears 97
    of 100 good documents and catches 3 of 10 bad ones, as bad documents are bad in different ways.  A vote never counts
    against what it says, so the labels cannot trade places.
    """
    k, total = patterns.shape[1], counts.sum()
    now = Accuracies(0.9, np.full(k, 0.97), np.full(k, 0.3))
    if not total:
        return now
    strength = max(10.0, prior_strength * total)
    up, down = patterns > 0, patterns < 0
    for _ in range(rounds):
        post = now.posterior(patterns)
        g, b = counts * post, counts * (1 - post)
        on_good = np.clip((g @ up + 0.97 * strength) / (g @ up + g @ down + strength), 0.5, 0.9995)
        on_bad = np.clip((b @ down + 0.3 * strength) / (b @ up + b @ down + strength), 1.02 - on_good, 0.99)
        new = Accuracies(float(np.clip((g.sum() + 1) / (total + 2), 0.05, 0.99)), on_good, on_bad)
        moved = max(abs(new.on_good - now.on_good).max(), abs(new.on_bad - now.on_bad).max(), abs(new.good - now.good))
        now = new
        if moved < 1e-9:
            break
    return now


def quality_rules(
    docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5
) -> DataFrame:
    """`keep`, MEASURES, vote_<rule> (-1, 0, 1), base_failed, quality (posterior) and kept, a row for each of docs."""
    rules = default_rules() if rules is None else rules
    table = stash(measured(docs, text, keep), "quality_rules")
    c = F.col
    votes = [F.when(r.bad, F.lit(-1)).when(r.good, F.lit(1)).otherwise(F.lit(0)).alias(f"vote_{r.name}") for r in rules]
    voted = table.select("*", *votes, ((c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))).alias("base_failed"))
    names = [f"vote_{r.name}" for r in rules]
    found = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    patterns = np.array([[r[n] for n in names] for r in found], dtype=float).reshape(-1, len(names))
    order = np.lexsort(patterns.T)  # rows come in any order; sums must not depend on it
    acc = fit(patterns[order], np.array([r["count"] for r in found], dtype=float)[order])
    odds = F.lit(float(np.log(acc.good / (1 - acc.good))))
    for n, up, down in zip(names, acc.for_good, acc.for_bad, strict=True):
        odds = odds + F.when(c(n) > 0, F.lit(round(float(up), 9))).when(c(n) < 0, F.lit(round(-float(down), 9))).otherwise(F.lit(0.0))
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return voted.withColumn("quality", quality).withColumn("kept", ~c("base_failed") & (c("quality") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", *MEASURES[:5], "base_failed", "kept", F.col("quality"))
