"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (learned words and word beginnings, by how much likelier they make the label), how
near its words are to the second person, capitals, punctuation and obfuscation.  Lexicon, trees and calibration are
learned on a bounded sample of labelled rows (MOST_LABELLED) by cross-fitting over FOLDS: features of a row come from a
lexicon that has not seen it.  Whole texts are scored in one pass by numpy over Arrow batches; nothing is shuffled.

Null texts are empty; an empty text has all features 0 and gets a score like any other.  With no labels at all every
score is 0.5; of labels that contradict each other the largest counts, and equal scores before calibration are pooled.
Texts of any length are scored whole.  Rows are scored one by one, so repeated ids, ties and extra columns do not matter,
and an empty table gives an empty result; a column of `keep` that is named score is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, FIRST, LOWER, Block, Words, blocks, repeated
from .columns import no_clash
from .labelled import fold, sample
from .scratch import stash

#: Rows of labelled documents that are looked at, at most, for lexicon, trees and calibration together.
MOST_LABELLED = 24_000
MOST_TERMS = 2_000
#: Parts of the sample that take turns in being held out.
FOLDS = 4
PREFIXES = (4, 5, 6, 7, 8)

#: Second-person words of some languages (fixed values).
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro"
).split()
#: What digits and signs stand for inside words (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}

_LEET = LOWER.copy()
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[0x80:] = True
_UPPER, _DIGIT, _SIGN, _BANG = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_SIGN[list(b"@$*#%&+")] = True
_BANG[list(b"!?")] = True
_PUNCT = ~ALNUM[LOWER] & (np.arange(256) > 32) & (np.arange(256) < 127)

FEATURES = (
    "n_words", "hits", "hit_weight", "strong", "density", "strong_density", "distinct", "best_20", "near_second", "second",
    "leet_hits", "capitals", "shouted", "bangs", "punctuation", "mixed_words", "stretched", "word_length",
)


def _hashes(words: list[str]) -> np.ndarray:
    block = next(blocks(pa.array([" ".join(words)])))
    return np.sort(Words(block, ALNUM, lower=True).hash)


_second: list[np.ndarray] = []


def terms(w: Words) -> list[np.ndarray]:
    """For each word its hash, then those of its beginnings of PREFIXES bytes (0: the word is no longer than that)."""
    out = [w.hash]
    for k in PREFIXES:
        n = w.end - w.start
        h = w.hasher.spans(w.start, np.minimum(w.end, w.start + k)) * np.uint64(2 * k + 1)
        out.append(np.where(n > k, h, np.uint64(0)))
    return out


@dataclass
class Lexicon:
    """Hashes of terms, sorted, and what each adds to the log odds of the label."""

    hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weights(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash) or not len(h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.weight[at], 0.0)

    def of_words(self, w: Words) -> np.ndarray:
        """The largest weight of each word's terms."""
        return np.max([self.weights(h) for h in terms(w)], axis=0) if len(w) else np.zeros(0)


def count_terms(rows: DataFrame) -> DataFrame:
    """h (term), n1_k, n0_k: in how many positive and other documents of fold k of rows (text, y, part) each term occurs."""
    names = [f"n{y}_{k}" for k in range(FOLDS) for y in (1, 0)]

    def run(batches):
        for batch in batches:
            y, part = (np.array(batch.column(i).to_pylist(), dtype=np.int64) for i in (1, 2))
            for b in blocks(batch.column(0)):
                w = Words(b, ALNUM, lower=True)
                row, h = np.tile(w.row, 1 + len(PREFIXES)), np.concatenate(terms(w))
                row, h = row[h != 0], h[h != 0]
                once = ~repeated(row, h)[1]
                row = row[once]
                keys, which = np.unique(h[once], return_inverse=True)
                own = 2 * part[b.rows][row] + 1 - y[b.rows][row]
                n = np.bincount(which * len(names) + own, minlength=len(keys) * len(names)).reshape(len(keys), -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x.copy()) for x in n.T)], names=["h", *names])

    counts = rows.select("text", "y", "part").mapInArrow(run, "h long, " + ", ".join(f"{x} long" for x in names))
    return counts.groupBy("h").agg(*(F.sum(x).alias(x) for x in names))


def learn_lexicon(counts: DataFrame, totals: dict[tuple[int, int], int], without: int | None = None, least: int = 3) -> Lexicon:
    """From `count_terms` and the number of documents of each (y, fold), all folds but `without`: terms in `least` positive
    documents at least and much likelier there, MOST_TERMS at most."""
    use = [k for k in range(FOLDS) if k != without]
    n1, n0 = (sum(F.col(f"n{y}_{k}") for k in use) for y in (1, 0))
    positives, negatives = (sum(totals.get((y, k), 0) for k in use) for y in (1, 0))
    weight = F.log((n1 + 0.5) / F.lit(positives + 1.0)) - F.log((n0 + 0.5) / F.lit(negatives + 1.0))
    best = counts.select("h", n1.alias("n1"), weight.alias("weight")).where((F.col("n1") >= least) & (F.col("weight") > 1.5))
    best = best.orderBy(F.desc(F.col("weight") * F.log("n1")), "h").limit(MOST_TERMS)
    got = sorted((np.uint64(r["h"] & (2**64 - 1)), r["weight"]) for r in best.collect())
    return Lexicon(np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], float))


def features(block: Block, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of a block's rows."""
    if not _second:
        _second.append(_hashes(SECOND_PERSON))
    n, w = len(block), Words(block, ALNUM, lower=True)
    weight = lexicon.of_words(w)
    hit, words = weight > 0, np.maximum(w.counts, 1)
    per = lambda mask, v=None: np.bincount(w.row[mask], weights=None if v is None else v[mask], minlength=n).astype(float)
    at = np.minimum(np.searchsorted(_second[0], w.hash), len(_second[0]) - 1)
    second = _second[0][at] == w.hash

    near, run = np.zeros(len(w), bool), np.zeros(len(w) + 1)
    for j in (-3, -2, -1, 1, 2, 3):
        other = np.arange(len(w)) + j
        ok = (other >= 0) & (other < len(w))
        other = np.clip(other, 0, max(len(w) - 1, 0))
        near |= ok & second[other] & (w.row[other] == w.row) if len(w) else False
    np.cumsum(hit, out=run[1:])
    to = np.minimum(np.arange(len(w)) + 20, w.first[w.row + 1]) if len(w) else np.zeros(0, int)
    best = np.zeros(n)
    np.maximum.at(best, w.row, run[to] - run[:-1])
    _, again = repeated(w.row[hit], w.hash[hit])

    data = block.data
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    upper, letter, sign = sums(_UPPER[data]), sums(_LETTER[LOWER[data]]), sums(_DIGIT[data] | _SIGN[data])
    # obfuscation: words of the text as it stands, between white space, with signs or digits between letters
    raw = Words(block)
    inner = (letter[raw.end] - letter[raw.start] > 1) & (sign[raw.end - 1] - sign[np.minimum(raw.start + 1, raw.end - 1)] > 0)
    plain = Words(Block(_LEET[data], block.offs, block.rows), ALNUM, lower=True)
    leet = np.bincount(plain.row[lexicon.of_words(plain) > 0], minlength=n) - per(hit)
    same = np.zeros(len(data) + 1)
    if len(data) > 2:
        three = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[LOWER[data[2:]]] & (data[2:] < 0x80)
        same[3:] = np.cumsum(three)
    stretched = np.bincount(w.row[same[w.end] > same[np.minimum(w.start + 2, w.end)]], minlength=n)
    letters = np.maximum(block.per_row(_LETTER[LOWER[data]] & FIRST[data]), 1)
    shouted = (upper[w.end] - upper[w.start] > 2) & (upper[w.end] - upper[w.start] == letter[w.end] - letter[w.start])
    out = [
        np.log1p(w.counts), np.log1p(per(hit)), np.log1p(per(hit, weight)), np.log1p(per(weight > 3.5)), 100 * per(hit) / words, 100 * per(weight > 3.5) / words,
        np.log1p(per(hit) - np.bincount(w.row[hit][again], minlength=n)), best, 100 * per(near & hit) / words, 100 * per(second) / words,
        np.maximum(leet, 0), block.per_row(_UPPER[data]) / letters, per(shouted) / words, block.per_row(_BANG[data]) / words, block.per_row(_PUNCT[data]) / words,
        np.bincount(raw.row[inner], minlength=n) / words, stretched / words, block.per_row(w.inside & FIRST[data]) / words,
    ]
    return np.column_stack(out)


class Trees:
    """Gradient-boosted trees of fixed depth for a 0/1 label; splits at quantiles of each feature."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        if len(set(y.tolist())) < 2:
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        width, nf = self.bins, x.shape[1]
        flat = code + np.arange(nf) * width
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                k, first = 2**level, 2**level - 1
                key = (node - first)[:, None] * (nf * width) + flat
                gs = np.bincount(key.ravel(), weights=np.repeat(g, nf), minlength=k * nf * width).reshape(k, nf, width).cumsum(2)
                hs = np.bincount(key.ravel(), weights=np.repeat(h, nf), minlength=k * nf * width).reshape(k, nf, width).cumsum(2)
                cs = np.bincount(key.ravel(), minlength=k * nf * width).reshape(k, nf, width).cumsum(2)
                gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(cs < self.least) | (ct - cs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                for i in np.flatnonzero(gain.reshape(k, -1).max(1) > 1e-6):
                    f, b = divmod(int(best[i]), width)
                    if b < len(edges[f]):
                        feature[first + i], cut[first + i] = f, edges[f][b]
                f = feature[node]
                right = (f >= 0) & (x[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            score += value[node - len(feature)]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, heights) of the non-decreasing function of x nearest to y (pool adjacent violators); interpolate between.
    Equal x are one place, with the mean of their y and their number as weight."""
    places, which, times = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(which, weights=y, minlength=len(places)) / np.maximum(times, 1)
    groups: list[list[float]] = []  # sum of x, sum of y, weight
    for a, b, n in zip(places.tolist(), means.tolist(), times.tolist(), strict=True):
        groups.append([a * n, b * n, float(n)])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            last = groups.pop()
            groups[-1] = [u + v for u, v in zip(groups[-1], last, strict=True)]
    return np.array([g[0] / g[2] for g in groups]), np.array([g[1] / g[2] for g in groups])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    places: np.ndarray
    heights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.decide(x)
        p = 1 / (1 + np.exp(-raw))
        if not len(self.places):
            return p
        # a thousandth of the uncalibrated score orders documents within a flat part
        return 0.999 * np.interp(raw, self.places, self.heights) + 0.001 * p


def _table(rows: DataFrame, lexicons: list[Lexicon]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, part) of a bounded sample; the rows of part k by lexicon k, which has not seen them."""

    def run(batches):
        for batch in batches:
            part = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            for k in np.unique(part).tolist():
                own = batch.take(pa.array(np.flatnonzero(part == k)))
                for b in blocks(own.column(0)):
                    x = features(b, lexicons[k])
                    yield pa.RecordBatch.from_arrays([own.column(i).slice(b.rows.start, len(b)) for i in (1, 2)] + [pa.array(c) for c in x.T], names=["y", "part", *FEATURES])

    got = rows.select("text", "y", "part").mapInArrow(run, "y int, part int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    return got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float), got["part"].to_numpy(int)


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "toxic", text: str = "text", most: int = MOST_LABELLED) -> Model:
    """The model for a 0/1 label, from at most `most` rows of labelled documents for which `allowed` holds.

    The rows of each fold have features by a lexicon of the other folds, and trees and calibration are fitted to these, so
    no score is fitted to words that chose themselves; the lexicon that scores is learned on all folds."""
    rows = sample(docs, labels, label, allowed, most, text).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    rows = stash(rows, "toxicity_sample")
    totals = {(r["y"], r["part"]): r["count"] for r in rows.groupBy("y", "part").count().collect()}
    counts = stash(count_terms(rows), "toxicity_terms")
    lexicons = [learn_lexicon(counts, totals, k) for k in range(FOLDS)]
    x, y, part = _table(rows, lexicons)
    order = np.lexsort((*x.T, y, part))  # rows come in any order; fits must not depend on it
    x, y, part = x[order], y[order], part[order]
    places, heights, raw = np.zeros(0), np.zeros(0), np.zeros(len(y))
    for k in range(FOLDS):  # each part is scored by trees that have not seen it, for calibration
        own = part == k
        if own.any() and (~own).any():
            raw[own] = Trees().fit(x[~own], y[~own]).decide(x[own])
    if len(set(y.tolist())) == 2:
        places, heights = isotonic(raw, y)
    return Model(learn_lexicon(counts, totals), Trees().fit(x, y) if len(y) else Trees(), places, heights)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score of every row."""
    no_clash(keep, "score")
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = src.schema.fields[:-1]
    held = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees: under 1 MB by their parameters

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(len(fields))):
                s = held.value.score(features(b, held.value.lexicon))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(b.rows.start, len(b)) for i in range(len(fields))] + [pa.array(s)], names=[f.name for f in fields] + ["score"])

    return src.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"]))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
