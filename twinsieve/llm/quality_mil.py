"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE words each, to its end).  Every passage is encoded from its own words alone, by
measures of their surface and signed hashed sums of their content; gated attention, learned from document labels alone,
weights the passages; the weighted sum of their encodings is scored.  Training is numpy on the driver over a bounded
sample (MOST_LABELLED rows, MOST_PASSAGES passages of each); scoring is one pass over all passages of whole texts, numpy
over Arrow batches, without a shuffle.

Null texts are empty; a text without words is one empty passage and gets a score like any other.  With no labels every
score is 0.5; of labels that contradict each other the largest counts, and of texts that share a labelled id one is drawn
by its hash.  Rows are scored one by one, so repeated ids, ties and extra columns do not matter; texts of any length are
scored whole, and an empty table gives an empty result.  Columns of `keep` that bear the name of a result are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, FIRST, LOWER, Block, Hasher, Words, blocks, repeated, windows
from .columns import no_clash
from .labelled import fold, sample

PASSAGE = 64
#: Rows of labelled documents that training looks at, at most, and passages of one, spread evenly over it; scoring looks at all.
MOST_LABELLED, MOST_PASSAGES = 6_000, 128


def _of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _of(bytes(range(65, 91))), _of(bytes(range(48, 58)))
_LETTER = ALNUM[LOWER] & ~_DIGIT
_SIGN, _MARK, _BAR, _STOP, _LINE = _of(b"#*$%&<>@^~_=+\\/{}[]"), _of(b"!?"), _of(b"|"), _of(b".,;:"), _of(b"\n")

SURFACE = (
    "words", "length", "spread", "capitals", "shouted", "digits", "signs", "marks", "bars", "stops", "lines", "letters", "variety",
    "same_as_last", "repeated_words", "repeated_lines", "ends_signed",
)
#: Content: signed sums of the passage's words by a hash of the lower-cased word.
BUCKETS = 32
FEATURES = (*SURFACE, *(f"content_{k}" for k in range(BUCKETS)))


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, FEATURES of each), in order; a row without words has one passage."""
    n, w, data = len(block), Words(block), block.data
    if not len(w):
        return np.arange(n), np.zeros((n, len(FEATURES)))
    number = np.arange(len(w)) - w.first[w.row]
    counts = np.maximum(-(-w.counts // PASSAGE), 1)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    total = int(counts.sum())
    place = first[w.row] + number // PASSAGE  # the passage of each word
    row = np.repeat(np.arange(n), counts)
    words = np.bincount(place, minlength=total).astype(float)
    per_word = np.maximum(words, 1)

    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    inside = lambda table: (lambda s: s[w.end] - s[w.start])(sums(table[data]))
    add = lambda v: np.bincount(place, weights=v, minlength=total)
    size, upper, letters, digits = inside(FIRST), inside(_UPPER), (lambda s: s[w.end] - s[w.start])(sums(_LETTER[data] & FIRST[data])), inside(_DIGIT)
    chars = np.maximum(add(size), 1)
    same = np.zeros(len(w), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (place[1:] == place[:-1])
    at, h = windows(w, 3)
    inner = place[at] == place[np.minimum(at + 2, len(w) - 1)]  # all of a passage's measures are those of its own words
    at, h = at[inner], h[inner]
    often = repeated(place[at], h)[0] > 1
    again = np.zeros(len(w) + 3, bool)
    for j in range(3):
        again[at[often] + j] = True
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((block.offs[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((block.offs[1:], feeds)), kind="stable")
    fw = np.searchsorted(w.start, starts)
    has = np.searchsorted(w.start, ends) > fw
    starts, ends, fw = starts[has], ends[has], fw[has]
    double = repeated(place[fw], w.hasher.spans(starts, ends))[0] > 1
    lines = np.bincount(place[fw], minlength=total)
    mean = add(size) / per_word
    low = Hasher(LOWER[data]).spans(w.start, w.end)
    sign = np.where(low >> np.uint64(63), 1.0, -1.0)
    content = np.bincount(place * BUCKETS + (low % np.uint64(BUCKETS)).astype(np.int64), weights=sign, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out = [
        words / PASSAGE, mean / 10, np.sqrt(np.maximum(add(size.astype(float) ** 2) / per_word - mean**2, 0)) / 10, add(upper) / chars,
        add((upper > 1) & (upper == letters)) / per_word, add(digits) / chars, add(inside(_SIGN)) / per_word, add(inside(_MARK)) / per_word,
        add(inside(_BAR)) / per_word, add(inside(_STOP)) / per_word, lines / per_word, add(letters) / chars,
        1 - np.bincount(place[repeated(place, w.hash)[1]], minlength=total) / per_word, add(same) / per_word, add(again[: len(w)]) / per_word,
        np.bincount(place[fw[double]], minlength=total) / np.maximum(lines, 1), add(_SIGN[data[w.end - 1]]) / per_word,
    ]
    return row, np.column_stack((*out, content / np.sqrt(per_word)[:, None]))


@dataclass
class Network:
    """encoding h = tanh(x W + b); weight of a passage = softmax over its document of u . (tanh(h V) * sigmoid(h U));
    score = sigmoid(c . sum(weight * h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, start: np.ndarray, seg: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["u"]
        e = np.exp(e - np.maximum.reduceat(e, start)[seg])
        a = e / np.add.reduceat(e, start)[seg]
        z = np.add.reduceat(a[:, None] * h, start)
        return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))

    def scores(self, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score of each of n documents, attention of each passage)."""
        start = np.searchsorted(row, np.arange(n))
        *_, a, _, y = self._forward((x - self.mean) / self.scale, start, row)
        return y, a

    @classmethod
    def fit(cls, x: np.ndarray, row: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
        """Rows of x (passages) sorted by document; Adam over batches of documents; a fixed seed."""
        rng = np.random.default_rng(5)
        mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        m = x.shape[1]
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"W": init(m, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "u": init(gate), "c": np.zeros(hidden), "d": np.zeros(1)}
        net = cls(mean, scale, p)
        if not len(y):
            return net
        x = np.clip((x - mean) / scale, -8, 8)
        bounds = np.searchsorted(row, np.arange(len(y) + 1))
        m1, m2, step = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
        m1, m2 = m1
        size = min(256, max(16, len(y) // 8))
        epochs = max(epochs, min(600, 1500 * size // len(y)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), size):
                docs = order[i : i + size]
                n = bounds[docs + 1] - bounds[docs]
                start = np.cumsum(n) - n
                seg = np.repeat(np.arange(len(docs)), n)
                own = x[np.arange(n.sum()) - start[seg] + bounds[docs][seg]]
                h, t, s, a, z, q = net._forward(own, start, seg)
                g = (q - y[docs]) / len(docs)
                gz = g[:, None] * p["c"]
                ga = (gz[seg] * h).sum(1)
                ge = a * (ga - np.add.reduceat(a * ga, start)[seg])
                gt, gs = ge[:, None] * p["u"] * s * (1 - t**2), ge[:, None] * p["u"] * t * s * (1 - s)
                gh = a[:, None] * gz[seg] + gt @ p["V"].T + gs @ p["U"].T
                gx = gh * (1 - h**2)
                grads = {"c": z.T @ g, "d": np.array([g.sum()]), "u": (t * s).T @ ge, "V": h.T @ gt, "U": h.T @ gs, "W": own.T @ gx, "b": gx.sum(0)}
                step += 1
                for k, v in grads.items():
                    v = v + decay * p[k] * (k not in "bd")
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return net


def fit(docs: DataFrame, labels: DataFrame, allowed, label: str = "quality", text: str = "text", most: int = MOST_LABELLED) -> Network:
    """The network for a 0/1 label, from at most `most` labelled documents for which `allowed` holds."""
    rows = sample(docs, labels, label, allowed, most, text)

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(0)):
                row, x = passages(b)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                n = np.bincount(row, minlength=len(b))[row]
                few = number * MOST_PASSAGES // n != (number - 1) * MOST_PASSAGES // n  # the first of each of so many equal parts
                row, x, number = row[few], x[few], number[few]
                own = np.arange(b.rows.start, b.rows.stop)[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array(number)] + [pa.array(c.astype(np.float32)) for c in x.T],
                    names=["doc_id", "y", "passage", *FEATURES],
                )

    got = rows.select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, passage long, " + ", ".join(f"{f} float" for f in FEATURES)).toPandas()
    x = got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["passage"], got["doc_id"]))  # repeated ids lie together, as one bag
    ids, row = np.unique(got["doc_id"].to_numpy()[order], return_inverse=True)
    y = np.zeros(len(ids))
    y[row] = got["y"].to_numpy(float)[order]
    return Network.fit(x[order], row, y)


def score(docs: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score, passages and focus (number of the passage with the largest attention, from 0) of every row."""
    no_clash(keep, "score", "passages", "focus")
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = src.schema.fields[:-1]

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(len(fields))):
                row, x = passages(b)
                z = np.clip((x - net.mean) / net.scale, -8, 8) * net.scale + net.mean
                s, a = net.scores(z, row, len(b))
                first = np.searchsorted(row, np.arange(len(b) + 1))
                top = np.lexsort((np.arange(len(a)), -a, row))[first[:-1]] - first[:-1]
                own = [batch.column(i).slice(b.rows.start, len(b)) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array(np.diff(first)), pa.array(top)], names=[f.name for f in fields] + ["score", "passages", "focus"])

    return src.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "passages long", "focus long"]))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages", "focus")
