"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation, over corpus-wide counts.

1. Every word of every training text is counted (numpy in each task, then sums by a 64-bit word hash).  The counts give
   the unigram base score, the model's vocabulary (all words above a count that grows with the training tokens, so that
   there are about their cube root times a constant, and one token for all others), the noise distribution, and the
   distribution of the words behind that one token.
2. Every training token is trained on, in one of ROUNDS rounds.  A task makes a pass of stochastic gradient steps over its
   own texts of the round from the parameters it is given, with noise words drawn from the unigram distribution and shared
   by a minibatch, so that the scores are matrix products; equal tokens of a block are one with a weight.  The rows of
   parameters that tasks have changed are averaged by tokens after each round.
3. Scoring normalises exactly, in two levels: over frequent tokens and classes of the others for each distinct context
   of a block, and over the words of the class for each distinct token in one.  A word outside the vocabulary gets the
   other-token's probability times its share of it.

Counts of the KNOWN most frequent words, and of all the model's, go to every task; rarer words are joined by hash, with the texts'
words already summed.  A word that occurs in very many texts is frequent, so the join has no hot key.

Lower-casing is A-Z only, words are `[^\\x20\\x09-\\x0D]+`, and every text has one end token behind its words; null texts
are empty.  A null doc_id is not held out.  Rows are scored one by one, so repeated ids and ties do not matter, and texts
of any length are scored whole; an empty table gives an empty result.  Of words that tie at the edge of the vocabulary the
smallest hashes are in.  With nothing to train on, all words are unknown and both scores are those of a uniform guess over
one unknown word.  Extra columns are not looked at; those of `keep` that bear the name of a result are an error.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, blocks
from .columns import no_clash
from .labelled import fold
from .scratch import filesystem, fresh, put, stash

#: The model's words: all that occur (training tokens) ** (2 / 3) / RARE times at least, and VOCABULARY at least.
VOCABULARY, RARE = 1_023, 436
#: Tokens that are no part of a class.
HEAD = 256
#: Words of blocks that a counting task gathers before it adds up equal ones.
DISTINCT = 1_000_000
#: Where sums of squared gradients start: small, for a minibatch moves a rare word little.
FIRST_SQUARE = 1e-4
KNOWN = 300_000
DIMENSIONS, CONTEXT = 24, 2
#: Tokens that a task gathers before it trains on them.
TOKENS = 500_000
ROUNDS, NOISE, CLASS_NOISE, RATE = 2, 96, 48, 0.15
#: A minibatch: groups of equal contexts, FIRST_BATCH at first, then a share of all that the task has met, MINIBATCH at most;
#: CLASS_BATCH within a class.  A group has about OFTEN tokens at most.
FIRST_BATCH, BATCH_SHARE, MINIBATCH, CLASS_BATCH, OFTEN = 16, 512, 256, 512, 64
#: Tasks whose parameters are averaged first among themselves.
NEIGHBOURS = 64
#: Rows of parameters that are averaged together.
ROWS = 256
#: The hash of the end token; no word has it, as far as 64 bits can tell.
END = 0x5E5D_0E0D_E0F7_EA75


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """h (word hash), c: how often each word occurs in docs, END once a row."""

    def summed(parts):
        h, which = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        c = np.bincount(which, weights=np.concatenate([x for _, x in parts]), minlength=len(h)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    def run(batches):
        parts = []
        for batch in batches:
            for b in blocks(batch.column(0), 4 << 20):
                h, c = np.unique(Words(b, NOT_SPACE, lower=True).hash, return_counts=True)
                parts.append((np.append(h, np.uint64(END)), np.append(c, len(b))))
                if sum(len(h) for h, _ in parts) > DISTINCT:
                    yield summed(parts)
                    parts = []
        if parts:
            yield summed(parts)

    src = docs.select(F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Corpus totals and the most frequent words: `h`, `c` counts, `id` of the model (0: other)."""

    tokens: int
    distinct: int
    h: np.ndarray
    c: np.ndarray
    id: np.ndarray
    unigram: np.ndarray  # counts of the model's tokens, the other-token first
    rare: float  # what the other-token's words add up to, smoothed, with one place for all unknown words

    def __post_init__(self) -> None:
        """A hash table with open addresses: each word lies at the first free place from its hash's low bits on."""
        bits = max(4, int(np.ceil(np.log2(len(self.h) + 1))) + 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.place = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(self.h)), (self.h & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.place[at] < 0)
            self.place[at[free[::-1]]] = left[free[::-1]]  # of several for one place, the first stays
            wrong = self.place[at] != left
            left, at = left[wrong], (at[wrong] + 1) & int(self.mask)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, model id) of words; count -1 where the word is not among the known ones."""
        count, ids = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        left, at = None, (h & self.mask).astype(np.int64)
        while len(at):
            place = self.place[at]
            same = (place >= 0) & (self.h[place] == (h if left is None else h[left])) if len(self.h) else np.zeros(len(at), bool)
            own = same if left is None else left[same]
            count[own], ids[own] = self.c[place[same]], self.id[place[same]]
            go = np.flatnonzero((place >= 0) & ~same)
            left, at = go if left is None else left[go], (at[go] + 1) & int(self.mask)
        return count, ids


def vocabulary(counts: DataFrame, size: int = VOCABULARY, known: int = KNOWN) -> Vocabulary:
    """The `known` most frequent words, or all of the model's, come to the driver; the model has those that occur tokens **
    (2 / 3) / RARE times, and `size` at least.  A histogram of log counts tells above which count they lie; of the step at
    the edge the smallest hashes are taken."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step, order = F.floor(F.log2("c") * 32).cast("int"), F.pmod("h", F.lit(1 << 30))
    often = max(2, int(np.ceil(tokens ** (2 / 3) / RARE)))
    edge, n, least, want = -1, 0, 0, max(known, size)
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 2,048 rows at most
        if n + r["count"] > want:
            edge, room = r["step"], (want - n) / r["count"]
            least = int((1 << 30) * min(1.0, room + 4 * np.sqrt(room / r["count"]) + 16 / r["count"]))
            break
        n += r["count"]
    top = counts.where((step > edge) | (F.col("c") >= often)).toPandas()
    if edge >= 0 and len(top) < want:
        rest = counts.where((step == edge) & (F.col("c") < often) & (order < least)).toPandas()
        h = rest["h"].to_numpy(np.int64)
        top = pd.concat((top, rest.iloc[np.lexsort((h, h % (1 << 30)))[: want - len(top)]]))
    h, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    size = max(size, int((c >= often).sum()))
    ids = np.where(np.arange(len(h)) < size, np.arange(len(h)) + 1, 0)
    rare_tokens, rare_words = tokens - int(c[:size].sum()), distinct - len(c[:size])
    if (size + 3) ** 3 >= 1 << 63:  # a context and its word are one 64-bit number
        raise ValueError(f"a vocabulary of {size} words is too large: 2,000,000 are the most")
    unigram = np.concatenate(([rare_tokens], c[:size])).astype(float)
    return Vocabulary(tokens, distinct, h.view(np.uint64), c, ids, unigram, rare_tokens + 0.5 * rare_words + 0.5)


@dataclass
class Model:
    """score(row | context) = sum over places i of (scale_i * embed[context_i]) . output[row] + bias[row]; `squares` are the
    sums of squared gradients that set each parameter's step (Adagrad), in the same order.

    The first HEAD tokens are units of their own.  The others are dealt by rank into classes, as many as a class has
    tokens; a class is a unit too, with a row behind the tokens' rows of output and bias.  A token's probability is its
    unit's among all units times, in a class, its own among the class."""

    embed: np.ndarray  # one row for each token and one for "before the text"
    output: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    squares: list[np.ndarray]
    met: int = 0  # groups that this task has trained on

    @classmethod
    def start(cls, unigram: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        rng, n = np.random.default_rng(11), len(unigram)
        weight = unigram + 0.5
        classes = n_classes(n)
        weight = np.concatenate((weight, [weight[HEAD + k :: classes].sum() for k in range(classes)]))
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        bias = np.log(weight / weight[:n].sum()).astype(np.float32)
        own = (draw(n + 1, dimensions), draw(n + classes, dimensions), np.ones((CONTEXT, dimensions), np.float32), bias)
        return cls(*own, [np.full(x.shape, 1e-3 if x is own[2] else FIRST_SQUARE, np.float32) for x in own])

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.output, self.scale, self.bias]

    @property
    def tokens(self) -> int:
        return len(self.embed) - 1

    @property
    def units(self) -> np.ndarray:
        """The rows of output that are units."""
        return np.concatenate((np.arange(min(self.tokens, HEAD)), np.arange(self.tokens, len(self.output))))

    def members(self, k: int) -> slice:
        """The rows of output that class k holds."""
        return slice(HEAD + k, self.tokens, n_classes(self.tokens))

    def unit(self, words: np.ndarray) -> np.ndarray:
        """Places in `units` of the words' units."""
        return np.where(words < HEAD, words, HEAD + (words - HEAD) % max(n_classes(self.tokens), 1))

    def by_class(self, words: np.ndarray):
        """(class, which of words are in it, their places in the class) of each class that words hold."""
        at = np.flatnonzero(words >= HEAD)
        if not len(at):
            return
        place, k = np.divmod(words[at] - HEAD, n_classes(self.tokens))
        order = np.argsort(k, kind="stable")
        at, place, k = at[order], place[order], k[order]
        bounds = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(k[i]), at[i:j], place[i:j]

    def copy(self) -> Model:
        """The same parameters, for another task."""
        return Model(*(x.copy() for x in self.parameters), [x.copy() for x in self.squares])

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """Vectors predicted for rows of context ids, nearest first."""
        out = np.zeros((len(contexts), self.embed.shape[1]), np.float32)
        for i in range(CONTEXT):
            out += self.scale[i] * self.embed.take(contexts[:, i], axis=0)
        return out

    def log_probability(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities of words in contexts (see `encode`); equal tokens are scored once, and each
        distinct context is normalised once over the units."""
        if not len(words):
            return np.zeros(0)
        before, n = len(self.embed), self.tokens
        token, back = np.unique(contexts * n + words, return_inverse=True)
        context, words = np.divmod(token, n)
        new = np.concatenate(([True], context[1:] != context[:-1]))
        keys, which = context[new], np.cumsum(new) - 1
        out, units, unit = np.empty(len(words)), self.units, self.unit(words)
        output, bias = self.output[units].T.copy(), self.bias[units]
        bounds = np.searchsorted(which, np.arange(0, len(keys) + 1024, 1024))
        for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if i < j:
                r = self.predict(np.column_stack(np.divmod(keys[1024 * k : 1024 * (k + 1)], before)))
                out[i:j] = _log_softmax(r, output, bias, which[i:j] - 1024 * k, unit[i:j])
        for k, at, place in self.by_class(words):
            output, bias = self.output[self.members(k)].T.copy(), self.bias[self.members(k)]
            for i in range(0, len(at), 1024):
                own = at[i : i + 1024]
                r = self.predict(np.column_stack(np.divmod(context[own], before)))
                out[own] += _log_softmax(r, output, bias, np.arange(len(own)), place[i : i + 1024])
        return out[back]

    def table(self) -> np.ndarray:
        """All parameters as rows of one width, each row's squares behind it, for averaging."""

        def rows(embed, output, scale, bias):
            one = lambda x: np.pad(x, ((0, 0), (0, 1)))
            return np.concatenate((one(embed), np.column_stack((output, bias)), one(scale)))

        return np.column_stack((rows(*self.parameters), rows(*self.squares)))

    @classmethod
    def of_table(cls, t: np.ndarray, like: Model) -> Model:
        d, n, m = like.embed.shape[1], len(like.embed), len(like.output)
        split = lambda x: [x[:n, :d].copy(), x[n : n + m, :d].copy(), x[n + m :, :d].copy(), x[n : n + m, d].copy()]
        t = t.astype(np.float32)
        return cls(*split(t[:, : d + 1]), split(t[:, d + 1 :]))


def n_classes(tokens: int) -> int:
    return int(np.ceil(np.sqrt(max(tokens - HEAD, 0)) / 2))


def _log_softmax(r: np.ndarray, output: np.ndarray, bias: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Log probabilities of column word[i] in row[i] of r @ output + bias."""
    logits = r @ output
    logits += bias
    own = logits[row, word].astype(float)
    with np.errstate(over="ignore"):
        np.exp(logits, out=logits)
        sums = (logits @ np.ones(logits.shape[1], np.float32)).astype(float)
    if not (np.isfinite(sums) & (sums > 0)).all():  # scores too far from 0 for their powers
        logits = r @ output + bias
        most = logits.max(1, keepdims=True)
        sums = np.exp(logits - most).sum(1, dtype=float)
        return own - most[row, 0] - np.log(sums)[row]
    return own - np.log(sums)[row]


def encode(b, vocab: Vocabulary):
    """(words, counts and ids of all tokens, rows, contexts): each row's words and, behind them, the end token.  A context is
    both ids before a token in one number, (nearest * n + next) for n - 1 tokens; n - 1 stands for what is before the text."""
    w = Words(b, NOT_SPACE, lower=True)
    start = w.first[:-1] + np.arange(len(b))
    total, end = len(w) + len(b), w.first[1:] + np.arange(len(b))
    inner = np.ones(total, bool)
    inner[end] = False
    h = np.full(total, END, np.uint64)
    h[inner] = w.hash
    count, ids = vocab.look_up(h)
    before = len(vocab.unigram)
    near = np.empty(total, np.int64)
    near[1:] = ids[:-1]
    near[start] = before
    far = np.empty(total, np.int64)
    far[1:] = near[:-1]
    far[start] = before
    return h, count, ids, np.repeat(np.arange(len(b)), w.counts + 1), near * (before + 1) + far


def _step(at: np.ndarray, rows: np.ndarray, rate: float, *parameters: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds gradients, summed by target row, to (parameter, squares); columns go to the parameters in turn."""
    order = np.argsort(at.astype(np.uint16), kind="stable") if len(parameters[0][0]) <= 65_536 else np.argsort(at)
    at = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sums, own, k = np.add.reduceat(rows.take(order, axis=0), first, axis=0), at.take(first), 0
    for x, squares in parameters:
        g = sums[:, k : k + x.shape[1]] if x.ndim == 2 else sums[:, k]
        k += g.shape[1] if x.ndim == 2 else 1
        s = squares.take(own, axis=0)
        s += g * g
        squares[own] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= np.float32(rate)
        s += x.take(own, axis=0)
        x[own] = s


def train(model: Model, tokens: np.ndarray, unigram: np.ndarray, rng, rate: float) -> None:
    """One pass of noise-contrastive steps in place, over the words' units and over the words of each class in it.  A token is
    context * (number of tokens) + word in one number.

    Equal tokens are one with a weight, and equal contexts meet their noise words once; a context that occurs more often
    than OFTEN is dealt into several groups, so that it takes part in several steps."""
    if not len(tokens):
        return
    n = model.tokens
    tokens, weight = np.unique(tokens, return_counts=True)
    contexts, words = np.divmod(tokens, n)
    new = np.concatenate(([True], contexts[1:] != contexts[:-1]))
    keys, which = contexts[new], np.cumsum(new) - 1
    times = np.add.reduceat(weight, np.flatnonzero(new))
    parts = -(-times // OFTEN)
    first = np.cumsum(parts) - parts
    # a weight is spread evenly over the groups of its context, from one drawn at random on
    share = np.minimum(parts[which], weight)
    of = np.repeat(np.arange(len(words)), share)
    number = np.arange(len(of)) - np.repeat(np.cumsum(share) - share, share)
    spread = weight[of] // share[of] + (number < weight[of] % share[of])
    group = first[which[of]] + (number + (rng.random(len(words)) * parts[which]).astype(np.int64)[of]) % parts[which[of]]
    used = np.zeros(int(parts.sum()), bool)
    used[group] = True
    place = rng.permutation(int(used.sum()))  # groups in random order
    of_group = np.empty(len(place), np.int64)
    of_group[place] = np.repeat(keys, parts)[used]
    group = place[(np.cumsum(used) - 1)[group]]
    order = np.argsort(group, kind="stable")
    mass = unigram + 0.5
    totals = [mass[model.members(k)].sum() for k in range(n_classes(n))]
    bounds = [0]
    while bounds[-1] < len(of_group):
        bounds.append(bounds[-1] + int(np.clip((model.met + bounds[-1]) // BATCH_SHARE, FIRST_BATCH, MINIBATCH)))
    model.met += len(of_group)
    _contrast(model, bounds, of_group, group[order], model.unit(words)[of[order]], spread[order], model.units, np.concatenate((mass[:HEAD], totals)), NOISE, rng, rate)
    for k, at, place in model.by_class(words):
        mixed = rng.permutation(len(at))
        at, place = at[mixed], place[mixed]
        bounds = [*range(0, len(at), CLASS_BATCH), len(at)]
        _contrast(model, bounds, contexts[at], np.arange(len(at)), place, weight[at], np.arange(n)[model.members(k)], mass[model.members(k)], CLASS_NOISE, rng, rate)


def _contrast(model: Model, minibatches: list[int], keys: np.ndarray, group: np.ndarray, words: np.ndarray, weight: np.ndarray, rows: np.ndarray, mass: np.ndarray, k: int, rng, rate: float) -> None:
    """Steps over groups of one context (`keys`: both ids in one number), dealt into minibatches at these bounds.  Token i is of group[i] (sorted)
    and occurs weight[i] times; words are places in `rows` of output; k noise words are drawn from rows by mass.

    With k noise words for each word, the model's unnormalised score s(w) stands for log p(w) and the classifier's log odds
    are s(w) - log(k * noise(w)); noise words are shared by a minibatch.
    """
    noise = mass / mass.sum()
    cumulative = np.cumsum(noise)
    log_noise = np.log(k * noise).astype(np.float32)
    embed_s, output_s, scale_s, bias_s = model.squares
    places = np.searchsorted(group, minibatches).tolist()
    for lo, hi, i, j in zip(minibatches[:-1], minibatches[1:], places[:-1], places[1:], strict=True):
        own = keys[lo:hi]
        g, w, n = group[i:j] - lo, words[i:j], weight[i:j].astype(np.float32)
        a, b = np.divmod(own, len(model.embed))
        ea, eb = model.embed.take(a, axis=0), model.embed.take(b, axis=0)
        r = model.scale[0] * ea + model.scale[1] * eb
        drawn = np.minimum(np.searchsorted(cumulative, rng.random(k)), len(noise) - 1)
        at, other = rows.take(w), rows.take(drawn)
        q, qn = model.output.take(at, axis=0), model.output.take(other, axis=0)
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        n /= n.sum()
        near = r.take(g, axis=0)
        # sigmoids by half the hyperbolic tangent of half
        up = np.einsum("ij,ij->i", near, q)
        up += model.bias.take(at) - log_noise.take(w)
        up = n * (0.5 - 0.5 * np.tanh(0.5 * up))  # weight * (1 - sigmoid): how much to raise
        half = np.float32(0.5)
        down = r @ (half * qn).T
        down += half * (model.bias.take(other) - log_noise.take(drawn))
        np.tanh(down, out=down)
        down += 1
        down *= (half * np.add.reduceat(n, start))[:, None]
        q *= up[:, None]
        gr = np.add.reduceat(q, start, axis=0)
        gr -= down @ qn
        near *= up[:, None]
        d = r.shape[1]
        gradient = np.empty((len(at) + k, d + 1), np.float32)
        gradient[: len(at), :d], gradient[: len(at), d] = near, up
        np.matmul(-down.T, r, out=gradient[len(at) :, :d])
        gradient[len(at) :, d] = -down.sum(0)
        _step(np.concatenate((at, other)), gradient, rate, (model.output, output_s), (model.bias, bias_s))
        scale = np.stack((np.einsum("ij,ij->j", gr, ea), np.einsum("ij,ij->j", gr, eb)))
        _step(np.concatenate((a, b)), np.concatenate((gr * model.scale[0], gr * model.scale[1])), rate, (model.embed, embed_s))
        scale_s += scale * scale
        model.scale += rate * scale / np.sqrt(scale_s)


def _save(uri: str, model: Model, vocab: Vocabulary) -> None:
    import pickle

    put(uri, [pickle.dumps((model, vocab))])


_held: dict[str, tuple[Model, Vocabulary]] = {}


def _load(uri: str) -> tuple[Model, Vocabulary]:
    if uri not in _held:
        import pickle

        system, path = filesystem(uri)
        with system.open_input_stream(path) as f:
            got = pickle.loads(f.readall())
        _held.clear()
        _held[uri] = got
    return _held[uri]


PARTS = "part long, near long, rows binary, weight binary, values binary"


def _part(part: int, near: int, rows: np.ndarray, weight: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([x], pa.int64()) for x in (part, near)]
    cols += [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), weight.astype(np.float32), values.astype(np.float32))]
    return pa.RecordBatch.from_arrays(cols, names=["part", "near", "rows", "weight", "values"])


def _changes(start: np.ndarray, own: np.ndarray, seen: int):
    """Rows of a task's parameters that it has changed, ROWS neighbours in one; `near` tells groups of NEIGHBOURS tasks."""
    near = TaskContext.get().partitionId() // NEIGHBOURS
    changed = np.flatnonzero((start != own).any(1))
    bounds = np.searchsorted(changed, np.arange(0, len(own) + ROWS, ROWS))
    for part, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if i < j:
            yield _part(part, near, changed[i:j], np.full(j - i, seen), own[changed[i:j]])


def _averages(batches):
    """Weighted means of each row over the tasks that have changed it; the weights add up, so means may be averaged again."""
    sums: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part, near, *parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            rows, weight = np.frombuffer(parts[0], np.int32), np.frombuffer(parts[1], np.float32).astype(float)
            values = np.frombuffer(parts[2], np.float32).reshape(len(rows), -1) * weight[:, None]
            had = sums.setdefault(part, (near, np.zeros(ROWS), np.zeros((ROWS, values.shape[1]))))
            had[1][rows - part * ROWS] += weight
            had[2][rows - part * ROWS] += values
    for part, (near, weight, values) in sums.items():
        own = np.flatnonzero(weight)
        yield _part(part, near, own + part * ROWS, weight[own], values[own] / weight[own, None])


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[str, DataFrame]:
    """(URI of the model and vocabulary, table of all word counts) learned from all of docs."""
    spark = docs.sparkSession
    counts = stash(word_counts(docs, text), "word_counts")
    vocab = vocabulary(counts)
    model, uri = Model.start(vocab.unigram), fresh(spark, "language_model")
    src = docs.select(F.col(text).cast("string").alias("text"))
    for k in range(rounds):
        _save(f"{uri}/{k}", model, vocab)

        def run(batches, at=f"{uri}/{k}", k=k):
            start, voc = _load(at)
            own = start.copy()
            held, seen, rng = [], 0, np.random.default_rng(k)
            for batch in batches:
                for b in blocks(batch.column(0), 4 << 20):
                    _, _, ids, _, contexts = encode(b, voc)
                    held.append(contexts * own.tokens + ids)
                    seen += len(ids)
                    if sum(map(len, held)) >= TOKENS:
                        train(own, np.concatenate(held), voc.unigram, rng, RATE / (1 + k))
                        held = []
            if held:
                train(own, np.concatenate(held), voc.unigram, rng, RATE / (1 + k))
            if seen:
                yield from _changes(start.table(), own.table(), seen)

        # a text's round is told by its hash, so ROUNDS rounds train on every token once
        parts = src.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k % ROUNDS).mapInArrow(run, PARTS)
        for keys in (("part", "near"), ("part",)):  # of neighbouring tasks first, so that no part meets all tasks at once
            parts = parts.repartition(*keys).mapInArrow(_averages, PARTS)
        # a partition may hold several `near` of one part after the first step, which are one mean then
        mean = parts.select("rows", "values").toPandas()
        if len(mean):
            t = model.table()
            for rows, values in zip(mean["rows"], mean["values"], strict=True):
                at = np.frombuffer(rows, np.int32)
                t[at] = np.frombuffer(values, np.float32).reshape(len(at), -1)
            model = Model.of_table(t, model)
    _save(f"{uri}/{rounds}", model, vocab)
    return f"{uri}/{rounds}", counts


def score(docs: DataFrame, model: str, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability) of every row."""
    c = F.col
    no_clash(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    src = docs.select(*keep, c(text).cast("string").alias("__text"))
    fields = src.schema.fields[:-1]
    ten = np.log(10)

    def run(batches):
        own, vocab = _load(model)
        floor = vocab.tokens + 0.5 * (vocab.distinct + 1)
        task = uuid.uuid4().int >> 65
        number = 0
        for batch in batches:
            for b in blocks(batch.column(len(fields)), 4 << 20):
                n = len(b)
                h, count, ids, row, contexts = encode(b, vocab)
                logs = own.log_probability(contexts, ids)
                seen, rare = count >= 0, ids == 0
                share = np.log(np.maximum(count, 0) + 0.5)
                base = np.where(seen, share - np.log(floor), -np.log(floor))
                # of words that are not among the known ones, log(count + 0.5) follows from the join
                mine = logs + np.where(rare, np.where(seen, share, 0) - np.log(vocab.rare), 0)
                add = lambda v, row=row, n=n: np.bincount(row, weights=v, minlength=n)
                at = np.flatnonzero(~seen)
                key = np.lexsort((h[at], row[at]))
                at = at[key]
                new = np.flatnonzero(np.concatenate(([True], (h[at][1:] != h[at][:-1]) | (row[at][1:] != row[at][:-1])))) if len(at) else at
                times = np.diff(np.append(new, len(at)))
                offs = pa.array(np.searchsorted(row[at[new]], np.arange(n + 1)).astype(np.int32))
                cols = [batch.column(i).slice(b.rows.start, n) for i in range(len(fields))]
                cols += [pa.array(np.arange(number, number + n)), pa.array(np.full(n, task)), pa.array(np.bincount(row, minlength=n)), pa.array(add(seen & (count > 0)).astype(np.int64))]
                cols += [pa.array(add(base)), pa.array(add(mine))]
                cols += [pa.ListArray.from_arrays(offs, pa.array(h[at[new]].view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(times.astype(np.int64)))]
                number += n
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + ["__row", "__task", "n_tokens", "n_known", "base_score", "score", "__h", "__n"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema += ["__row long, __task long, n_tokens long, n_known long, base_score double, score double, __h array<long>, __n array<long>"]
    rows = stash(src.mapInArrow(run, ", ".join(schema)), "scored")
    words = rows.select("__task", "__row", F.explode(F.arrays_zip("__h", "__n")).alias("x")).select("__task", "__row", c("x.__h").alias("h"), c("x.__n").alias("n"))
    _, vocab = _load(model)
    # every word that is not joined is unknown: its count is 0 and log(0.5) is its share
    found = words.join(counts, "h").groupBy("__task", "__row").agg(F.sum("n").alias("found"), F.sum(c("n") * (F.log(c("c") + 0.5) - F.lit(float(np.log(0.5))))).alias("gain"))
    missing = F.aggregate("__n", F.lit(0).cast("long"), lambda a, x: a + x) * F.lit(float(np.log(0.5)))
    out = rows.join(found, ["__task", "__row"], "left").withColumn("more", missing + F.coalesce("gain", F.lit(0.0)))
    return out.select(
        *keep, "n_tokens", (c("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(vocab.tokens)).cast("long").alias("train_tokens"),
        ((c("base_score") + c("more")) / ten).alias("base_score"), ((c("score") + c("more")) / ten).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 1, F.lit(False))


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, counts = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, counts).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
