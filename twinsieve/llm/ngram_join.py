"""N-gram Jaccard self-join by signature trees, exact, with one row per document as the result.

1. Documents with equal shingle sets are one class; only classes are joined.
2. Blocks.  Sizes fall into intervals [l, l / threshold].  Two sets of an interval that reach the threshold differ in
   at most d shingles, so of d + 1 parts of the shingles (dealt by hash) one part at least is equal in both: its hash is
   a key.  A class gives the keys of its interval and of the next, so no pair is lost at a border.  A passage, line or
   word that many documents share makes no key by itself.
3. Tiles.  Blocks (keys with the same members are one block) are gathered under their smallest member, first each class
   under the smallest it can reach, then, for blocks that still hold several components, all members.  A tile above
   TILE_CLASSES or TILE_SHINGLES is dealt into tasks; the members outside a tile's largest component meet all others.
4. Trees.  In a task, a signature tree holds the sets: nodes have the OR of their members' token bitmaps and the range of
   their sizes.  Two trees are descended together, and a pair of nodes is dropped if the largest overlap it can have is
   below what the threshold asks.  Pairs of leaves are verified on the sets, unless they are already connected.
5. Links found make components; a class is never compared within its own component, so a group of thousands of copies
   costs about one comparison a member.

Lower-casing is A-Z only and words are `[^\\x20\\x09-\\x0D]+`.  With fewer words than `size`, the sequence is one
shingle; null, empty and blank texts have none and link with nothing (component_id is their own doc_id).  Sets are of
64-bit hashes: two different shingles of a pair are taken for one with a chance of 2**-64.  Null doc_ids take part and
are never the smallest; repeated doc_ids are judged row by row; texts of any length are compared whole, and an empty table
gives an empty result.  Extra columns are not looked at; those of `keep` that bear the name of a result are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .arrays import NOT_SPACE, Block, Words, blocks, mix, windows
from .columns import no_clash
from .components import components
from .scratch import stash

TILE_CLASSES, TILE_SHINGLES = 1_000, 4_000_000
FAN_OUT = 8
#: Rows of one key that a task holds; of a longer run the members stream by.
RUN_ROWS = 1_000_000
#: Classes that a task remembers, so as not to send one twice; more are forgotten, and met again below.
SEEN_CLASSES = 1_000_000
BITMAP_WORDS = 16
#: Parts beyond what the threshold asks for: so many more keys two linked sets have in common at least, which tells them
#: from sets that share a passage.
SPARE, SPARE_SHARE = 4, 16
#: Bits of the filter that keeps sets without a partner off the network: 8 MB, whatever the corpus.
FILTER_BUCKETS, BUCKET_BITS = 2_048, 32_768
#: Names that a kept column must not have, for results and on the way to them.
RESULTS = ("doc_id", "text", "n", "n_shingles", "class", "class_id", "group_id", "component_id", "need0", "need1", "label")


class Threshold:
    """J >= num / den in integers, and the size intervals that belong to it.

    Interval i holds sizes from low[i]; two sets of it differ in at most differ[i] shingles.  parts[i] is larger by spare[i]
    + 1, so that spare[i] + 1 parts at least are equal in both.
    """

    def __init__(self, num: int = 90, den: int = 100, largest: int = 1 << 40):
        self.num, self.den = num, den
        lo, self.low, self.differ, self.spare = 1, [], [], []
        while lo <= largest:
            hi = max(lo, lo * den // num)
            d = 2 * hi * (den - num) // (den + num)
            smallest, m = self.low[-1] if self.low else lo, 0
            for _ in range(2):  # parts that are empty in the smallest set that gives keys for this interval, and some more
                empty = (d + 1 + m) * np.exp(-smallest / (d + 1 + m))
                m = int(np.ceil(empty + 2 * np.sqrt(empty))) + (SPARE + d // SPARE_SHARE) * (d > 0)
            self.low.append(lo)
            self.differ.append(d)
            self.spare.append(m)
            lo = hi + 1
        self.low, self.differ, self.spare = (np.array(x) for x in (self.low, self.differ, self.spare))
        self.parts = self.differ + 1 + self.spare

    def overlap(self, total):
        """The least intersection of two sets with `total` shingles together."""
        return -(-total * self.num // (self.num + self.den))


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted."""
    w = Words(block, NOT_SPACE, lower=True)
    row, h = [], []
    for n in range(1, size + 1):
        at, g = windows(w, n)
        if n < size:
            own = w.counts[w.row[at]] == n
            at, g = at[own], g[own]
        row.append(w.row[at])
        h.append(g)
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def _sums(slot: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values modulo 2**64 (exact: the halves of up to 2**21 values fit a double)."""
    lo = np.bincount(slot, weights=(h & np.uint64(0xFFFFFFFF)).astype(float), minlength=n).astype(np.uint64)
    hi = np.bincount(slot, weights=(h >> np.uint64(32)).astype(float), minlength=n).astype(np.uint64)
    return lo + (hi << np.uint64(32))


def class_ids(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each row's set."""
    return mix(_sums(row, mix(h ^ np.uint64(0xA24BAED4963EE407)), n)).view(np.int64)


def keys(row: np.ndarray, h: np.ndarray, n: int, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of all rows' block keys, and how many keys a row has in common with any partner at least: a row for
    keys that are even and one for keys that are odd numbers.  A key's last bit is that of its interval."""
    size = np.bincount(row, minlength=n)
    rows, out, need = [], [], np.ones((2, n), np.int64)
    for ahead in (0, 1):
        i = np.searchsorted(threshold.low, np.maximum(size, 1), side="right") - 1 + ahead
        k = np.where((threshold.differ[i] > 0) & (size > 0), threshold.parts[i], 0)  # no difference: equal sets, which are one class
        first = np.concatenate(([0], np.cumsum(k)))
        own = k[row] > 0
        slot = first[row[own]] + (h[own] % np.maximum(k[row[own]], 1).astype(np.uint64)).astype(np.int64)
        sums = _sums(slot, mix(h[own] + np.uint64(1)), int(first[-1]))
        r = np.repeat(np.arange(n), k)
        number = (np.arange(int(first[-1])) - first[r]).astype(np.uint64)
        key = mix(sums ^ mix(number + (i[r].astype(np.uint64) << np.uint64(40))))
        key = key & ~np.uint64(1) | (i[r] & 1).astype(np.uint64)
        # Empty parts are equal in most sets.  They are keys only of a set with so many of them that the parts it has in
        # common with another may all be empty.
        full = np.bincount(slot, minlength=len(r)) > 0
        empty = k - np.bincount(r[full], minlength=n)
        give = full | (empty > threshold.spare[i])[r]
        need[i & 1, np.arange(n)] = np.maximum(threshold.spare[i] + 1 - empty, 1)
        out.append(key[give])
        rows.append(r[give])
    return np.concatenate(rows), np.concatenate(out).view(np.int64), need


def measured(docs: DataFrame, size: int, threshold: Threshold, text: str, doc_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, class, need0, need1 (see `keys`) and `keep` of every row."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    fields = src.schema.fields[2:]

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                n = len(b)
                row, h = shingles(b, size)
                need = keys(row, h, n, threshold)[2]
                own = [batch.column(0).slice(b.rows.start, n), pa.array(np.bincount(row, minlength=n)), pa.array(class_ids(row, h, n)), pa.array(need[0]), pa.array(need[1])]
                yield pa.RecordBatch.from_arrays(own + [batch.column(2 + i).slice(b.rows.start, n) for i in range(len(fields))], names=["doc_id", "n", "class", "need0", "need1", *(f.name for f in fields)])

    return src.mapInArrow(run, ", ".join(["doc_id long, n long, class long, need0 long, need1 long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)]))


def class_keys(docs: DataFrame, size: int, threshold: Threshold, text: str) -> DataFrame:
    """key, class.  A task gives the keys of a class once, however many copies it meets."""

    most = SEEN_CLASSES

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                n = len(b)
                row, h = shingles(b, size)
                cid = class_ids(row, h, n)
                count = np.bincount(row, minlength=n)
                new = np.zeros(n, bool)
                if len(seen) > most:
                    seen.clear()
                for i, x in enumerate(cid.tolist()):
                    if x not in seen and count[i]:
                        seen.add(x)
                        new[i] = True
                own = new[row]
                r, k, _ = keys(row[own], h[own], n, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cid[r])], names=["key", "class"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, class long")


def _runs(batches, columns: int, limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """The rows of sorted batches of integer columns, in pieces that end where the first column changes, and whether a piece
    is part of a run of one value that is longer than `limit`; such a run comes in several pieces."""
    rest: list[list[np.ndarray]] = []  # pieces of one value
    held, long = 0, False
    join = lambda pieces: [np.concatenate(x) for x in zip(*pieces, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rest and own[0][0] != rest[0][0][0] or long and own[0][0] != last:
            if rest:
                yield long, join(rest)
            rest, held, long = [], 0, False
        if rest or long:  # what goes on with the value before
            cut = int(np.searchsorted(own[0], own[0][0], side="right"))
            rest.append([x[:cut] for x in own])
            held += cut
            if cut < len(own[0]):
                yield long, join(rest)
                rest, held, long = [], 0, False
                own = [x[cut:] for x in own]
            elif held > limit:
                yield True, join(rest)
                rest, held, long, last = [], 0, True, own[0][0]
                continue
            else:
                last = own[0][0]
                continue
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut:
            yield False, [x[:cut] for x in own]
        rest, held, last = [[x[cut:] for x in own]], len(own[0]) - cut, own[0][-1]
    if rest:
        yield long, join(rest)


def shared_blocks(keyed: DataFrame, needs: DataFrame) -> DataFrame:
    """block, class, low: the members of each set of keys (key, class) that has the same members, two at least; low is the
    smallest.  Without the classes that have fewer keys in common with others than a partner would have (`needs`)."""

    limit = RUN_ROWS

    def run(batches):
        names = ["block", "class", "low", "odd"]
        low = last = None  # the smallest class of a long run, which is its first, and the class before
        for long, (key, cid) in _runs(batches, 2, limit):
            if long:  # members stream by; the key names the block, so it is not merged with blocks of the same members
                if low is None or low[0] != key[0]:
                    low, last = (key[0], cid[0]), None
                new = np.concatenate(([last is None or cid[0] != last], cid[1:] != cid[:-1]))
                last, cid = cid[-1], cid[new]
                n = len(cid)
                name = mix(key[:1].view(np.uint64) + np.uint64(11)).view(np.int64)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(cid), pa.array(np.full(n, low[1])), pa.array(np.full(n, key[0] & 1))], names=names)
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
            key, cid = key[new], cid[new]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.diff(np.append(start, len(key)))
            group = np.repeat(np.arange(len(start)), n)
            name = mix(_sums(group, mix(cid.view(np.uint64) + np.uint64(5)), len(start)) + n.astype(np.uint64)).view(np.int64)
            keep = (n > 1)[group]
            group = group[keep]
            yield pa.RecordBatch.from_arrays([pa.array(name[group]), pa.array(cid[keep]), pa.array(cid[start][group]), pa.array(key[keep] & 1)], names=names)

    c = F.col
    rows = keyed.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "block long, class long, low long, odd long")
    # a block's keys are of one interval, as a class has each key once
    counted = stash(rows.groupBy("block", "class", "low", "odd").agg(F.count("*").alias("times")), "ngram_keys")
    often = counted.groupBy("class").agg(*(F.sum(F.when(c("odd") == k, c("times")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    often = often.join(needs, "class").select("class", *((c(f"n{k}") >= c(f"need{k}")).alias(f"ok{k}") for k in (0, 1))).where("ok0 or ok1")
    kept = counted.join(often, "class").where(F.when(c("odd") == 1, c("ok1")).otherwise(c("ok0")))
    # a block that has lost its other members has no pair left; one whose members changed is named by them still
    left = kept.groupBy("block", "odd").agg(F.min("class").alias("low"), F.max("class").alias("__high")).where("low < __high").select("block", "odd", "low")
    return kept.drop("low").join(left, ["block", "odd"]).select("block", "class", "low").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, size: int, text: str) -> DataFrame:
    """class, n, items (sorted 64-bit hashes) of the classes of `wanted` (class)."""
    c = F.col
    bucket = F.pmod(c("class"), F.lit(FILTER_BUCKETS * BUCKET_BITS))
    bits = wanted.groupBy(F.floor(bucket / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(bucket % BUCKET_BITS).alias("bits"))
    table = np.zeros((FILTER_BUCKETS, BUCKET_BITS // 8), np.uint8)
    for r in bits.collect():  # FILTER_BUCKETS rows of 4 KB at most
        table[r["bucket"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    table = table.ravel()
    held, most = docs.sparkSession.sparkContext.broadcast(table), SEEN_CLASSES

    def run(batches):
        filt, seen = held.value, set()
        for batch in batches:
            for b in blocks(batch.column(0)):
                n = len(b)
                row, h = shingles(b, size)
                cid = class_ids(row, h, n)
                at = cid % (FILTER_BUCKETS * BUCKET_BITS)
                maybe = np.flatnonzero((filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                first = np.searchsorted(row, np.arange(n + 1))
                out = []
                if len(seen) > most:
                    seen.clear()
                for i in maybe.tolist():
                    x = int(cid[i])
                    if x not in seen:
                        seen.add(x)
                        out.append((x, int(first[i + 1] - first[i]), h[first[i] : first[i + 1]].tobytes()))
                if out:
                    x, m, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.binary())], names=["class", "n", "items"])

    sets = docs.select(c(text).cast("string").alias("text")).mapInArrow(run, "class long, n long, items binary")
    return sets.join(wanted, "class", "left_semi").dropDuplicates(["class"])


class SignatureTree:
    """Sets in leaves, FAN_OUT children a node; a node knows the OR of bitmaps, size range and how many shingles share bits."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        # near copies have the same smallest hashes as a rule, so they come to lie under one node
        self.order = np.lexsort((size, [int(s[0]) for s in sets]))
        bits = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
        for at, i in enumerate(self.order):
            place = sets[i] % np.uint64(64 * BITMAP_WORDS)
            np.bitwise_or.at(bits[at], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        size = size[self.order]
        surplus = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, surplus)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, s = self.levels[-1]
            start = np.arange(0, len(lo), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(b, start), np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.maximum.reduceat(s, start)))

    def pairs(self, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of leaves whose largest possible overlap reaches the threshold, a piece at a time."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            bits, lo, hi, surplus = self.levels[level]
            # shingles in common lie on bits in common; some bits stand for several shingles
            most = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64) + np.minimum(surplus[a], surplus[b])
            most = np.minimum(most, np.minimum(hi[a], hi[b]))
            keep = (most >= threshold.overlap(lo[a] + lo[b])) & (threshold.num * lo[a] <= threshold.den * hi[b]) & (threshold.num * lo[b] <= threshold.den * hi[a])
            a, b = a[keep], b[keep]
            if not level:
                own = a != b
                if own.any():
                    yield self.order[a[own]], self.order[b[own]]
                continue
            n = len(self.levels[level - 1][1])
            grid = np.arange(FAN_OUT)
            for i in range(0, len(a), 4096):
                x = (a[i : i + 4096, None, None] * FAN_OUT + grid[None, :, None]).repeat(FAN_OUT, 2).ravel()
                y = (b[i : i + 4096, None, None] * FAN_OUT + grid[None, None, :]).repeat(FAN_OUT, 1).ravel()
                ok = (x <= y) & (y < n)
                todo.append((level - 1, x[ok], y[ok]))


def tree_pairs(sets: list[np.ndarray], threshold: Threshold, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that a signature tree over the sets cannot exclude."""
    return SignatureTree(sets).pairs(threshold)


def tile_links(cid: np.ndarray, sets: list[np.ndarray], label: np.ndarray, threshold: Threshold, pairs=tree_pairs) -> list[tuple[int, int]]:
    """Edges (class, smaller class) that span the components of one task's members, beyond what labels connect.  `pairs` gives the
    pairs to verify; it may look at `root`, which is kept up to date, and leave out pairs that are connected already."""
    root = np.unique(label, return_inverse=True)[1].astype(np.int64)
    root = root.copy()
    links: list[tuple[int, int]] = []
    for a, b in pairs(sets, threshold, root):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for i, j in zip(*(x.tolist() for x in (lambda s: (s, np.append(s[1:], len(a))))(np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))))), strict=True):
            x, others = int(a[i]), b[i:j]
            others = others[root[others] != root[x]]
            if not len(others):
                continue
            n = np.array([len(sets[k]) for k in others])
            flat = np.concatenate([sets[k] for k in others])
            at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
            both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(n) - n)
            for y in others[both * (threshold.num + threshold.den) >= threshold.num * (n + len(sets[x]))].tolist():
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    links.append((max(int(cid[x]), int(cid[y])), min(int(cid[x]), int(cid[y]))))
    return links


def _links(tasks: DataFrame, sets: DataFrame, threshold: Threshold, pairs) -> DataFrame:
    """a, b: the edges of all tasks (task, class, label)."""

    def run(batches):
        open_task, cid, label, items = None, [], [], []

        def close():
            first = np.unique(np.array(cid), return_index=True)[1]
            return tile_links(np.array(cid)[first], [np.frombuffer(items[i], np.uint64) for i in first], np.array(label)[first], threshold, pairs)

        out: list[tuple[int, int]] = []
        for batch in batches:
            for task, x, own, item in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if task != open_task:
                    if len(cid) > 1:
                        out += close()
                    open_task, cid, label, items = task, [], [], []
                cid.append(x)
                label.append(own)
                items.append(item)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        if len(cid) > 1:
            out += close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts, dealt = _dealt(tasks)
    rows = dealt.join(sets.select("class", "items"), "class").select("part", "task", "class", "label", "items")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("task").select("task", "class", "label", "items")
    return rows.mapInArrow(run, "a long, b long")


def _dealt(tasks: DataFrame) -> tuple[int, DataFrame]:
    """(partitions, tasks with `part`): tasks are dealt to partitions by size, the largest first, so that no two large ones meet in one
    partition while another has none."""
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = stash(tasks, "ngram_tasks")
    sizes = running(tasks.groupBy("task").agg(F.count("*").alias("rows")), [F.col("rows").desc(), F.col("task").asc()], name="rank")
    return parts, tasks.join(sizes.select("task", F.pmod("rank", F.lit(parts)).cast("int").alias("part")), "task")


def _tasks_for(rows, shingles_):
    return F.greatest(F.ceil(rows / TILE_CLASSES), F.ceil(shingles_ / TILE_SHINGLES), F.lit(1)).cast("long")


def _first_tasks(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each class under the smallest class that it shares a block with; that class is in all tasks of its tile."""
    c = F.col
    best = stash(shared.groupBy("class").agg(F.min("low").alias("tile")).join(sizes, "class"), "ngram_best")
    # a table of its own, so that the join below may be split or broadcast where a tile is large
    parts = stash(best.groupBy("tile").agg(_tasks_for(F.count("*"), F.sum("n")).alias("parts")), "ngram_tiles")
    dealt = best.join(parts, "tile").select("tile", F.pmod(F.xxhash64("class"), "parts").alias("part"), "class")
    heads = parts.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), c("parts") - 1)).alias("part"), c("tile").alias("class"))
    return dealt.unionByName(heads).select(F.xxhash64("tile", "part").alias("task"), "class", c("class").alias("label"))


def _rest_tasks(shared: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the blocks that still hold several components: those outside a tile's largest component meet all."""
    c = F.col
    named = shared.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed = named.groupBy("block").agg(F.min("label").alias("tile"), F.max("label").alias("top")).where("tile < top").select("block", "tile")
    members = stash(named.join(mixed, "block").select("tile", "class", "label").distinct().join(sizes, "class"), "ngram_members")
    each = members.groupBy("tile", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("rows", "label", "shingles"))
    tiles = each.groupBy("tile").agg(largest.alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    tiles = stash(
        tiles.select(
            "tile", c("main.label").alias("main"), _tasks_for(c("rows"), c("shingles")).alias("parts"),
            _tasks_for(c("rows") - c("main.rows"), c("shingles") - c("main.shingles")).alias("splits"),
        ), "ngram_tiles",
    )
    placed, h = members.join(tiles, "tile"), F.xxhash64("class")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), c(k) - 1)
    left = placed.select("tile", F.explode(upto("splits")).alias("i"), F.pmod(h, "parts").alias("j"), "class", "label")
    right = placed.where(c("label") != c("main")).select("tile", F.pmod(h, "splits").alias("i"), F.explode(upto("parts")).alias("j"), "class", "label")
    return left.unionByName(right).select(F.xxhash64("tile", "i", "j").alias("task"), "class", "label")


def class_labels(shared: DataFrame, sets: DataFrame, threshold: Threshold, pairs=tree_pairs) -> DataFrame:
    """node, label: the components (label: their smallest class) of the classes of sets (class, n, items) that links connect, for
    candidates that share a block (block, class, low: its smallest class)."""
    c, sizes = F.col, sets.select("class", "n")
    labels = components(_links(_first_tasks(shared, sizes), sets, threshold, pairs), "ngram_labels")
    more = stash(_rest_tasks(shared, sizes, labels), "ngram_rest")
    if not more.isEmpty():
        more_links = stash(_links(more, sets, threshold, pairs), "ngram_links")
        if not more_links.isEmpty():
            labels = components(more_links.unionByName(labels.select(c("node").alias("a"), c("label").alias("b"))), "ngram_labels")
    return labels


def in_groups(rows: DataFrame, labels: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, n_shingles, class_id, group_id, component_id and `keep` of rows (doc_id, n, class and keep)."""
    c = F.col
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members"))
    groups = named.join(lowest.where("members > 1"), "label").select("class", "label", "component_id")
    out = rows.select("doc_id", c("n").alias("n_shingles"), F.when(c("n") > 0, c("class")).alias("class"), *keep).join(groups, "class", "left")
    return out.select(
        "doc_id", "n_shingles", c("class").alias("class_id"), F.coalesce("label", "class").alias("group_id"), F.coalesce("component_id", "doc_id").alias("component_id"), *keep
    )


def ngram_join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets), group_id (linked classes), component_id (smallest doc_id reachable by
    links) and `keep` of every row; class_id and group_id are null for rows without shingles."""
    no_clash(keep, *RESULTS)
    threshold = Threshold(num, den)
    rows = stash(measured(docs, size, threshold, text, doc_id, keep), "ngram_rows")
    needs = rows.where("n > 0").groupBy("class").agg(F.first("need0").alias("need0"), F.first("need1").alias("need1"))
    shared = stash(shared_blocks(class_keys(docs, size, threshold, text), needs), "ngram_blocks")
    sets = stash(class_sets(docs, shared.select("class").distinct(), size, text), "ngram_sets")
    return in_groups(rows, class_labels(shared, sets, threshold), keep)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def components_sql(size: int, num: int, more: str = "") -> str:
    """Components of documents linked by a share of num / 100 of their distinct `size`-word shingles, all pairs compared."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + least(len(w), {size}) - 1], ' ') AS sh
      FROM (SELECT rid, w, unnest(range(1, len(w) - least(len(w), {size}) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * common >= {num} * (a.n + b.n - common)),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id{more} FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


OP3_SQL = components_sql(3, 90)
