"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Documents with equal shingle sets are one class; only classes are joined.  A class's signature has COORDINATES values: for
   each coordinate the smallest of its shingles' hashes under a hash of that coordinate.  Two sets agree at a coordinate with
   a chance of their Jaccard similarity.
2. Posting.  A class is posted under each coordinate-value pair, a 64-bit key.  Keys of one class alone are dropped, and so are
   classes with fewer keys left than `matches` asks for.
3. Prefix.  A pair with `matches` keys in common has one of them within the first s - matches + 1 of the s shared keys of
   each, where all keys are in one order, rarest first.  Only these are joined on, so a passage that many documents share
   is joined on only by documents that consist of it for the most part.
4. Merging.  The classes of a list are gathered as in `ngram_join`: first under the smallest class each can reach, then, for
   lists that still hold several components, all members in tasks of bounded size.  A task merges the short lists of each
   class and skips what lies before it and what is connected with it already; the long lists are probed only for the
   classes that the short ones name.  Pairs with `matches` collisions are verified on the whole sets.

`matches` is the largest number that a pair at the threshold falls short of with a chance below MISS (1e-8): 31 of 64
coordinates at 0.8.  A link is lost only if that happens, and a component only if it happens to all links that hold it together.
What is linked is exact, up to two different shingles of a pair having one 64-bit hash.

Lower-casing is A-Z only and words are `[^\\x20\\x09-\\x0D]+`.  With fewer words than `size`, the sequence is one shingle; null,
empty and blank texts have none and link with nothing.  Null doc_ids take part and are never the smallest; a group of them
alone has no component_id and they are all kept.  Repeated doc_ids are judged row by row.  Texts of any length are taken
whole; an empty table gives an empty result.  Extra columns are not looked at; columns of `keep` that bear the name
of a result are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, mix
from .columns import no_clash
from .ngram_join import RESULTS, Threshold, class_ids, class_labels, class_sets, components_sql, in_groups, shingles
from .scratch import stash

COORDINATES = 64
MISS = 1e-8
#: Classes that a task remembers, so as not to give one's signature twice.
SEEN_CLASSES = 1_000_000


def matches_at(num: int, den: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that may be asked of a pair at the threshold, so that it is missed with a chance of `miss` at most."""
    p, below = num / den, 0.0
    for t in range(coordinates):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def signatures(row: np.ndarray, h: np.ndarray, n: int, coordinates: int = COORDINATES) -> np.ndarray:
    """(n, coordinates) keys of the rows' sets; rows are sorted, and those without shingles get zeros."""
    out = np.zeros((n, coordinates), np.uint64)
    full, start = np.unique(row, return_index=True)
    if not len(full):
        return out.view(np.int64)
    odd = mix(np.arange(1, coordinates + 1).astype(np.uint64)) | np.uint64(1)
    for j in range(coordinates):
        # the shingles' hashes are mixed, so a product with an odd number is a permutation of its own
        out[full, j] = np.minimum.reduceat(h * odd[j], start)
    # a coordinate's values are told from another's by its number
    out[full] = mix(out[full] ^ mix(odd))
    return out.view(np.int64)


def measured(docs: DataFrame, size: int, coordinates: int, text: str, doc_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, class, keys (the class's signature; null where the task has given it before) and `keep` of every row."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    fields, most = src.schema.fields[2:], SEEN_CLASSES

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for b in blocks(batch.column(1)):
                n = len(b)
                row, h = shingles(b, size)
                cid, count = class_ids(row, h, n), np.bincount(row, minlength=n)
                new = np.zeros(n, bool)
                if len(seen) > most:
                    seen.clear()
                for i, x in enumerate(cid.tolist()):
                    if count[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                own, at = new[row], np.cumsum(new) - 1
                keys = signatures(at[row[own]], h[own], int(new.sum()), coordinates)
                ends = np.concatenate(([0], np.cumsum(new) * coordinates)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~new))
                columns = [batch.column(0).slice(b.rows.start, n), pa.array(count), pa.array(cid), lists]
                columns += [batch.column(2 + i).slice(b.rows.start, n) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "class", "keys", *(f.name for f in fields)])

    schema = ["doc_id long, n long, class long, keys array<long>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)]
    return src.mapInArrow(run, ", ".join(schema))


def prefix_lists(signed: DataFrame, matches: int) -> DataFrame:
    """block (a coordinate-value pair), class, low (its smallest class): the posting lists that pairs with `matches` collisions meet
    in, from signed (class, keys)."""
    c = F.col
    posted = signed.select("class", F.explode("keys").alias("key"))
    # counts are added up before the shuffle; where a list is long, adaptive execution may split the join
    lengths = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    shared = posted.join(lengths, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("own"))  # `coordinates` at most
    prefix = shared.where(F.size("own") >= matches).select("class", F.explode(F.slice("own", F.lit(1), F.size("own") - matches + 1)).alias("it"))
    prefix = stash(prefix.select("class", c("it.key").alias("block")), "minhash_prefix")
    met = prefix.groupBy("block").agg(F.min("class").alias("low"), F.max("class").alias("__high")).where("low < __high").select("block", "low")
    return prefix.join(met, "block").select("block", "class", "low")


def colliding(coordinates: int, matches: int):
    """Pairs of a task's sets with `matches` collisions, by merging posting lists."""

    def pairs(sets: list[np.ndarray], threshold: Threshold, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys = signatures(row, np.concatenate(sets), len(sets), coordinates)
        size = np.array([len(s) for s in sets])
        # every key is the number of its list; a class's keys, rarest first
        number, length = np.unique(keys, return_inverse=True, return_counts=True)[1:]
        number = number.reshape(keys.shape)
        order = np.argsort(length[number] * np.int64(len(length)) + number, axis=1)
        ranked = np.take_along_axis(number, order, axis=1)
        several = length[ranked] > 1
        place = np.cumsum(several, axis=1)  # 1 for the first key that is shared, ...
        short = several & (place <= (several.sum(axis=1) - matches + 1)[:, None])
        member, column = np.nonzero(short)
        lists = ranked[member, column]
        by_list = np.lexsort((member, lists))
        lists, member = lists[by_list], member[by_list]
        first, last = np.searchsorted(lists, np.arange(len(length))), np.searchsorted(lists, np.arange(len(length)), side="right")
        for x in range(len(sets)):
            own = ranked[x][short[x]]
            # members before x have met x already
            ahead = [member[i + np.searchsorted(member[i:j], x, side="right") : j] for i, j in zip(first[own].tolist(), last[own].tolist(), strict=True)]
            others = np.unique(np.concatenate(ahead)) if ahead else member[:0]
            others = others[root[others] != root[x]]
            others = others[(threshold.den * size[others] >= threshold.num * size[x]) & (threshold.den * size[x] >= threshold.num * size[others])]
            others = others[(number[others] == number[x]).sum(axis=1) >= matches]
            if len(others):
                yield np.full(len(others), x), others

    return pairs


def minhash_join(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, coordinates: int = COORDINATES, miss: float = MISS, text: str = "text", doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_shingles, class_id (equal sets), group_id (linked classes), component_id (smallest doc_id reachable by
    links), kept (whether that is the row's own doc_id) and `keep` of every row."""
    no_clash(keep, *RESULTS, "keys", "kept")
    threshold, matches = Threshold(num, den), matches_at(num, den, coordinates, miss)
    rows = stash(measured(docs, size, coordinates, text, doc_id, keep), "minhash_rows")
    signed = rows.where("keys is not null").select("class", "keys").dropDuplicates(["class"])
    shared = stash(prefix_lists(signed, matches), "minhash_lists")
    sets = stash(class_sets(docs, shared.select("class").distinct(), size, text), "minhash_sets")
    labels = class_labels(shared, sets, threshold, colliding(coordinates, matches))
    found = in_groups(rows, labels, keep)
    return found.select("doc_id", "n_shingles", "class_id", "group_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *keep)


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


OP12_SQL = components_sql(4, 80, ", doc_id IS NOT DISTINCT FROM component_id AS kept")
