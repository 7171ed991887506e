"""Set similarity over a long form (entity, element, weight), for directories or any other sets.

Candidates come from an inverted index of the elements that at most `max_frequency` entities have; overlaps are counted
over all elements, from the smaller entity of each pair.  An element above the cap makes no pairs, which bounds what one
element can add to the join by max_frequency squared; sets that are equal are found by fingerprint in any case.  With
max_frequency=None `set_similarity` finds its candidates by `prefix_join`, which loses nothing at the threshold, and `scored`,
which has no threshold, lets every element make pairs, for work that grows with the square of the most frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stash

THRESHOLD, MAX_FREQUENCY = 0.5, 50
#: Rows of a part that `dealt` makes.
PART = 200_000
#: Rows of the entities whose pairs are counted in one task; below 2**19, as `_pairs_of_block` packs places.
PIECE = 500_000
#: Elements above the cap that are sent to all tasks; more are joined.
FREQUENT = 10_000
#: Increments of pairs that a task sorts at a time.
SORTED = 4_000_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many parts as they need, so that what a task keeps of them does not grow with the input.

    They are counted first, so they should be read from a table."""
    return rows.repartition(rows.count() // PART + 1, *keys)


def inverted_index(elements: DataFrame) -> DataFrame:
    """element, frequency, entity: a row for each entity that has the element."""
    return elements.select("element", "entity").distinct().join(elements.groupBy("element").agg(F.countDistinct("entity").alias("frequency")), "element").select("element", "frequency", "entity")


def inverted_lists(elements: DataFrame) -> DataFrame:
    """element, frequency, entities (sorted): for output, as an element's entities are one row here."""
    return elements.groupBy("element").agg(F.countDistinct("entity").alias("frequency"), F.array_sort(F.collect_set("entity")).alias("entities"))


def frequencies(elements: DataFrame) -> DataFrame:
    return elements.groupBy("element").agg(F.count("*").alias("frequency"))


def capped(elements: DataFrame, max_frequency: int | None = MAX_FREQUENCY) -> DataFrame:
    """Rows of elements that at most `max_frequency` entities have (None: all)."""
    if max_frequency is None:
        return elements
    keep = frequencies(elements).where(F.col("frequency") <= max_frequency).select("element")
    return elements.join(keep, "element", "left_semi")


def _ordered_pairs(rows: DataFrame) -> DataFrame:
    a = rows.select(F.col("entity").alias("entity_a"), "element")
    b = rows.select(F.col("entity").alias("entity_b"), "element")
    return a.join(b, "element").where("entity_a < entity_b")


def candidate_pairs(elements: DataFrame, max_frequency: int | None = MAX_FREQUENCY) -> DataFrame:
    """entity_a < entity_b that share an element under the cap."""
    return _ordered_pairs(capped(elements, max_frequency)).select("entity_a", "entity_b").distinct()


def _sizes(elements: DataFrame) -> DataFrame:
    return elements.groupBy("entity").agg(F.count("*").alias("n"))


def overlaps(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity_a, entity_b, shared, shared_weight of the given pairs that share anything, over all elements.

    The elements of the smaller entity of each pair are looked up in the larger: an entity that has everything and is in
    every pair is never spread out, and the look-up is by (entity, element), which no entity makes hot."""
    c = F.col
    n = _sizes(elements)
    sized = pairs.select("entity_a", "entity_b").join(n.toDF("entity_a", "n_a"), "entity_a").join(n.toDF("entity_b", "n_b"), "entity_b")
    low = c("n_a") <= c("n_b")
    sized = sized.select(F.when(low, c("entity_a")).otherwise(c("entity_b")).alias("small"), F.when(low, c("entity_b")).otherwise(c("entity_a")).alias("large"))
    side = lambda name, k: elements.select(c("entity").alias(name), "element", c("weight").alias(f"weight_{k}"))
    both = sized.join(side("small", 1), "small").join(side("large", 2), ["large", "element"])
    both = both.groupBy("small", "large").agg(F.count("*").alias("shared"), F.sum(F.least("weight_1", "weight_2")).cast("long").alias("shared_weight"))
    return both.select(F.least("small", "large").alias("entity_a"), F.greatest("small", "large").alias("entity_b"), "shared", "shared_weight")


def _blocks(rows: DataFrame) -> tuple[DataFrame, bool, int]:
    """(blocks, whether they are few: at most PART rows, how many rows there are).  blocks: entity, place (how many rows the entities before it have: a number that tells entities apart and keeps their order), parts
    (in how many parts the rows of its block are dealt).  A block is the entities whose places lie in one range of PIECE."""
    c = F.col
    sizes = _sizes(rows)
    count, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = count <= PART
    if few:  # for a window in one task, and to be sent to all
        ahead = F.sum("n").over(W.orderBy("entity").rowsBetween(W.unboundedPreceding, -1))
        placed = sizes.withColumn("place", F.coalesce(ahead, F.lit(0)))
    else:
        from .running import running

        placed = stash(running(sizes, [c("entity").asc()], c("n"), "place"), "places")
    placed = placed.withColumn("block", F.floor(c("place") / PIECE))
    # only the last entity of a block reaches beyond its range
    parts = placed.groupBy("block").agg(F.floor(F.sum("n") / (2 * PIECE) + 1).cast("int").alias("parts"))
    return placed.join(parts, "block").select("entity", "place", "parts"), few, total


def _lists_by_block(piece: int, weighted: bool, most: int):
    """For rows of which those of an element lie in one part: of each element's list, by place, what lies at and behind its first
    entity in a block, for each block that it has an entity of; `own`: how many of these are the block's.  A part is sorted in its
    task; about `most` entries are sent at a time."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        batches = list(batches)
        if not sum(len(b) for b in batches):
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        element, place = t["element"].chunk(0).dictionary_encode().indices.to_numpy(), t["place"].to_numpy()
        order = np.lexsort((place, element))
        element, block, part = element[order], place[order] // piece, t["part"].to_numpy()[order]
        other = element[1:] != element[:-1]
        ends = np.concatenate((np.flatnonzero(other) + 1, [len(element)]))
        at = np.flatnonzero(np.concatenate(([True], other | (block[1:] != block[:-1]))))
        end = ends[np.searchsorted(ends, at, "right")]
        own, long = np.diff(at, append=len(element)), end - at
        at, own, long = at[long > 1], own[long > 1], long[long > 1]
        cuts = np.searchsorted(np.cumsum(long), np.arange(most, long.sum(), most))
        for some in np.split(np.arange(len(at)), cuts):
            n = long[some]
            offsets = np.concatenate(([0], np.cumsum(n)))
            inside = pa.array(order[np.repeat(at[some] - offsets[:-1], n) + np.arange(offsets[-1])])
            lists = {k: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), t[k].chunk(0).take(inside)) for k in ("place", "need", *(["weight"] if weighted else []))}
            yield pa.RecordBatch.from_pydict({"entity_a": block[at[some]] * piece, "part": part[at[some]], "own": own[some].astype("int32"), **lists})

    return run


def _pairs_of_block(weighted: bool, most: int):
    """Counts of the pairs of a block's own entities with those behind them in its lists, without pairs that fall short of what
    their entities need if all lists are here (part 0).  `most` increments are sorted at a time."""
    import numpy as np
    import pyarrow as pa

    no_weight = np.iinfo("int64").max

    def summed(codes, shared, weight):
        order = np.argsort(codes)
        codes = codes[order]
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        known = weight != no_weight
        total = np.add.reduceat(np.where(known, weight, 0)[order], at)
        return codes[at], np.add.reduceat(shared[order], at), np.where(np.logical_or.reduceat(known[order], at), total, no_weight)

    def run(key, t):
        base, part = (k.as_py() for k in key)
        lists = t["place"].combine_chunks()
        start, own = lists.offsets.to_numpy()[:-1].astype("int64"), t["own"].to_numpy().astype("int64")
        end = np.repeat(lists.offsets.to_numpy()[1:].astype("int64"), own)
        place, flat = lists.values.to_numpy(), lambda k: t[k].combine_chunks().values
        if weighted:
            weights = flat("weight").fill_null(no_weight).to_numpy()
        firsts = np.cumsum(own) - own
        heads = np.repeat(start - firsts, own) + np.arange(len(end))
        behind = end - heads - 1
        upto, codes, shared, weight = np.cumsum(behind), np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "int64")
        lo = 0
        while lo < len(heads):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
            n = behind[lo:hi]
            other = np.arange(n.sum()) + np.repeat(heads[lo:hi] + 1 - (np.cumsum(n) - n), n)
            # a place in the block has less than 19 bits, a place in the table less than 44
            found = np.repeat((place[heads[lo:hi]] - base) << 44, n) | place[other]
            if weighted:
                more = np.minimum(np.repeat(weights[heads[lo:hi]], n), weights[other])
                codes, shared, weight = summed(np.concatenate((codes, found)), np.concatenate((shared, np.ones(len(found), "int64"))), np.concatenate((weight, more)))
            else:
                found, count = np.unique(found, return_counts=True)
                if len(codes):
                    both, at = np.unique(np.concatenate((codes, found)), return_inverse=True)
                    count = np.bincount(at, np.concatenate((shared, count))).astype("int64")
                    found = both
                codes, shared = found, count
            lo = hi
        a, b = (codes >> 44) + base, codes & ((1 << 44) - 1)
        if part == 0 and len(codes):
            known, at = np.unique(place, return_index=True)
            need = flat("need").to_numpy()[at].astype("float64")
            need = need[np.searchsorted(known, a)] + need[np.searchsorted(known, b)]
            keep = shared >= need - 1e-6 * np.abs(need) - 0.01
            a, b, shared, weight = a[keep], b[keep], shared[keep], weight[keep] if weighted else weight
        total = pa.array(weight, mask=weight == no_weight) if weighted else shared
        return pa.table({"a": a, "b": b, "shared": shared, "shared_weight": total})

    return run


def _pairs_of_lists(rows: DataFrame, needs: DataFrame | None = None) -> DataFrame:
    """entity_a < entity_b, shared, shared_weight of rows (entity, element, perhaps weight) of which few have one element; the
    counts of a pair may come in several rows.

    Entities are dealt into blocks by ranges of their order, so an element's list is sent once for each block that it has an entity of
    (where neighbours share their elements: once or twice), and the pairs of a block are counted in one task.  The rows of a block that an
    entity of many elements makes large are dealt into several parts.  needs (entity, need): pairs that share less than both their needs
    together may be left out."""
    c, weighted = F.col, "weight" in rows.columns
    blocks, few, total = _blocks(rows)
    send = F.broadcast if few else lambda df: df
    known = blocks.withColumn("need", F.lit(0.0).cast("float")) if needs is None else blocks.join(needs.select("entity", c("need").cast("float")), "entity")
    part = F.when(c("parts") > 1, F.pmod(F.xxhash64("element"), c("parts")) + 1).otherwise(0).cast("int").alias("part")
    weight = [c("weight").cast("long")] if weighted else []
    known = send(known) if few else stash(known, "blocks")  # as a table its size is known before it is joined
    lists = rows.join(known, "entity").select("element", "place", "need", part, *weight).repartition(total // PART + 1, "element")
    kind = "entity_a long, part int, own int, place array<long>, need array<float>" + (", weight array<long>" if weighted else "")
    lists = lists.mapInArrow(_lists_by_block(PIECE, weighted, SORTED // 4), kind)
    pairs = lists.repartition("entity_a", "part").groupBy("entity_a", "part").applyInArrow(_pairs_of_block(weighted, SORTED), "a long, b long, shared long, shared_weight long")
    name = lambda k: send(blocks.select(c("place").alias(k), c("entity").alias(f"entity_{k}")))
    return pairs.join(name("a"), "a").join(name("b"), "b").select("entity_a", "entity_b", "shared", "shared_weight")


def candidate_overlaps(elements: DataFrame, max_frequency: int | None = MAX_FREQUENCY, least: float = 0.0) -> DataFrame:
    """`overlaps` of `candidate_pairs`, from one join: elements under the cap are counted where they make the pairs, and only
    elements above it are looked up for the pairs found, if both their entities have one.  Pairs whose Jaccard similarity is below
    `least` may be left out.  elements without a weight weigh 1 each."""
    c = F.col
    if max_frequency is None:
        elements = elements if "weight" in elements.columns else elements.withColumn("weight", F.lit(1).cast("long"))
        side = lambda k: elements.select(F.col("entity").alias(f"entity_{k}"), "element", F.col("weight").alias(f"weight_{k}"))
        sums = [F.count("*").alias("shared"), F.sum(F.least("weight_a", "weight_b")).cast("long").alias("shared_weight")]
        return side("a").join(side("b"), "element").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(*sums)
    rows = elements.where("entity is not null and element is not null")
    hot = frequencies(elements).where((c("frequency") > max_frequency) & c("element").isNotNull()).select("element")
    some = hot.limit(FREQUENT + 1).collect()
    if len(some) <= FREQUENT:
        hot = F.broadcast(elements.sparkSession.createDataFrame(some, hot.schema))
    sums = [F.sum(x).cast("long").alias(x) for x in ("shared", "shared_weight")]
    # shared / (n_a + n_b - shared) >= least only if shared >= least / (1 + least) * (n_a + n_b)
    share = least / (1 + least)
    needs = _sizes(elements).select("entity", (F.lit(share) * c("n")).alias("need")) if least > 0 else None
    if not some:
        return _pairs_of_lists(rows, needs).groupBy("entity_a", "entity_b").agg(*sums)
    noisy = stash(rows.join(hot, "element", "left_semi"), "frequent_elements")
    rows = rows.join(hot, "element", "left_anti")
    if needs is not None:  # two entities share no more frequent elements than half of what both have
        loud = noisy.groupBy("entity").agg(F.count("*").alias("loud"))
        needs = needs.join(loud, "entity", "left").select("entity", (c("need") - F.coalesce(c("loud"), F.lit(0)) / 2).alias("need"))
    low = stash(_pairs_of_lists(rows, needs), "pair_counts")
    loud = noisy.select("entity").distinct()
    asked = low.select("entity_a", "entity_b")
    for k in "ab":
        asked = asked.join(loud.withColumnRenamed("entity", f"entity_{k}"), f"entity_{k}", "left_semi")
    noisy = noisy if "weight" in noisy.columns else noisy.withColumn("weight", F.lit(1).cast("long"))
    both = low.unionByName(overlaps(noisy, asked.distinct()))
    return both.groupBy("entity_a", "entity_b").agg(*sums)


def scored(elements: DataFrame, pairs: DataFrame | None = None, max_frequency: int | None = MAX_FREQUENCY, least: float = 0.0) -> DataFrame:
    """entity_a, entity_b, n_a, n_b, shared, shared_weight, score (Jaccard), match_type of the candidates under the cap, or of
    given pairs.  Candidates with a score below `least` may be left out."""
    n = _sizes(elements)
    both = candidate_overlaps(elements, max_frequency, least) if pairs is None else overlaps(elements, pairs)
    sized = both.join(n.select(F.col("entity").alias("entity_a"), F.col("n").alias("n_a")), "entity_a")
    sized = sized.join(n.select(F.col("entity").alias("entity_b"), F.col("n").alias("n_b")), "entity_b")
    both, a, b = F.col("shared"), F.col("n_a"), F.col("n_b")
    kind = F.when((both == a) & (both == b), "exact").when(both == F.least(a, b), "subset").otherwise("threshold")
    return sized.select("entity_a", "entity_b", "n_a", "n_b", "shared", "shared_weight", (both / (a + b - both)).alias("score"), kind.alias("match_type"))


def set_prints(elements: DataFrame) -> DataFrame:
    """entity, n, print: equal for equal sets.  Sums of the two halves of each element's md5 and the count, combined before
    the shuffle, so a set of any size needs a few numbers; two different sets agree with a chance of about 2**-120.
    elements are read twice (`dealt`)."""
    h = F.md5(F.col("element").cast("string"))
    total = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = dealt(elements.select("entity", "element"), "entity", "element").distinct().groupBy("entity").agg(F.count("*").alias("n"), total(1).alias("__a"), total(16).alias("__b"))
    return sums.select("entity", "n", F.md5(F.concat_ws("|", F.col("n"), F.col("__a"), F.col("__b"))).alias("print"))


def equal_classes(elements: DataFrame) -> DataFrame:
    """entity, representative (the smallest entity with an equal set), members: all entities whose set another one has."""
    prints = set_prints(elements)
    classes = prints.groupBy("print").agg(F.min("entity").alias("representative"), F.count("*").alias("members")).where("members > 1")
    return prints.join(classes, "print").select("entity", "representative", "members")


def equal_sets(elements: DataFrame, all_pairs: bool = False) -> DataFrame:
    """entity_a < entity_b with equal sets, by fingerprint: whatever the cap and the threshold.  Each class gives the pairs of
    its smallest entity with the others; with all_pairs, all its pairs (the square of its size)."""
    if all_pairs:
        return _ordered_pairs(set_prints(elements).select("entity", F.col("print").alias("element"))).select("entity_a", "entity_b")
    return equal_classes(elements).where("entity <> representative").select(F.col("representative").alias("entity_a"), F.col("entity").alias("entity_b"))


def _nested(a, b):
    inside = lambda x, y: y.startswith(F.when(x == "/", x).otherwise(F.concat(x, F.lit("/"))))
    return inside(a, b) | inside(b, a)


def set_similarity(elements: DataFrame, threshold: float = THRESHOLD, max_frequency: int | None = MAX_FREQUENCY, exclude_nested: bool = False, shared_as_total: bool = False, all_pairs: bool = False) -> DataFrame:
    """entity_a, entity_b, score, shared, shared_weight, match_type: pairs at the threshold, and beyond the cap each entity of
    a class of equal sets with the smallest of it (all_pairs: with each other).

    exclude_nested: without pairs of which one path lies in the other.  shared_as_total: pairs found by fingerprint alone
    carry the weight of all of entity_a's elements as given, not one weight for each element; for sets in long form
    these are the same.
    """
    if max_frequency is None:
        from .prefix_join import candidates

        found = scored(elements, candidates(elements, threshold))
    else:
        found = scored(elements, max_frequency=max_frequency, least=threshold)
    found = found.where(F.col("score") >= threshold)
    rest = equal_sets(elements, all_pairs).join(found.select("entity_a", "entity_b"), ["entity_a", "entity_b"], "left_anti")
    total = elements.groupBy(F.col("entity").alias("entity_a")).agg(F.count("*").alias("shared"), F.sum("weight").cast("long").alias("shared_weight"))
    same = rest.join(total, "entity_a").select("entity_a", "entity_b", F.lit(1.0).alias("score"), "shared", "shared_weight", F.lit("exact").alias("match_type"))
    out = found.select("entity_a", "entity_b", "score", "shared", "shared_weight", "match_type").unionByName(same)
    return out.where(~_nested(F.col("entity_a"), F.col("entity_b"))) if exclude_nested else out


def similar_pairs(pairs: DataFrame, min_score: float = 0.0, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Pairs at a score, best first, then by paths; a page of them."""
    out = pairs.where(F.col("score") >= min_score).orderBy(F.desc("score"), "entity_a", "entity_b").offset(offset)
    return out if limit is None else out.limit(limit)


def counts_by_type(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("match_type").agg(F.count("*").alias("pairs"))


def without_nested_pairs(pairs: DataFrame, strict_prefix: bool = True) -> DataFrame:
    """Pairs of which no directory lies in (or, unless strict, begins with the text of) a directory of another pair.

    Strict: the ancestors of each side are looked up among the pairs' directories by an equi-join.  Not strict: plain
    text prefixes without regard to case, equal directories included; the prefixes of each side are looked up likewise.
    """
    a, b = F.col("entity_a"), F.col("entity_b")
    sides = pairs.select("entity_a", "entity_b", F.explode(F.array(a, b)).alias("side"))
    if strict_prefix:
        from .tree import ancestors

        keys = F.filter(ancestors(F.col("side")), lambda x: x != F.col("side"))
    else:
        keys = F.transform(F.sequence(F.lit(1), F.length("side")), lambda i: F.lower(F.substring(F.col("side"), F.lit(1), i)))
    probe = sides.select("entity_a", "entity_b", F.explode(keys).alias("key"))
    key = F.col("side") if strict_prefix else F.lower("side")
    holders = sides.select(key.alias("key"), F.col("entity_a").alias("other_a"), F.col("entity_b").alias("other_b"))
    # one holder that is another pair is enough: the smallest and the largest pair of a key tell
    holders = holders.groupBy("key").agg(F.min(F.struct("other_a", "other_b")).alias("low"), F.max(F.struct("other_a", "other_b")).alias("high"))
    own = F.struct(F.col("entity_a").alias("other_a"), F.col("entity_b").alias("other_b"))
    hit = probe.join(holders, "key").where((F.col("low") != own) | (F.col("high") != own)).select("entity_a", "entity_b").distinct()
    return pairs.join(hit, ["entity_a", "entity_b"], "left_anti")


def directory_diff(files: DataFrame, left: str, right: str) -> DataFrame:
    """side (left, right), canonical_path, content_hash, status (matched, left_only, right_only) of the files directly in
    two directories; a null hash never matches."""
    out = None
    for side, own, other in (("left", left, right), ("right", right, left)):
        mine, theirs = files.where(F.col("parent_dir") == own), files.where(F.col("parent_dir") == other)
        hashes = theirs.where("content_hash is not null").select(F.col("content_hash").alias("__h")).distinct()
        rows = mine.join(hashes, F.col("content_hash") == F.col("__h"), "left")
        status = F.when(F.col("__h").isNotNull(), "matched").otherwise(f"{side}_only")
        rows = rows.select(F.lit(side).alias("side"), "canonical_path", "content_hash", status.alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


def diff_summary(diff: DataFrame) -> DataFrame:
    """matched_left, left_only, right_only, percent = 200 * matched_left / all rows (0 for empty directories)."""
    n = lambda s, side: F.count(F.when((F.col("status") == s) & (F.col("side") == side), 1))
    out = diff.agg(n("matched", "left").alias("matched_left"), n("left_only", "left").alias("left_only"), n("right_only", "right").alias("right_only"), F.count("*").alias("total"))
    percent = F.coalesce(200.0 * F.col("matched_left") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return out.select("matched_left", "left_only", "right_only", percent.alias("percent"))
