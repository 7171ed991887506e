"""Exact set-similarity self-join by prefix filtering, without a cap on how frequent an element may be.

Elements stand in one order, rare ones first.  Two sets of sizes n <= m with Jaccard similarity t or more have an element in
common among the first n - ceil(2t / (1 + t) n) + 1 of the smaller and the first m - ceil(t m) + 1 of the larger set, so only these are
joined on; a frequent element is a key only of sets that have few rarer ones.  Three more filters keep the join small:
sizes that cannot reach t never meet (sizes fall into intervals [l, l / t), and a key holds the interval), the places of a
common element bound what can be in common, and sets that are equal are one class, of which the smallest entity alone
takes part.  Keys of sets of up to SMALL elements carry the hashes of the whole set, so two such sets are compared where they
meet, and only pairs that can reach the threshold are ever written.  What is left is verified on the whole sets.

The place of an element in a large set is found in two levels, so that no set is gathered in one task: counts by (entity,
band of the order), running sums over the bands of an entity (at most BANDS for each power of two of frequencies), then places inside one
band.  The order inside a power of two is that of a hash, so bands are even however many elements have one frequency.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stash
from .similarity import equal_classes, frequencies, scored

#: Bands of hashes for each power of two of frequencies.
BANDS = 4_096
#: Sets of up to so many elements are carried along with their keys.
SMALL = 32
#: What rounding may do to a product of a size and a threshold.
SLACK = 1e-9


def ordered(elements: DataFrame) -> DataFrame:
    """entity, element, n (size of the entity's set), place (1, 2, ... in the common order, rare elements first) of every row of
    elements (entity, element: distinct)."""
    c = F.col
    power = F.floor(F.log2("frequency")).cast("int")
    h = F.xxhash64(c("element").cast("string"))
    order = frequencies(elements).select("element", power.alias("power"), h.alias("h"), F.pmod(h, F.lit(BANDS)).cast("int").alias("band"))
    rows = elements.select("entity", "element").join(order, "element")
    counted = rows.groupBy("entity", "power", "band").agg(F.count("*").alias("rows"))
    bands = W.partitionBy("entity").orderBy("power", "band")
    before = F.coalesce(F.sum("rows").over(bands.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("entity", "power", "band", before.alias("before"), F.sum("rows").over(W.partitionBy("entity")).alias("n"))
    inside = F.row_number().over(W.partitionBy("entity", "power", "band").orderBy("h", c("element").cast("string")))
    placed = rows.withColumn("inside", inside).join(counted, ["entity", "power", "band"])
    return placed.select("entity", "element", "n", (c("before") + c("inside")).alias("place"))


def _interval(n: Column, threshold: float) -> Column:
    """Sizes whose ratio is at least the threshold lie in one interval or in two neighbours."""
    if threshold == 1:
        return n
    return F.floor(F.log(n) / F.lit(-math.log(threshold)) + SLACK).cast("long")


def prefixes(elements: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(keys of the sets as the smaller of a pair, keys as the larger): interval, element, entity, n, place, hashes (of the
    whole set, sorted; null for a set above SMALL), spare (how many elements share a hash with another of the set)."""
    c = F.col
    placed = stash(ordered(elements), "set_places")
    own = F.collect_list(F.struct("place", "element", F.hash(c("element").cast("string")).alias("hash")))
    small = placed.where(c("n") <= SMALL).groupBy("entity", "n").agg(own.alias("own"))
    hashes = F.array_sort(F.array_distinct(c("own.hash")))
    small = small.select("entity", "n", hashes.alias("hashes"), F.explode("own").alias("it")).select("it.element", "entity", "n", "it.place", "hashes", (c("n") - F.size("hashes")).cast("int").alias("spare"))
    placed = small.unionByName(placed.where(c("n") > SMALL), allowMissingColumns=True)
    least = lambda share: F.ceil(F.lit(share) * c("n") - SLACK)
    names = ("element", "entity", "n", "place", "hashes", "spare")
    interval = _interval(c("n"), threshold)
    # an exact match of sizes at a threshold of 1 has the interval of its size; else the larger may be in the next one
    ahead = F.array(interval) if threshold == 1 else F.array(interval, interval + 1)
    smaller = placed.where(c("place") <= c("n") - least(2 * threshold / (1 + threshold)) + 1).select(F.explode(ahead).alias("interval"), *names)
    larger = placed.where(c("place") <= c("n") - least(threshold) + 1).select(interval.alias("interval"), *names)
    return smaller, larger


def candidates(elements: DataFrame, threshold: float) -> DataFrame:
    """entity_a < entity_b: every pair of different sets at the threshold, and others."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    c = F.col
    smaller, larger = prefixes(elements, threshold)
    x = smaller.select("interval", "element", *(c(k).alias(f"{k}_x") for k in ("entity", "n", "place", "hashes", "spare")))
    y = larger.select("interval", "element", *(c(k).alias(f"{k}_y") for k in ("entity", "n", "place", "hashes")))
    # each pair in one direction: by size, then by name
    one_way = (c("n_x") < c("n_y")) | ((c("n_x") == c("n_y")) & (c("entity_x") < c("entity_y")))
    # the first element that they have in common passes: what is in common lies at and behind it
    most = 1 + F.least(c("n_x") - c("place_x"), c("n_y") - c("place_y"))
    needed = F.lit(threshold / (1 + threshold)) * (c("n_x") + c("n_y")) - SLACK
    # equal hashes of different elements never take a pair away: what they may hide is `spare`
    alike = c("hashes_x").isNull() | c("hashes_y").isNull() | (F.size(F.array_intersect("hashes_x", "hashes_y")) + c("spare_x") >= needed)
    met = x.join(y, ["interval", "element"]).where(one_way & (most >= needed) & (c("n_x") >= F.lit(threshold) * c("n_y") - SLACK) & alike)
    low, high = F.least("entity_x", "entity_y").alias("entity_a"), F.greatest("entity_x", "entity_y").alias("entity_b")
    return met.select(low, high).distinct()


def representatives(elements: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the smallest entity of each class of equal sets."""
    others = classes.where("entity <> representative").select("entity")
    return elements.join(others, "entity", "left_anti")


def exact_similarity(elements: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes).  pairs: `similarity.scored` of all pairs at the threshold between entities of different sets, of equal sets the
    smallest entity.  classes: entity, representative, members of the entities whose set another one has.

    elements (entity, element, weight) are distinct by entity and element.  Null entities and elements make no pairs."""
    elements = stash(elements.where("entity is not null and element is not null"), "set_elements")
    classes = stash(equal_classes(elements), "set_classes")
    own = stash(representatives(elements, classes), "set_representatives")
    found = stash(candidates(own, threshold), "set_candidates")
    return scored(own, found).where(F.col("score") >= threshold), classes


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """entity_a < entity_b, score for all entities, from `exact_similarity`: as many rows as there are pairs, also inside a class."""
    c = F.col
    members = classes.select(c("representative"), c("entity").alias("member"))
    side = lambda df, k: df.join(members.toDF(f"entity_{k}", f"member_{k}"), f"entity_{k}", "left").withColumn(f"entity_{k}", F.coalesce(f"member_{k}", f"entity_{k}")).drop(f"member_{k}")
    both = side(side(pairs.select("entity_a", "entity_b", "score"), "a"), "b")
    inside = members.toDF("r", "entity_a").join(members.toDF("r", "entity_b"), "r").where("entity_a < entity_b").select("entity_a", "entity_b", F.lit(1.0).alias("score"))
    both = both.select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b"), "score")
    return both.unionByName(inside)
