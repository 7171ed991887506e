"""Codes of 64 bits, such as perceptual hashes, that differ in at most r bits: an exact join without comparing all pairs.

Cut into r + 1 bands, two codes that differ in at most r bits agree in one band at least, so equal bands are the keys of an equi-join and
`bit_count` verifies.  Equal codes are one row.  A band value that more than `most` codes have is a hot key: its codes must
agree in one of r + 1 bands of the other bits as well, so they are dealt again by two bands together, then by three,
until no key is hot or MOST_LEVELS is reached (fewer where the masks of a level would be more than MOST_MASKS).  No pair is lost
by that.  Where bands are so narrow that dealing again would repeat a code more than it parts the others (WORTH), as at radius 11,
no key is dealt again.  Codes under a key that is hot at the last level are compared in tiles of two blocks of
at most BLOCK codes or so, each tile in one task and a few rows of it at a time, so memory has a bound; the comparisons grow with the
square of the codes under the key, and tasks with them.

Null codes and ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash

BITS, MOST, MOST_LEVELS, MOST_MASKS = 64, 1_000, 3, 5_000
#: Codes of a block of a hot key, and how many times fewer comparisons another level must promise.
BLOCK, WORTH = 8_192, 8


def sign_codes(vectors: Column, planes: list[list[float]]) -> Column:
    """A code of the signs of a vector's projections on up to 64 planes, the first in the highest bit.  A null vector gives null."""
    dot = lambda p: F.aggregate(F.zip_with(vectors, F.array(*map(F.lit, p)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    bits = [F.when(dot([float(v) for v in p]) > 0, "1").otherwise("0") for p in planes]
    bits += [F.lit("0")] * (BITS - len(bits))
    return F.when(vectors.isNotNull(), F.conv(F.concat(*bits), 2, -10).cast("long"))


def planes(n: int, dimensions: int) -> list[list[int]]:
    """Fixed whole-numbered planes, by a rule."""
    return [[(i * 7919 + j * 104_729 + i * j * 31 + (i + 3) * (j + 5) * (i + j) * 17) % 193 - 96 for i in range(dimensions)] for j in range(n)]


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of a list of bit numbers cut into parts of about equal size."""
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(ends, ends[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _deeper(mask: int, radius: int) -> list[int]:
    """The mask with one more band each, of the bits that it leaves."""
    return [mask | m for m in _cut([b for b in range(BITS) if not mask >> b & 1], radius + 1) if m]


def _keyed(codes: DataFrame, masks: list[int]) -> DataFrame:
    """mask, value, code: a row for each mask."""
    return codes.select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), "code").select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")


def _dealt_again(masks: list[int], radius: int) -> bool:
    """Whether another band parts codes by much more than the number of bands that they are repeated for."""
    free = BITS - max(m.bit_count() for m in masks)
    return len(masks) * (radius + 1) <= MOST_MASKS and 2 ** (free // (radius + 1)) >= WORTH * (radius + 1)


def _cool_and_hot(codes: DataFrame, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(mask, value, code of keys of at most `most` codes; mask, value, code, n of the others at the last level)."""
    masks = _cut(list(range(BITS)), radius + 1)
    rows, done = stash(_keyed(codes, masks), "hamming_keys"), None
    for level in range(MOST_LEVELS):
        counted = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        kept = rows.join(counted, ["mask", "value"])
        cool = kept.where(F.col("n") <= most).select("mask", "value", "code")
        done = cool if done is None else done.unionByName(cool)
        hot = kept.where(F.col("n") > most)
        if level == MOST_LEVELS - 1 or not _dealt_again(masks, radius):
            return done, hot
        if hot.isEmpty():
            return done, hot
        # each mask goes on to its own deeper masks
        next_masks = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(d)) for d in _deeper(m, radius))))))
        deeper = hot.select(F.explode(next_masks[F.col("mask")]).alias("mask"), "code").select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")
        rows = stash(deeper.distinct(), "hamming_keys")
        masks = sorted({d for m in masks for d in _deeper(m, radius)})
    raise AssertionError


def keys(codes: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """mask, value, code: rows of which two codes within the radius have a (mask, value) in common; the codes are distinct."""
    cool, hot = _cool_and_hot(codes, radius, most)
    return cool.unionByName(hot.select("mask", "value", "code"))


def _tile_pairs(radius: int):
    """Compares the codes of a tile; sent to the executors by value."""

    def compare(tile):
        import numpy as np
        import pandas as pd

        own = tile["code"].to_numpy()[tile["second"].to_numpy() == 0]
        other = tile["code"].to_numpy()[tile["second"].to_numpy() == 1]
        inside = len(other) == 0
        other = own if inside else other
        found = []
        step = max(1, 1_000_000 // max(1, len(other)))
        for at in range(0, len(own), step):
            x = own[at : at + step]
            distance = np.bitwise_count((x[:, None] ^ other[None, :]).view(np.uint64))
            i, j = np.nonzero(distance <= radius)
            a, b = x[i], other[j]
            keep = a < b if inside else a != b
            found.append(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep], distance[i, j][keep].astype(np.int64)]))
        a, b, n = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return pd.DataFrame({"code_a": a, "code_b": b, "distance": n.astype(np.int32)})

    return compare


def _compared_in_tiles(hot: DataFrame, radius: int) -> DataFrame:
    """code_a < code_b, distance of the codes of each (mask, value) within the radius, from rows (mask, value, code, n)."""
    c = F.col
    blocks = F.ceil(c("n") / BLOCK).cast("int")
    at = F.pmod(F.xxhash64("code"), blocks).cast("int")
    rows = hot.select("mask", "value", "code", blocks.alias("blocks"), at.alias("at"))
    # block k is first in the tiles (k, k) to (k, last), second in those before
    tile = lambda k: F.struct(F.least(c("at"), k).alias("x"), F.greatest(c("at"), k).alias("y"), F.when(k < c("at"), 1).otherwise(0).alias("second"))
    dealt = rows.select("mask", "value", "code", F.explode(F.transform(F.sequence(F.lit(0), c("blocks") - 1), tile)).alias("t"))
    return dealt.select("mask", "value", "code", "t.*").groupBy("mask", "value", "x", "y").applyInPandas(_tile_pairs(radius), "code_a long, code_b long, distance int")


def near_codes(rows: DataFrame, radius: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(code_a < code_b, distance: every pair of different codes within the radius; code, id: the rows (id, code) of each code)."""
    if not 0 <= radius < BITS:
        raise ValueError("a radius is at least 0 and below 64")
    members = stash(rows.where("id is not null and code is not null").select("code", "id").distinct(), "hamming_members")
    cool, hot = _cool_and_hot(members.select("code").distinct(), radius, most)
    a, b = (cool.withColumnRenamed("code", f"code_{k}") for k in "ab")
    distance = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))).cast("int")
    met = a.join(b, ["mask", "value"]).where((F.col("code_a") < F.col("code_b")) & (distance <= radius))
    return met.select("code_a", "code_b", distance.alias("distance")).unionByName(_compared_in_tiles(hot, radius)).distinct(), members
