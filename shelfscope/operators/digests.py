"""Where two tables of keys differ, from digests of buckets instead of the keys themselves."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets of the upper level, and parts of each on the lower one.
BUCKETS, PARTS = 1024, 64
# Rows without a key are in no bucket: they equal nothing, so they always count as different.
NO_KEY = -1

_BUCKET, _LEAF, _COUNT = "__bucket", "__leaf", "__count"


def with_leaf(df: DataFrame, key: str) -> DataFrame:
    """Add the bucket of each key and the leaf within it, both from one hash."""
    hashed = F.xxhash64(F.col(key), F.lit("leaf"))
    leaf = F.when(F.col(key).isNull(), NO_KEY).otherwise(F.pmod(hashed, F.lit(BUCKETS * PARTS)))
    return df.withColumn(_LEAF, leaf).withColumn(_BUCKET, F.floor(F.col(_LEAF) / PARTS))


def _digests(df: DataFrame, key: str, level: str) -> DataFrame:
    """Number of rows and the sums of four 32-bit pieces of two hashes, for each bucket or leaf.

    Sums do not depend on the order of rows, grow with repeated keys, and cannot overflow below 2^31 rows a bucket.
    """
    first, second = F.xxhash64(F.col(key)), F.xxhash64(F.lit("second"), F.col(key))
    pieces = [piece for h in (first, second) for piece in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(piece).alias(f"__sum{i}") for i, piece in enumerate(pieces)]
    return df.groupBy(level).agg(F.count(F.lit(1)).alias(_COUNT), *sums)


def _unequal(left: DataFrame, right: DataFrame, key: str, level: str) -> DataFrame:
    ours, theirs = _digests(left, key, level), _digests(right, key, level)
    figures = [c for c in ours.columns if c != level]
    renamed = theirs.select(level, *[F.col(c).alias(f"{c}_other") for c in figures])
    same: Callable[[Column, Column], Column] = lambda a, b: a & b
    equal = reduce(same, [F.col(c).eqNullSafe(F.col(f"{c}_other")) for c in figures])
    return ours.join(renamed, level, "full").filter(~equal).select(level)


def differing_leaves(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Leaves (``__leaf``) whose keys are not the same on both sides, counted with repetition.

    Both sides need the columns of :func:`with_leaf`. Buckets are compared first; only rows of those that differ take
    part in the comparison of leaves. What is shuffled is at most one digest for each bucket or leaf from each task,
    however many keys there are. Digests have 128 bits, so unequal leaves look equal about once in 10^38.
    """
    named = [side.filter(F.col(_LEAF) != NO_KEY) for side in (left, right)]
    # At most BUCKETS rows.
    buckets = F.broadcast(_unequal(*named, key, _BUCKET))
    narrowed = [side.join(buckets, _BUCKET, "left_semi") for side in named]
    without_key = left.sparkSession.range(NO_KEY, NO_KEY + 1).select(F.col("id").alias(_LEAF))
    return _unequal(*narrowed, key, _LEAF).unionByName(without_key)


def split_by_difference(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of leaves that differ, of both sides, and the rows of ``right`` whose leaf is the same on both.

    Every key of the third table occurs on the left, just as often. The leaves are broadcast: there are at most
    BUCKETS * PARTS + 1 of them.
    """
    ours, theirs = with_leaf(left, key), with_leaf(right, key)
    leaves = F.broadcast(differing_leaves(ours, theirs, key))
    changed = [side.join(leaves, _LEAF, "left_semi").drop(_LEAF, _BUCKET) for side in (ours, theirs)]
    return *changed, theirs.join(leaves, _LEAF, "left_anti").drop(_LEAF, _BUCKET)
