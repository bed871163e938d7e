"""Stages bucketed by a key: tables that are joined or grouped by it again and again are shuffled once, when they are written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.relational import broadcast_join
from shelfscope.session import read_bytes, scratch_path
from shelfscope.sources.writers import materialize

# A bucket holds about this much of what the first table reads, unless a number of buckets is given.
BUCKET_BYTES = 256 << 20
# A key with more rows than this in one table does not go to a bucket: one task reads a bucket whole.
HOT_ROWS = 5_000_000
# Joins that keep the rows of their left side where they are.
JOINS = ("inner", "left", "left_semi", "left_anti")


@dataclass(frozen=True)
class KeyedStage:
    """A table in two parts: ``even`` in buckets of its keys, ``hot`` with the rows of frequent and of null keys.

    A key is in one part only, the same of all tables of a :class:`KeySpace`. So both parts are joined and grouped by
    themselves: the even ones without an exchange, the hot ones shuffled, where skewed partitions are split.
    """

    even: DataFrame
    hot: DataFrame
    keys: tuple[str, ...]
    space: str

    def join(self, other: KeyedStage, also: Sequence[str] = (), how: str = "inner") -> KeyedStage:
        """Join by the keys and ``also`` further columns of both sides; nulls meet nothing.

        In the buckets all rows of a key meet before further columns are compared, so one side should have few rows a key.
        """
        if how not in JOINS:
            raise ValueError(f"{how} moves rows between the parts; use one of {', '.join(JOINS)}")
        if self.space != other.space:
            raise ValueError("both sides must be staged by the same key space")
        on = [*self.keys, *also]
        even = _join_in_buckets(self.even, other.even, self.keys, also, how)
        return KeyedStage(even, self.hot.join(other.hot, on, how), self.keys, self.space)

    def map(self, step: Callable[[DataFrame], DataFrame]) -> KeyedStage:
        """Apply ``step`` to both parts: a projection, a filter, or groups and windows that include all keys."""
        return KeyedStage(step(self.even), step(self.hot), self.keys, self.space)

    def rows(self) -> DataFrame:
        return self.even.unionByName(self.hot)


def _join_in_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], also: Sequence[str], how: str) -> DataFrame:
    """A join whose only equalities are the bucketed keys: any further one would make Spark shuffle by all of them."""
    if not also:
        return left.join(right, list(keys), how)
    other = {c: f"__{c}" for c in [*keys, *also]}
    same = [F.col(k) == F.col(other[k]) for k in keys] + [F.col(c).between(F.col(other[c]), F.col(other[c])) for c in also]
    return left.join(right.withColumnsRenamed(other), reduce(lambda a, b: a & b, same), how).drop(*other.values())


@dataclass(frozen=True)
class KeySpace:
    """How keys are dealt: the number of buckets, and the written table of the hot ones."""

    keys: tuple[str, ...]
    buckets: int
    hot_keys: DataFrame
    name: str

    def stage(self, df: DataFrame) -> KeyedStage:
        """Write a table by its keys. Its key columns must have the names of the space; they get its types.

        The table is read once for each part: one that is expensive to compute should be written before.
        """
        types = {f.name: f.dataType for f in self.hot_keys.schema.fields}
        typed = df.withColumns({k: F.col(k).cast(types[k]) for k in self.keys})
        known = broadcast_join(typed, self.hot_keys.withColumn("__hot", F.lit(True)), self.keys, "left")
        apart = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys], F.col("__hot").isNotNull())
        part = lambda rule: known.filter(rule).select(*[F.col(f"`{c}`") for c in df.columns])
        hot = materialize(part(apart), scratch_path(df.sparkSession, "hot"))
        # The same hash deals rows to tasks and to buckets, so each bucket is one file.
        dealt = part(~apart).repartition(self.buckets, *self.keys)
        table = f"keyed_{uuid.uuid4().hex}"
        writer = dealt.write.format("parquet").bucketBy(self.buckets, *self.keys)
        writer.option("path", scratch_path(df.sparkSession, "even")).saveAsTable(table)
        return KeyedStage(df.sparkSession.table(table), hot, self.keys, self.name)


def key_space(
    tables: Sequence[DataFrame], keys: Sequence[str], buckets: int | None = None, hot_rows: int = HOT_ROWS
) -> KeySpace:
    """Deal the keys of ``tables``, which are then staged one by one.

    Keys with more than ``hot_rows`` rows in any of the tables are counted out first; there are at most as many as the
    rows of a table hold ``hot_rows``. Without a number of buckets, what the first table reads decides: ``BUCKET_BYTES``
    each, at least one for each shuffle partition of the session (also where sizes are unknown), at most what Spark allows.
    """
    spark = tables[0].sparkSession
    if buckets is None:
        wanted = -(-(read_bytes(tables[0]) or 0) // BUCKET_BYTES)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
        buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    many = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select(*keys) for df in tables]
    found = reduce(DataFrame.unionByName, many).na.drop().distinct()
    return KeySpace(tuple(keys), buckets, materialize(found, scratch_path(spark, "hot-keys")), uuid.uuid4().hex)
