"""Relational helpers that add something to the plain DataFrame methods."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.fingerprints import count_and_distinct
from shelfscope.session import input_bytes

# A side is broadcast only when everything it reads is at most this large.
BROADCAST_BYTES = 32 << 20


def project_without_prefix(df: DataFrame, prefix: str = "__") -> DataFrame:
    """Drop every column whose name starts with ``prefix``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefix)])


def filter_by_list(df: DataFrame, column: str, values: DataFrame, value_column: str) -> DataFrame:
    """Keep rows whose ``column`` occurs in another table. The list is never collected; nulls match nothing."""
    wanted = values.select(F.col(value_column).alias("__value")).distinct()
    return df.join(wanted, df[column] == wanted["__value"], "left_semi")


def drop_groups_with(df: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Drop every row of a group that has at least one ``bad`` row. Groups with a null key are kept."""
    return df.join(df.filter(bad).select(*keys).distinct(), list(keys), "left_anti")


def broadcast_join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with the small side broadcast, after a look at its size; a larger one is left to the planner."""
    size = input_bytes(small)
    if size is not None and size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return df.join(small, list(keys), how)


def _units(df: DataFrame, column: str) -> Column:
    """A whole number that does not fall as the value grows: the day of dates and times, also of ISO texts, else the integer part."""
    kind = df.schema[column].dataType.typeName()
    day = kind in ("date", "timestamp", "timestamp_ntz", "string")
    return F.unix_date(F.col(column).cast("date")).cast("bigint") if day else F.floor(column).cast("bigint")


def join_within_range(
    df: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int = 32
) -> DataFrame:
    """Rows joined with the periods of the same ``keys`` that contain ``at``; both ends of a period belong to it.

    A period is cut into buckets of ``bucket`` days (or whole units, for numbers), and rows meet the periods of their own
    bucket only. So a key with many periods costs the pairs that share a bucket, not all of them. Periods are clipped to
    the time that ``df`` covers first: an open end has no more buckets than there are rows for. Null ends contain nothing.
    Both sides are shuffled: the planner's estimate leaves out that a period becomes many rows, so it would broadcast them.
    """
    slot = lambda frame, column: F.floor(_units(frame, column) / bucket)
    covered = df.agg(F.min(slot(df, at)).alias("first"), F.max(slot(df, at)).alias("last"))
    first, last = covered.select("first").scalar(), covered.select("last").scalar()
    span = periods.withColumns({"__first": F.greatest(slot(periods, start), first), "__last": F.least(slot(periods, end), last)})
    # greatest and least pass over nulls.
    known = span.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("__first") <= F.col("__last")))
    cut = known.withColumn("__bucket", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    joined = df.withColumn("__bucket", slot(df, at)).join(cut.hint("merge"), [*keys, "__bucket"])
    return joined.filter(F.col(at).between(F.col(start), F.col(end))).drop("__bucket")


def explode_join(df: DataFrame, array: str, lookup: DataFrame, lookup_key: str, element: str) -> DataFrame:
    """Join each element of an array column with a lookup table; rows with a null or empty array drop out."""
    exploded = df.withColumn(element, F.explode(array))
    return exploded.join(lookup, exploded[element] == lookup[lookup_key])


def star_join(fact: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """Join a fact with (dimension, fact key, dimension key) triples one after the other."""
    return reduce(lambda out, d: out.join(d[0], out[d[1]] == d[0][d[2]], how), dimensions, fact)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values of each column in one row; a null counts as one value.

    Every column is counted by itself: a scan reads each once, tasks merge equal values before the shuffle, and no row
    is multiplied by the number of columns. Of an expensive ``df`` a written stage should be passed.
    """
    counts = [df.select(F.col(f"`{c}`")).distinct().agg(F.count(F.lit(1))).scalar().alias(f"n_{c}") for c in columns]
    return df.sparkSession.range(1).select(*counts)


def join_audit(left: DataFrame, joined_with: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What an inner join does to the row count of ``left``, without building the joined rows.

    One row: rows before, rows that find a partner, rows after, rows lost. Both sides are counted per key first,
    so a key that fans out is multiplied and not materialised.
    """
    ours = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__left"))
    theirs = joined_with.groupBy(*keys).agg(F.count(F.lit(1)).alias("__right"))
    both = ours.join(theirs, list(keys), "left")
    found = F.when(F.col("__right").isNotNull(), F.col("__left")).otherwise(0)
    after = F.col("__left") * F.coalesce(F.col("__right"), F.lit(0))
    summed = both.agg(
        F.coalesce(F.sum("__left"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(found), F.lit(0)).alias("rows_matched"),
        F.coalesce(F.sum(after), F.lit(0)).alias("rows_after"),
    )
    return summed.withColumn("rows_lost", F.col("rows_before") - F.col("rows_matched"))


def column_report(df: DataFrame) -> DataFrame:
    """One row per column: its type, the rows of the table and how many of them are null. One scan."""
    counts = [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"__n{i}") for i, f in enumerate(df.schema.fields)]
    one_row = df.agg(F.count(F.lit(1)).alias("__rows"), *counts)
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.col("__rows").alias("n_rows"),
            F.col(f"__n{i}").alias("n_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one_row.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of nulls of each column, in one row."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in columns or df.columns])


def duplicate_impact(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with and without exact duplicates and the difference as a percentage of all rows, in one row."""
    report = count_and_distinct(df, list(columns or df.columns))
    percent = F.try_divide((F.col("n_rows") - F.col("n_distinct")).cast("double"), F.col("n_rows").cast("double"))
    return report.select("n_rows", "n_distinct", (percent * 100).alias("duplicate_percent"))


def with_rules(df: DataFrame, rules: dict[str, Column] | Sequence[Column]) -> DataFrame:
    """Keep rows that satisfy every rule. A dict names the rules so that callers can share and extend them."""
    conditions = list(rules.values()) if isinstance(rules, dict) else list(rules)
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns; text that is not a value of the type becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def aggregate_having(df: DataFrame, keys: Sequence[str], sums: dict[str, str], keep: Callable[[], Column]) -> DataFrame:
    """Sum columns per group and keep the groups that satisfy a condition on the sums."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(a) for a, c in sums.items()]).filter(keep())

