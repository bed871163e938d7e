"""Ad inventory and all-time totals over two platforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.relational import aggregate_having
from shelfscope.sources.readers import between_days
from shelfscope.sources.writers import replace_partitions


def inventory_by(log: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Opportunities and their offered places per group."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_requests"), F.sum(amount).alias("total_places"))


def store_daily(log: DataFrame, path: str, day: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Daily partial figures of a log in a dataset by day: rows and sums per group. Days in ``log`` are replaced.

    A period is then summed from a few rows per day and group, and a late delivery re-runs its own day only.
    """
    partial = log.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
    return replace_partitions(partial, path, [day])


def period_from_daily(daily: DataFrame, day: str, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Figures of the days from ``start`` to ``end``, both included, from the daily ones."""
    figures = [c for c in daily.columns if c == "n_rows" or c.startswith("sum_")]
    return between_days(daily, day, start, end).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in figures])


def live_campaigns(campaigns: DataFrame, min_budget: float = 1.0, draft: str = "DRAFT") -> DataFrame:
    """Campaigns with all fields known, a budget above the minimum and a status other than draft."""
    return campaigns.dropna().filter((F.col("budget") > min_budget) & (F.col("status") != draft))


def active_entities(activity: DataFrame, keys: Sequence[str], units: str) -> DataFrame:
    """Entities whose units add up to more than zero."""
    return aggregate_having(activity, keys, {"total_units": units}, lambda: F.col("total_units") > 0)


def without_migrated(campaigns: DataFrame, migrated: DataFrame, key: str) -> DataFrame:
    """Campaigns of one platform that did not come over from the other."""
    return campaigns.join(migrated.select(key).distinct(), key, "left_anti")


def cross_platform_total(
    first: DataFrame, second: DataFrame, migrated: DataFrame | None = None, key: str | None = None, earlier: int = 0
) -> DataFrame:
    """One row: rows of both platforms, what migrated rows would count twice, and the all-time total.

    ``earlier`` is a total reported up to a cut-off, on top of which both logs are counted. With ``migrated`` the
    second platform leaves out the ids that the first one has already.
    """
    own = second if migrated is None else without_migrated(second, migrated, key)
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
        for part, frame in (("first", first), ("all_second", second), ("second", own))
    ]
    total = counts[0].unionByName(counts[1]).unionByName(counts[2])
    pick = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))
    row = total.agg(
        pick("first").alias("first_platform"),
        pick("second").alias("second_platform"),
        (pick("all_second") - pick("second")).alias("migrated_rows"),
    )
    return row.withColumn("all_time", F.col("first_platform") + F.col("second_platform") + F.lit(earlier))
