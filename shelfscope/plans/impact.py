"""Impact bounds where sensitivity is partly unknown, and reconciliation of two catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.columns import ratio
from shelfscope.operators.digests import split_by_difference

# The sensitivity classes and the texts for a name that one catalogue lacks.
NOT_SENSITIVE, SENSITIVE, UNCLEAR = "0", "1", "UNKNOWN"
MATCHED = "MATCHED"
MISSING_LEFT = "UNKNOWN - missing left"
MISSING_RIGHT = "UNKNOWN - missing right"


def classify_impact(
    amounts: DataFrame, catalogue: DataFrame, sensitive: DataFrame, unclear: Sequence[str], name: str, amount: str
) -> DataFrame:
    """Sensitivity of each name and the least and greatest impact of its amount.

    In this order: known to the catalogue and not listed -> '0', even if unclear; unknown to the catalogue and not
    unclear -> '0', even if listed; unclear -> 'UNKNOWN'; otherwise what the list says. The least impact takes UNKNOWN
    as zero, the greatest as the whole amount. A name listed twice gives two rows, as a plain join does.
    """
    known = catalogue.select(F.col(name)).distinct().withColumn("__known", F.lit(True))
    listed = sensitive.select(F.col(name)).withColumn("__listed", F.lit(SENSITIVE))
    joined = amounts.join(known, name, "left").join(listed, name, "left")
    is_unclear = F.coalesce(F.col(name).isin(list(unclear)), F.lit(False))
    unlisted, is_known = F.col("__listed").isNull(), F.col("__known").isNotNull()
    level = (
        F.when(is_known & unlisted, NOT_SENSITIVE)
        .when(~is_known & ~is_unclear & F.col(name).isNotNull(), NOT_SENSITIVE)
        .when(is_unclear, UNCLEAR)
        .otherwise(F.col("__listed"))
    )
    graded = joined.withColumn("sensitive", level).drop("__known", "__listed")
    zero, whole = F.lit(0.0), F.col(amount).cast("double")
    value = F.col("sensitive")
    return graded.withColumns(
        {
            "min_impact": F.when(value.isin(NOT_SENSITIVE, UNCLEAR), zero).when(value == SENSITIVE, whole),
            "max_impact": F.when(value.isin(SENSITIVE, UNCLEAR), whole).when(value == NOT_SENSITIVE, zero),
        }
    )


def impact_summary(graded: DataFrame, amount: str) -> DataFrame:
    """Total amount, both bounds and their share of the total, in one row."""
    sums = graded.agg(
        F.sum(F.col(amount).cast("double")).alias("total_amount"),
        F.sum("min_impact").alias("min_impact"),
        F.sum("max_impact").alias("max_impact"),
    )
    return sums.withColumns(
        {
            "min_impact_share": ratio(F.col("min_impact"), F.col("total_amount")),
            "max_impact_share": ratio(F.col("max_impact"), F.col("total_amount")),
        }
    )


def reconcile(left: DataFrame, right: DataFrame, sensitive: DataFrame, name: str, amount: str) -> DataFrame:
    """Full outer comparison of two catalogues, of which ``right`` carries amounts.

    Names of the left catalogue that are matched, not sensitive and without an amount are left out. ``status`` says
    which side is missing; ``impact`` is the amount of a matched sensitive name and 0 for a matched other one, null
    where a side is missing. Names are joined only where digests of the catalogues differ; elsewhere all names are matched
    and the rows of ``right`` stay where they were read.
    """
    listed = sensitive.select(name).withColumn("__listed", F.lit(1))
    our_changes, their_changes, unchanged = split_by_difference(left.select(name), right.select(name, amount), name)
    ours = our_changes.distinct().withColumn("__left", F.lit(True))
    theirs = their_changes.withColumn("__right", F.lit(True))
    unchanged = unchanged.withColumns({"__left": F.lit(True), "__right": F.lit(True)})
    joined = ours.join(theirs, name, "full").unionByName(unchanged).join(listed, name, "left")
    in_left, in_right = F.col("__left").isNotNull(), F.col("__right").isNotNull()
    level = F.when(in_left & F.col("__listed").isNull(), 0).otherwise(F.col("__listed"))
    graded = joined.withColumn("sensitive", level)
    kept = graded.filter(f"sensitive = 1 or sensitive is null or `{amount}` > 0")
    status = F.when(in_left & in_right, MATCHED).when(in_right, MISSING_LEFT).when(in_left, MISSING_RIGHT)
    both = in_left & in_right
    impact = F.when(both & (F.col("sensitive") == 0), F.lit(0.0)).when(
        both & (F.col("sensitive") == 1), F.col(amount).cast("double")
    )
    return kept.select(name, amount, "sensitive", status.alias("status"), impact.alias("impact"))
