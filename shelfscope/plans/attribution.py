"""Attribution: transactions of listed products with a hashed household id."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.columns import pad_code, sheet_safe
from shelfscope.operators.relational import broadcast_join
from shelfscope.sources.workspace import Workspace
from shelfscope.sources.writers import export_pipe

# Days before a campaign that an exposure may count, and after it that a purchase may.
EXPOSURE_DAYS, CONVERSION_DAYS = 3, 14


def padded_allow_list(products: DataFrame, code: str) -> DataFrame:
    """Distinct product codes, padded to full length; codes that are null drop out."""
    padded = products.select(pad_code(F.col(code).cast("string")).alias("upc"))
    return padded.filter(F.col("upc").isNotNull()).distinct()


def attribution_backfill(
    transactions: DataFrame,
    households: DataFrame,
    allow_list: DataFrame,
    household: str = "household_id",
    upc: str = "upc",
    hashed: str = "hashed_id",
    drop: Sequence[str] = ("net_spend", "retail_amount"),
) -> DataFrame:
    """Transactions of allow-listed products with the hashed id in place of the household number.

    A household may have several hashed ids: each gives a row. The product list filters before the household join, so
    the large join only sees rows that stay. ``allow_list`` has one column ``upc`` of padded codes.
    """
    listed = allow_list.select(F.col("upc").alias("__listed")).distinct()
    kept = transactions.join(listed, F.col(upc) == F.col("__listed"), "left_semi")
    hashed_ids = households.select(household, hashed)
    return kept.join(hashed_ids, household).drop(household, *drop)


def attribution_export(
    workspace: Workspace,
    start: str | date,
    end: str | date,
    households: DataFrame,
    allow_list: DataFrame,
    path: str,
    rules: dict[str, Column] | Sequence[Column] = (),
    log: str = "transactions",
) -> DataFrame:
    """Export the transactions that a campaign from ``start`` to ``end`` may have caused, pipe-delimited, and return them.

    The period begins with the earliest exposure before the campaign and ends with the latest conversion after it.
    """
    first, last = (datetime.strptime(str(d)[:10], "%Y-%m-%d").date() for d in (start, end))
    dated = workspace.transactions(first - timedelta(days=EXPOSURE_DAYS), last + timedelta(days=CONVERSION_DAYS), rules=rules, log=log)
    rows = attribution_backfill(dated, households, allow_list)
    export_pipe(rows, path)
    return rows


def product_list_by_brand(
    products: DataFrame, brands: Sequence[str], upc: str = "upc", description: str = "description", brand: str = "brand"
) -> DataFrame:
    """Products of some brands for a spreadsheet: codes keep their leading zeros."""
    return products.filter(F.col(brand).isin(list(brands))).select(
        sheet_safe(F.col(upc)).alias("upc"),
        F.col(description).alias("item_desc"),
        F.col(brand).alias("marketing_brand"),
    )


def campaign_impressions(
    workspace: Workspace, start: str, end: str, campaigns: DataFrame, log: str, log_type: str, key: str = "campaign_id"
) -> DataFrame:
    """Log rows of some campaigns in a period, with the columns of the campaign table."""
    return broadcast_join(workspace.log(log, start, end, log_type), campaigns, [key])


def drill_down(log: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Everything a log holds about some requests or campaigns."""
    return log.filter(F.col(column).isin(list(values)))
