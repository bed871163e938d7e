"""Revenue exposed by product category, targeting label and state.

Clicks pay for listing ads, impressions for targeted ads. Prices in the logs are whole micro-dollars. They are added
as integers and per join key before any lookup table is joined, so a join moves one row per key and not one per event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.columns import concat_key, dollars, rounded_dollars
from shelfscope.operators.relational import filter_by_list


def stores_in(stores: DataFrame, states: Sequence[str], division="division", store="store", state="state") -> DataFrame:
    """Store keys (division and number as one text) of some states."""
    key = concat_key(F.col(division), F.col(store)).alias("div_store")
    return stores.filter(F.col(state).isin(list(states))).select(key, F.col(state).alias("state"))


def sensitive_products(sold: DataFrame, sensitive: DataFrame, columns: Sequence[str], code: str, listed: str) -> DataFrame:
    """Distinct products whose category code is on a list."""
    return filter_by_list(sold.select(*columns).distinct(), code, sensitive, listed)


def slots_like(slots: DataFrame, pattern: str, slot: str = "id", name: str = "name") -> DataFrame:
    """Ids of the slots whose name matches a LIKE pattern."""
    return slots.filter(F.col(name).like(pattern)).select(F.col(slot).alias("slot_id"))


def _micros(log: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.sum(price).alias("micros"))


def _spend(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return (
        rows.groupBy(*by)
        .agg(rounded_dollars(F.sum("micros")).alias(name))
        .orderBy(F.col(name).desc(), *[F.col(c).asc() for c in by])
    )


def revenue_by_category(
    clicks: DataFrame,
    products: DataFrame,
    slots: DataFrame,
    by: Sequence[str],
    stores: DataFrame | None = None,
    sku: str = "sku",
    slot: str = "slot_id",
    price: str = "clearing_price",
    upc: str = "upc",
    name: str = "dollars_paid_clicks",
) -> DataFrame:
    """Dollars paid for clicks on some products in some slots, by columns of the products or the state of the store.

    A product listed twice counts twice, as a plain join does.
    """
    keys = [sku, slot] + (["div_store"] if stores is not None else [])
    spend = filter_by_list(_micros(clicks, keys, price), slot, slots, "slot_id")
    joined = spend.join(products, spend[sku] == products[upc])
    if stores is not None:
        joined = joined.join(stores, "div_store")
    return _spend(joined, by, name)


def revenue_by_label(
    impressions: DataFrame,
    targets: DataFrame,
    slots: DataFrame,
    labels: DataFrame,
    stores: DataFrame | None = None,
    targeting: str = "matching_target_values",
    slot: str = "slot_id",
    price: str = "clearing_price",
    label: str = "label",
    name: str = "dollars_paid_impressions",
) -> DataFrame:
    """Dollars paid for targeted impressions by label, for labels on a list (a table with a column ``label``).

    An impression with two matching labels counts under both. The list is used as a set.
    """
    keys = ["target_id", slot] + (["div_store"] if stores is not None else [])
    spend = _micros(impressions.withColumn("target_id", F.explode(targeting)), keys, price)
    spend = filter_by_list(spend, slot, slots, "slot_id")
    labelled = spend.join(targets.select(F.col("id").alias("target_id"), F.col(label)), "target_id")
    wanted = filter_by_list(labelled, label, labels, "label")
    if stores is None:
        return _spend(wanted, [label], name)
    return _spend(wanted.join(stores, "div_store"), ["state", label], name)


def spend_by_state(
    clicks: DataFrame,
    impressions: DataFrame,
    stores: DataFrame,
    unit: str = "unit_type",
    price: str = "clearing_price",
    store: str = "div_store",
    state: str = "state",
) -> DataFrame:
    """Spend per state: clicks billed per click, impressions billed per thousand, and their total.

    A state that lacks either kind is left out.
    """

    def per_state(log, billed, name):
        per_store = _micros(log.filter(F.col(unit) == billed), [store], price)
        joined = per_store.join(stores, store)
        return joined.groupBy(state).agg(dollars(F.sum("micros")).alias(name))

    both = per_state(clicks, "CPC", "click_spend").join(per_state(impressions, "CPM", "impression_spend"), state)
    return both.withColumn("total_spend", F.col("click_spend") + F.col("impression_spend"))


def households_by_state(customers: DataFrame, state: str, household: str, digital: str) -> DataFrame:
    """Digital ids and distinct households per state. A household without a number counts as one."""
    missing = F.max(F.when(F.col(household).isNull(), 1).otherwise(0))
    return customers.groupBy(state).agg(
        F.count(F.lit(1)).alias(f"n_{digital}"), (F.count_distinct(household) + missing).alias("n_households")
    )
