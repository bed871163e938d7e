"""Rank displacement of paid products in search results, and the clicks they get.

A result page is a group of listings. Two ranks are compared: where a listing is shown, and where its relevance score
alone would put it. ``rank_diff = relevance_rank - shown_rank``; a negative value means that the listing is shown
lower than its organic merit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.columns import ratio
from shelfscope.operators.ordered import deal, largest_so_far, rank_rows_by, rank_with_ties
from shelfscope.operators.relational import drop_groups_with

# Scenarios and the component of a clickstream.
SEARCH_SCENARIO = "internal-search"
VIEW_SCENARIO = "view-product"
INTERNAL_COMPONENT = "internal search"


def complete_groups(listings: DataFrame, page: str, score: str) -> DataFrame:
    """Drop every listing of a page on which any listing lacks a score."""
    return drop_groups_with(listings, [page], F.col(score).isNull())


def rank_displacement(
    listings: DataFrame,
    page: str = "click_id",
    position: str = "item_index",
    score: str = "relevance_score",
    monetized: str = "monetized",
    tie_break: Sequence[str] = ("upc",),
    hot_rows: int | None = None,
) -> DataFrame:
    """Monetized listings with ``shown_rank``, ``relevance_rank`` and ``rank_diff``.

    Positions may have gaps or not start at 1, so they are renumbered first. Equal scores keep the shown order, which
    makes the difference as small as it can be. All listings of a page take part in the ranks; the paid ones are
    picked afterwards.
    """
    complete = complete_groups(deal(listings, [page]), page, score)
    shown_order = [F.col(position).asc(), *[F.col(c).asc() for c in tie_break]]
    by_score = [F.col(score).desc(), F.col("shown_rank").asc()]
    ranked = rank_rows_by(complete, [page], {"shown_rank": shown_order, "relevance_rank": by_score}, hot_rows)
    with_diff = ranked.withColumn("rank_diff", F.col("relevance_rank") - F.col("shown_rank"))
    return with_diff.filter(F.col(monetized))


def rank_displacement_by_raw_position(
    listings: DataFrame,
    page: str = "click_id",
    position: str = "item_index",
    score: str = "relevance_score",
    monetized: str = "monetized",
    hot_rows: int | None = None,
) -> DataFrame:
    """The early variant: a rank with ties by ascending score, minus the position as logged."""
    complete = complete_groups(deal(listings, [page]), page, score)
    ranked = rank_with_ties(complete, [page], score, "relevance_rank", hot_rows=hot_rows)
    with_diff = ranked.withColumn("rank_diff", F.col("relevance_rank") - F.col(position))
    return with_diff.filter(F.col(monetized))


def displacement_histogram(ranked: DataFrame, difference: str = "rank_diff") -> DataFrame:
    """How often each rank difference occurs."""
    return ranked.groupBy(difference).agg(F.count(F.lit(1)).alias("n_listings")).orderBy(difference)


def organic_against_paid(log: DataFrame, organic: str, paid: str) -> DataFrame:
    """Histogram of organic minus paid rank as logged by the ad platform."""
    return displacement_histogram(log.select((F.col(organic) - F.col(paid)).alias("rank_diff")))


def clicked_listings(
    listings: DataFrame, views: DataFrame, keys: Sequence[str] = ("session", "upc"), dedupe: bool = False
) -> DataFrame:
    """Listings with a product view in the same session.

    A product viewed twice counts twice, as a plain join does; with ``dedupe`` each listing counts once.
    """
    if dedupe:
        return listings.join(views.select(*keys).distinct(), list(keys), "left_semi")
    return listings.join(views.select(*keys), list(keys))


def views_in_order(
    clickstream: DataFrame,
    keys: Sequence[str] = ("session", "upc"),
    at: str = "click_time",
    identifier: str = "click_id",
    view_component: str | None = INTERNAL_COMPONENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each product view with the listing it came from: (keys, view_id, viewed_at, listing_id, listed_at).

    Listings are the rows of the search scenario, views those of the product scenario, where ``view_component`` also restricts
    the part of the site they started in; None takes all. A view belongs to the latest listing of the same keys that is not later, of
    equally late ones to that with the larger id, and to none if there is none. The stream is read and shuffled once, and a view
    stays one row however often its product was listed. Rows without a time take no part.
    """
    scenario, component = F.col("scenario"), F.col("component")
    listed = scenario == SEARCH_SCENARIO
    viewed = (scenario == VIEW_SCENARIO) & (F.lit(view_component is None) | (component == F.lit(view_component)))
    rows = clickstream.filter(F.col(at).isNotNull() & (listed | viewed))
    rows = rows.select(*keys, F.col(at).alias("__at"), F.col(identifier).alias("__id"), viewed.alias("__view"))
    mark = F.when(~F.col("__view"), F.struct("__at", "__id"))
    order = [F.col(c).asc() for c in ("__at", "__view", "__id")]
    latest = largest_so_far(rows, keys, order, mark, "__latest", hot_rows).filter("__view")
    names = {"__id": "view_id", "__at": "viewed_at", "__latest.__id": "listing_id", "__latest.__at": "listed_at"}
    return latest.select(*keys, *[F.col(c).alias(a) for c, a in names.items()])


def clicked_in_order(views: DataFrame, keys: Sequence[str] = ("session", "upc")) -> DataFrame:
    """Listings with the views that belong to them: (keys, listing_id, n_views, first_view). Views without a listing drop out."""
    known = views.filter(F.col("listing_id").isNotNull())
    return known.groupBy(*keys, "listing_id").agg(F.count(F.lit(1)).alias("n_views"), F.min("viewed_at").alias("first_view"))


def displacement_metrics(
    listings: DataFrame,
    displaced: DataFrame,
    views: DataFrame,
    monetized: str = "monetized",
    keys: Sequence[str] = ("session", "upc"),
) -> DataFrame:
    """One row of totals and ratios.

    ``listings`` are all search results, ``displaced`` the output of :func:`rank_displacement`. Paid listings on pages
    without scores count in ``total_paid`` but not in ``ranked_paid``. Clicks are join rows between listings and views:
    both sides are counted per key first, so repeated views are multiplied and never materialised.
    """
    keys = list(keys)
    per_key = displaced.groupBy(*keys).agg(
        F.count_if(F.col("rank_diff") < 0).alias("lower"), F.count_if(F.col("rank_diff") >= 0).alias("higher")
    )
    viewed = deal(views, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("views"))
    joined = per_key.join(viewed, keys, "left").withColumn("views", F.coalesce(F.col("views"), F.lit(0)))
    zero = F.lit(0).cast("bigint")
    ranked = joined.agg(
        zero.alias("total_results"),
        zero.alias("total_paid"),
        F.sum("lower").alias("paid_lower"),
        F.sum("higher").alias("paid_higher"),
        F.sum(F.col("lower") * F.col("views")).alias("clicks_lower"),
        F.sum(F.col("higher") * F.col("views")).alias("clicks_higher"),
    )
    raw = listings.agg(
        F.count(F.lit(1)).alias("total_results"),
        F.count_if(F.col(monetized)).alias("total_paid"),
        *[zero.alias(c) for c in ("paid_lower", "paid_higher", "clicks_lower", "clicks_higher")],
    )
    totals = raw.unionByName(ranked).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in raw.columns])
    totals = totals.withColumn("ranked_paid", F.col("paid_lower") + F.col("paid_higher"))
    c = F.col
    return totals.withColumns(
        {
            "paid_share": ratio(c("total_paid"), c("total_results")),
            "lower_of_paid": ratio(c("paid_lower"), c("total_paid")),
            "lower_of_results": ratio(c("paid_lower"), c("total_results")),
            "click_rate_lower": ratio(c("clicks_lower"), c("paid_lower")),
            "clicks_lower_of_ranked": ratio(c("clicks_lower"), c("ranked_paid")),
            "click_rate_higher": ratio(c("clicks_higher"), c("paid_higher")),
            "clicks_higher_of_ranked": ratio(c("clicks_higher"), c("ranked_paid")),
        }
    )
