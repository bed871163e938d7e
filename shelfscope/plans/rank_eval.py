"""Comparison of a champion and a challenger ranking of the same items per request.

The input is one row per request and item with an order for each model and a click flag. Scores that look at the top
of the lists (error classes, overlap) keep k rows per request and model before any shuffle, so list length and hot
requests do not matter to them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from shelfscope.functions.arrays import common_in_first, same_set, select_where
from shelfscope.functions.inversions import COUNTS, count_list_batches
from shelfscope.operators.ordered import rank_rows, rank_rows_by, top_k_per_group
from shelfscope.session import cut_lineage, input_bytes
from shelfscope.sources.keyed import KeyedStage

# Lists longer than this are counted in blocks, see kendall_tau.
BLOCK = 1 << 16
# No list of an input up to this size is too long for one task.
ONE_LIST_BYTES = 64 << 20
# Longest list for which the exact distribution of discordant pairs is used when there are no ties.
EXACT_P_LENGTH = 33

# Names of the result classes.
SAME_RANK = "Correct-same rank"
BETTER_RANK = "Correct-better rank"
INSERTED = "Correct-Inserted item"
CORRECT_SUBSTITUTION = "Correct Substitution"
SUBSTITUTION = "Substitution Error"
INSERTION_1 = "Insertion Error Type 1"
INSERTION_2 = "Insertion Error Type 2"
DELETION = "Deletion Error"
RESULT_CLASSES = (
    SAME_RANK, BETTER_RANK, INSERTED, CORRECT_SUBSTITUTION, SUBSTITUTION, INSERTION_1, INSERTION_2, DELETION,
)


def challenger_items(retrieval: DataFrame, request: str, results: str, score: str = "score", item: str = "sku"):
    """One row per retrieved item with its ``chal_rank``: by score, then item, both descending.

    Requests without results drop out; an item without a score has no rank.
    """
    exploded = retrieval.select(request, F.explode(results).alias("__r")).select(
        request, F.col(f"__r.{item}").alias(item), F.col(f"__r.{score}").alias(score)
    )
    order = [F.col(score).desc_nulls_last(), F.col(item).desc()]
    ranked = rank_rows(exploded, [request], order, "chal_rank")
    return ranked.withColumn("chal_rank", F.when(F.col(score).isNotNull(), F.col("chal_rank")))


def complete_requests(shown: DataFrame, retrieved: DataFrame, request: str) -> DataFrame:
    """Requests with as many retrieved as shown items, with that number ``n_items``."""
    count = lambda df: df.groupBy(request).agg(F.count(F.lit(1)).alias("n_items"))
    return count(shown).join(count(retrieved), [request, "n_items"])


def completeness_report(complete: DataFrame) -> DataFrame:
    """Requests, items and mean list length of :func:`complete_requests`, in one row."""
    return complete.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum("n_items").alias("n_items"),
        F.avg(F.col("n_items").cast("double")).alias("mean_items"),
    )


def clicked_requests(items: DataFrame, request: str, click: str) -> DataFrame:
    """All rows of the requests that have a click."""
    return items.join(items.filter(F.col(click) > 0).select(request).distinct(), request, "left_semi")


def ranked_lists(
    items: DataFrame, request: str, position: str, columns: Sequence[str], segment_rows: int = 10_000
) -> DataFrame:
    """Ranked lists as aligned arrays: (request, segment, position array and one array per column).

    ``position`` numbers the items of a request from 1. A list is one row while it has at most ``segment_rows`` items
    and continues in further segments after that, so no task has to hold an unbounded list. Nulls stay in the arrays.
    """
    columns = list(columns)
    segment = F.floor((F.col(position) - 1) / segment_rows).cast("bigint").alias("segment")
    entries = F.sort_array(F.collect_list(F.struct(position, *columns)))
    lists = items.groupBy(request, segment).agg(entries.alias("__entries"))
    return lists.select(request, "segment", *[F.col(f"__entries.{c}").alias(c) for c in [position, *columns]])


def evaluation_lists(
    items: DataFrame,
    request: str,
    champion_rank: str,
    challenger_rank: str,
    columns: Sequence[str],
    segment_rows: int = 10_000,
) -> DataFrame:
    """Both rankings of each request side by side, as aligned arrays.

    In champion order: ``champ_rank``, ``corresp_chal_rank`` (the challenger's rank of the same items) and
    ``champ_<column>``; in challenger order ``chal_rank`` and ``chal_<column>``. Segments as in :func:`ranked_lists`, and
    (request, segment) is the key. An item without a rank is missing from that model's lists only.
    """
    columns = list(columns)
    has = lambda rank: items.filter(F.col(rank).isNotNull())
    ours = ranked_lists(has(champion_rank), request, champion_rank, [challenger_rank, *columns], segment_rows)
    theirs = ranked_lists(has(challenger_rank), request, challenger_rank, columns, segment_rows)
    named = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in columns]
    ranks = [F.col(champion_rank).alias("champ_rank"), F.col(challenger_rank).alias("corresp_chal_rank")]
    left = ours.select(request, "segment", *ranks, *named("champ"))
    other = [F.col(request).alias("__request"), F.col("segment").alias("__segment")]
    right = theirs.select(*other, F.col(challenger_rank).alias("chal_rank"), *named("chal"))
    same = left[request].eqNullSafe(F.col("__request")) & (left["segment"] == F.col("__segment"))
    joined = left.join(right, same, "full_outer")
    # A segment that only one model has must not lose its request, also where the request itself is null.
    keys = [F.coalesce(left[request], "__request").alias(request), F.coalesce(left["segment"], "__segment").alias("segment")]
    return joined.select(*keys, *[F.col(c) for c in left.columns[2:]], *[F.col(c) for c in right.columns[2:]])


def item_segments(items: DataFrame, request: str, item: str, ranks: Sequence[str], segment_rows: int = 10_000) -> DataFrame:
    """(request, item, segment): the segment of :func:`ranked_lists` that holds an item, by the first rank it has."""
    rank = F.coalesce(*ranks)
    return items.select(request, item, F.floor((rank - 1) / segment_rows).cast("bigint").alias("segment"))


def _top(items, request, order, columns, k, prefix):
    top = top_k_per_group(items, [request], order, k, "__at")
    entries = F.sort_array(F.collect_list(F.struct("__at", *columns.values())))
    lists = top.groupBy(request).agg(entries.alias("__top"))
    return lists.select(request, *[F.col(f"__top.{c}").alias(f"{prefix}_{a}") for a, c in columns.items()])


def top_lists(
    items: DataFrame,
    request: str,
    item: str,
    champion: Sequence[Column],
    challenger: Sequence[Column],
    click: str | None = None,
    k: int = 4,
) -> DataFrame:
    """The first k items of both models per request, as arrays ``champ_items`` and ``chal_items``.

    With ``click`` also ``champ_clicks`` and ``chal_clicks``, the flags at the same places.
    """
    columns = {"items": item} | ({"clicks": click} if click else {})
    ours = _top(items, request, champion, columns, k, "champ")
    return ours.join(_top(items, request, challenger, columns, k, "chal"), request)


def classify_errors(top: DataFrame, request: str) -> DataFrame:
    """Result class of every clicked champion item, and of every clicked item that the challenger brings in.

    Works on :func:`top_lists` with clicks; a request without clicks gives no rows, so it need not be removed before. For a clicked item at place p of the champion and q of the challenger:
    absent from the challenger; the same place; a better place; same items in another order; nothing unclicked at or
    above q; an inserted item above q; anything else.
    """
    champ, chal = F.col("champ_items"), F.col("chal_items")
    inserted = F.array_except(chal, champ)
    places = lambda found: F.transform(found, lambda x: F.array_position(chal, x))
    prepared = top.select(
        request,
        champ,
        chal,
        same_set(champ, chal).alias("same"),
        select_where(champ, F.col("champ_clicks"), 1).alias("clicked"),
        F.array_intersect(select_where(chal, F.col("chal_clicks"), 1), inserted).alias("gained"),
        F.array_min(places(select_where(chal, F.col("chal_clicks"), 0))).alias("first_unclicked"),
        F.array_min(places(inserted)).alias("first_inserted"),
    )

    def grade(item: Column) -> Column:
        p, q = F.array_position(champ, item), F.array_position(chal, item)
        unclicked_from = F.coalesce(F.col("first_unclicked") <= q, F.lit(False))
        inserted_above = F.coalesce(F.col("first_inserted") < q, F.lit(False))
        unclicked_above = F.coalesce(F.col("first_unclicked") < q, F.lit(False))
        return (
            F.when(q == 0, DELETION)
            .when(q == p, SAME_RANK)
            .when(q < p, BETTER_RANK)
            .when(F.col("same"), SUBSTITUTION)
            .when(~unclicked_from, CORRECT_SUBSTITUTION)
            .when(inserted_above & unclicked_above, INSERTION_1)
            .otherwise(INSERTION_2)
        )

    entry = lambda item, result: F.struct(result.alias("result_type"), item.alias("item"))
    graded = F.transform(F.col("clicked"), lambda x: entry(x, grade(x)))
    gained = F.transform(F.col("gained"), lambda x: entry(x, F.lit(INSERTED)))
    results = prepared.select(request, graded.alias("__graded"), F.when(~F.col("same"), gained).alias("__gained"))
    none = F.expr("slice(__graded, 1, 0)")
    return results.select(request, F.inline(F.concat("__graded", F.coalesce(F.col("__gained"), none))))


def error_breakdown(errors: DataFrame, request: str) -> DataFrame:
    """Requests per result class and their percentage of all graded requests.

    A request may have several classes, so the percentages may add up to more than 100. One flag per class and request
    gives all the distinct counts in a single pass; classes without a request are not listed.
    """
    flags = [F.max(F.col("result_type") == name).alias(f"__c{i}") for i, name in enumerate(RESULT_CLASSES)]
    counts = [F.count_if(f"__c{i}").alias(f"__n{i}") for i in range(len(RESULT_CLASSES))]
    totals = errors.groupBy(request).agg(*flags).agg(F.count(F.lit(1)).alias("__all"), *counts)
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("result_type"), F.col(f"__n{i}").alias("n_requests"))
            for i, name in enumerate(RESULT_CLASSES)
        ]
    )
    share = F.try_divide(F.col("n_requests").cast("double"), F.col("__all").cast("double"))
    listed = totals.select("__all", F.inline(rows)).filter(F.col("n_requests") > 0)
    return listed.select("result_type", "n_requests", (share * 100).alias("percentage"))


def enrich_errors(errors: DataFrame, items: DataFrame, item: str, attributes: Sequence[str]) -> DataFrame:
    """Add attributes of the graded item; an item without attributes is kept."""
    known = items.select(F.col(item).alias("item"), *attributes)
    return errors.join(known, "item", "left")


def enrich_in_place(
    errors: KeyedStage,
    items: KeyedStage,
    item: str,
    champion_rank: str,
    challenger_rank: str,
    columns: Sequence[str],
    segment_rows: int = 10_000,
) -> KeyedStage:
    """Classified items (``item``) with both ranked lists of their request, as :func:`evaluation_lists` names them.

    Both sides are staged by the request, so lists, places and all three joins stay in its bucket. An item outside
    ``items`` drops out; where one model has no list for its segment, that model's columns are null.
    """
    (request,) = items.keys

    def listed(prefix: str, rank: str, others: Sequence[str], names: Sequence[str]):
        def step(df: DataFrame) -> DataFrame:
            lists = ranked_lists(df.filter(F.col(rank).isNotNull()), request, rank, [*others, *columns], segment_rows)
            named = [F.col(c).alias(f"{prefix}_{c}") for c in columns]
            return lists.select(request, "segment", *[F.col(c).alias(n) for c, n in zip([rank, *others], names, strict=True)], *named)

        return step

    ours = items.map(listed("champ", champion_rank, [challenger_rank], ["champ_rank", "corresp_chal_rank"]))
    theirs = items.map(listed("chal", challenger_rank, [], ["chal_rank"]))
    ranks = [champion_rank, challenger_rank]
    # A request that asks for an item twice would fan out; places are distinct.
    places = items.map(lambda df: item_segments(df, request, item, ranks, segment_rows).filter("segment IS NOT NULL").distinct())
    return errors.join(places, [item]).join(ours, ["segment"], "left").join(theirs, ["segment"], "left")


def rbo_top_k(top: DataFrame, request: str, k: int = 4, p: float = 0.78) -> DataFrame:
    """Rank-biased overlap of the first k places per request, not extrapolated.

    ``sum over d = 1..min(k, N) of (1-p) p^(d-1) |C_d & H_d| / d`` (Webber, Moffat and Zobel 2010). Two equal lists of
    at least k items score 1 - p^k.
    """
    champ, chal = F.col("champ_items"), F.col("chal_items")
    depth = F.least(F.size(champ), F.size(chal))
    score = F.lit(0.0)
    for d in range(1, k + 1):
        term = F.lit((1 - p) * p ** (d - 1) / d) * common_in_first(champ, chal, d)
        score = score + F.when(depth >= d, term).otherwise(0.0)
    return top.select(request, score.alias("rbo"))


def _counted_lists(lists: DataFrame, request: str) -> DataFrame:
    """Counts of gathered lists of pairs, see :data:`COUNTS`."""
    kind = lists.schema[request].dataType.simpleString()
    return lists.mapInArrow(count_list_batches, f"`{request}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _discordant_within(pairs: DataFrame, request: str, block: int) -> DataFrame:
    """Pairs out of order inside blocks of consecutive places."""
    number = F.floor((F.col("__x") - 1) / block)
    lists = pairs.groupBy(request, number.alias("__block")).agg(F.collect_list(F.struct("__x", "__y")).alias("__list"))
    return _counted_lists(lists.select(request, "__list"), request).select(request, F.col("discordant").alias("__out"))


def _discordant_across(pairs: DataFrame, request: str, half: int, hot_rows: int | None) -> DataFrame:
    """Pairs out of order between the two halves of blocks of ``2 * half`` places.

    In order of y, the left-half rows before a right-half row are its place in the block minus its place among the
    right half; all other left-half rows of the block form a pair out of order with it.
    """
    split = pairs.withColumns(
        {"__block": F.floor((F.col("__x") - 1) / (2 * half)), "__half": F.floor((F.col("__x") - 1) / half) % 2}
    )
    by_y = [F.col("__y").asc()]
    placed = rank_rows(split, [request, "__block"], by_y, "__in_block", hot_rows)
    placed = rank_rows(placed, [request, "__block", "__half"], by_y, "__in_half", hot_rows)
    # A block with a right half has a full left half.
    behind = F.lit(half) - (F.col("__in_block") - F.col("__in_half"))
    return placed.filter(F.col("__half") == 1).select(request, behind.alias("__out"))


def kendall_tau(
    items: DataFrame,
    request: str,
    x: str,
    y: str,
    tie_free: bool = False,
    block: int = BLOCK,
    hot_rows: int | None = None,
    p_method: str = "auto",
) -> DataFrame:
    """Kendall's tau-b of two ranks per request, with what its p-value needs: (request, n, discordant, tau, p_value).

    Null for fewer than two items or when all items tie. ``tie_free`` says that neither rank repeats within a request,
    which saves the tie counts of long lists. Discordant pairs are counted as a merge sort does: a list of up to ``block`` items in one
    task, many lists at a time; longer lists inside blocks of consecutive places, and between blocks by doubling the
    block size until the longest list is covered.

    The p-value is two-sided. With ``p_method="auto"`` it is exact for lists without ties of at most 33 items or at most
    one pair out of place, else from the normal approximation; ``"normal"`` always takes the approximation.
    """
    if p_method not in ("auto", "normal"):
        raise ValueError(f"unknown p_method {p_method}")
    rows = items.select(request, F.col(x).alias("__rx"), F.col(y).alias("__ry"))
    size = input_bytes(rows) if block == BLOCK and hot_rows is None else None
    longest = 0
    if size is None or size > ONE_LIST_BYTES:
        # Read for the lengths, and again for the counts.
        rows = cut_lineage(rows)
        longest = rows.groupBy(request).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= block:
        lists = rows.groupBy(request).agg(F.collect_list(F.struct("__rx", "__ry")).alias("__list"))
        joined = _counted_lists(lists, request)
    else:
        joined = _count_in_blocks(rows, request, tie_free, block, longest, hot_rows)
    n = F.col("n")
    pairs_in_all = F.call_function("div", n * (n - 1), F.lit(2))
    total = pairs_in_all.cast("bigint")
    balance = total - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("discordant")
    scale = F.sqrt((total - F.col("tx")).cast("double") * (total - F.col("ty")).cast("double"))
    tau = F.when(scale > 0, balance.cast("double") / scale)
    p_value = F.when(
        scale > 0,
        _two_sided_p(
            n, F.col("discordant"), balance, *[F.col(c) for c in ("tx", "ty", "x0", "x1", "y0", "y1")],
            F.lit(p_method == "auto"),
        ),
    )
    return joined.select(request, "n", "discordant", tau.alias("tau"), p_value.alias("p_value"))


def _count_in_blocks(rows: DataFrame, request: str, tie_free: bool, block: int, longest: int, hot_rows: int | None) -> DataFrame:
    """The counts of :func:`_counted_lists` for lists of any length."""
    # Equal y keep their order in x, so a tie is never out of order.
    orders = {"__x": [F.col("__rx").asc(), F.col("__ry").asc()], "__y": [F.col("__ry").asc(), F.col("__x").asc()]}
    # Every doubling round reads the ranks again.
    pairs = cut_lineage(rank_rows_by(rows, [request], orders, hot_rows).select(request, "__x", "__y"))
    sizes = rows.groupBy(request).agg(F.count(F.lit(1)).alias("n"))
    parts = _discordant_within(pairs, request, block)
    half = block
    while half < longest:
        long_enough = sizes.filter(F.col("n") > half).select(request)
        halves = pairs.join(long_enough, request, "left_semi")
        parts = parts.unionByName(_discordant_across(halves, request, half, hot_rows))
        half *= 2
    joined = sizes.join(parts.groupBy(request).agg(F.sum("__out").alias("discordant")), request)
    if tie_free:
        return joined.withColumns({c: F.lit(0).cast("bigint") for c in COUNTS[2:]})
    for columns, names in ((["__rx"], ("tx", "x0", "x1")), (["__ry"], ("ty", "y0", "y1"))):
        joined = joined.join(_tie_sums(rows, request, columns, names), request)
    return joined.join(_tie_sums(rows, request, ["__rx", "__ry"], ("txy",)), request)


def _tie_sums(rows: DataFrame, request: str, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sums over tie groups of size t: t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5), as many as there are names."""
    t = F.col("__t")
    terms = [F.call_function("div", t * (t - 1), F.lit(2)), t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5)]
    counts = rows.groupBy(request, *columns).agg(F.count(F.lit(1)).alias("__t"))
    return counts.groupBy(request).agg(*[F.sum(e).cast("bigint").alias(a) for a, e in zip(names, terms)])


@cache
def _exact_cumulative() -> np.ndarray:
    """P(at most d discordant pairs) for a random order of n items, as [n, d]."""
    width = EXACT_P_LENGTH * (EXACT_P_LENGTH - 1) // 2 + 1
    table = np.ones((EXACT_P_LENGTH + 1, width))
    share = np.zeros(width)
    share[0] = 1.0
    for n in range(2, EXACT_P_LENGTH + 1):
        # The n-th item adds 0..n-1 discordant pairs, each with the same probability.
        upto = np.cumsum(share)
        shifted = np.concatenate([np.zeros(n), upto[:-n]])
        share = (upto - shifted) / n
        table[n] = np.cumsum(share)
    return table


@pandas_udf(DoubleType())
def _two_sided_p(
    n: pd.Series, out: pd.Series, balance: pd.Series, tx: pd.Series, ty: pd.Series,
    x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series, exact: pd.Series,
) -> pd.Series:
    from math import erfc, exp, lgamma

    n, out, balance = (s.to_numpy("float64") for s in (n, out, balance))
    tx, ty, x0, x1, y0, y1 = (s.to_numpy("float64") for s in (tx, ty, x0, x1, y0, y1))
    total = n * (n - 1) / 2
    fewer = np.minimum(out, total - out)
    no_ties = (tx == 0) & (ty == 0) & exact.to_numpy(bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = n * (n - 1)
        spread = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m + np.where(n > 2, x0 * y0 / (9 * m * (n - 2)), 0)
        z = np.abs(balance) / np.sqrt(spread)
    short = no_ties & (n <= EXACT_P_LENGTH)
    p, table = np.empty(len(n)), _exact_cumulative()
    # Few values of z differ: lists of one length have as many as pairs.
    values, at = np.unique(z[~short], return_inverse=True)
    p[~short] = np.array([erfc(v / 2**0.5) for v in values])[at]
    p[short] = np.minimum(1.0, 2 * table[n[short].astype(int), fewer[short].astype(int)])
    # The middle of the distribution is counted from both sides.
    p[short & (4 * fewer == n * (n - 1))] = 1.0
    extreme = no_ties & ~short & (fewer <= 1)
    lengths, at = np.unique(n[extreme], return_inverse=True)
    orders = np.array([2 * exp(-lgamma(a + 1)) for a in lengths])[at]
    p[extreme] = orders * np.where(fewer[extreme] == 0, 1, n[extreme])
    return pd.Series(p)
