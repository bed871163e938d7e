"""Search keywords: cleaning, frequency, traffic coverage and the map of similar keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.operators.nearest import similar_topk
from shelfscope.operators.ordered import rank_rows, top_n
from shelfscope.operators.selection import text_codes
from shelfscope.session import cut_lineage

# Text like a coupon code, fifteen or more letters and digits without a blank, and digits only.
CODE_LENGTH = 15
CODE_LIKE = "^[a-zA-Z0-9]{15,}$"
ALL_DIGITS = "^[0-9]+$"


def is_keyword(text: Column) -> Column:
    """True for text that does not look like a coupon code; null for null. Short text needs no pattern match."""
    return (F.length(text) < CODE_LENGTH) | ~text.rlike(CODE_LIKE)


def keyword_frequency(log: DataFrame, keyword: str, count: str = "n_requests") -> DataFrame:
    """How often each keyword was asked for, in lower case. Nulls and code-like text are left out."""
    clean = log.filter(is_keyword(F.col(keyword))).select(F.lower(F.col(keyword)).alias("keyword"))
    return clean.groupBy("keyword").agg(F.count(F.lit(1)).alias(count))


def most_frequent(frequency: DataFrame, n: int = 100_000, count: str = "n_requests") -> DataFrame:
    """The n most frequent keywords; equal counts in alphabetical order. Counts are not null."""
    codes = [-F.col(count), *text_codes(F.col("keyword"))]
    return top_n(frequency, [F.col(count).desc(), F.col("keyword").asc()], n, codes)


def keyword_coverage(frequency: DataFrame, count: str = "n_requests", hot_rows: int | None = None) -> DataFrame:
    """Share of all requests that the keywords down to each one cover, from the most frequent on.

    What more frequent keywords cover comes from the number of keywords of each count, and counts differ no more often
    than the square root of twice their sum. Only keywords of equal count are put in order.
    """
    placed = rank_rows(frequency, [count], [F.col("keyword").asc()], "__at", hot_rows)
    counts = frequency.groupBy(F.col(count).alias("__count")).agg(F.sum(count).alias("__asked"))
    higher = Window.orderBy(F.desc("__count")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.select("__count", F.coalesce(F.sum("__asked").over(higher), F.lit(0)).alias("__above"))
    total = counts.agg(F.sum("__asked")).scalar()
    covered = placed.join(above, placed[count] == above["__count"])
    reached = (F.col("__above") + F.col("__at") * F.col(count)).cast("bigint")
    share = F.try_divide(reached.cast("double"), total.cast("double"))
    return covered.select(*[F.col(c) for c in frequency.columns], reached.alias("n_covered"), share.alias("coverage"))


def drop_digit_matches(matches: DataFrame, match: str = "match") -> DataFrame:
    """Leave out matches that consist of digits only. Applied after the top-k cut, so a key may keep fewer than k."""
    return matches.filter(~F.col(match).rlike(ALL_DIGITS))


def concept_map(
    keywords: DataFrame, matches: DataFrame, order: Sequence[str], keyword: str = "keyword", match: str = "match",
    place: str = "place",
) -> DataFrame:
    """Keywords that head a concept, with their matches: (keyword, matches).

    Going through the keywords in ascending ``order``, a keyword that an earlier head lists as a match belongs to that
    head and is skipped; any other keyword becomes a head. Heads without matches are left out.

    All keywords are decided in parallel rounds, usually a handful: one that no undecided earlier keyword lists is a head, and
    whatever a head lists is not. Each round is written to the checkpoint folder. ``order`` must be total; a keyword
    has at most k matches, so the final arrays are short.
    """
    rank = F.struct(*order)
    ranked = keywords.select(F.col(keyword).alias("keyword"), rank.alias("rank"))
    listed = matches.select(F.col(keyword).alias("head"), F.col(match).alias("tail"))
    edges = (
        listed.join(ranked.select(F.col("keyword").alias("head"), F.col("rank").alias("head_rank")), "head")
        .join(ranked.select(F.col("keyword").alias("tail"), F.col("rank").alias("tail_rank")), "tail")
        .filter(F.col("head_rank") < F.col("tail_rank"))
        .select("head", "tail")
    )
    open_edges = cut_lineage(edges.distinct())
    skipped = open_edges.select(F.col("tail").alias("keyword")).filter(F.lit(False))
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("tail").alias("head")).distinct()
        heads = open_edges.select("head").distinct().join(waiting, "head", "left_anti")
        gone = cut_lineage(open_edges.join(heads, "head", "left_semi").select("tail").distinct())
        skipped = skipped.union(gone.select(F.col("tail").alias("keyword")))
        left = open_edges.join(gone, "tail", "left_anti")
        open_edges = cut_lineage(left.join(gone.select(F.col("tail").alias("head")), "head", "left_anti"))
    kept = keywords.select(F.col(keyword).alias("keyword")).join(skipped, "keyword", "left_anti")
    lists = matches.groupBy(F.col(keyword).alias("keyword")).agg(
        F.sort_array(F.collect_list(F.struct(place, match))).alias("__m")
    )
    return kept.join(lists, "keyword").select("keyword", F.col(f"__m.{match}").alias("matches"))


def keyword_map(
    log: DataFrame, keyword: str, vectors: DataFrame, key: str, vector: str, n: int = 100_000, k: int = 5
) -> DataFrame:
    """From a search log to the concept map of its n most frequent keywords: (keyword, matches).

    ``vectors`` holds one vector per known key. Frequent keywords without a vector have no matches and head nothing.
    """
    # The cut list is read twice below.
    top = cut_lineage(most_frequent(keyword_frequency(log, keyword), n))
    asked = top.select(F.col("keyword").alias(key), F.lit(True).alias("asked"))
    flagged = vectors.join(asked, key, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    near = similar_topk(flagged, key, vector, k, is_query="asked")
    # At most n * k rows, read once for the edges and once for the lists.
    matches = cut_lineage(drop_digit_matches(near.select(F.col("key").alias("keyword"), "match", "place")))
    return concept_map(top.withColumn("fewer", -F.col("n_requests")), matches, ["fewer", "keyword"])
