"""Ranks, sorts, samples and rank displacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import bind
from catalogue.tables import LISTING, RANKED, SCORED, VIEWS
from shelfscope.operators import ordered as O
from shelfscope.plans import displacement as D
from shelfscope.session import cut_lineage
from shelfscope.schemas import conform

c = F.col

# --- windows


@bind(
    "window_row_number",
    f"WITH {LISTING} SELECT rid, sku, row_number() OVER (PARTITION BY rid ORDER BY pos, sku) AS shown_rank FROM listing",
)
def window_row_number(t):
    return O.rank_rows(t.listing, ["rid"], t.champion, "shown_rank").select("rid", "sku", "shown_rank")


@bind(
    "window_row_number_tiebreak",
    f"""WITH {LISTING} SELECT rid, sku, row_number() OVER (PARTITION BY rid ORDER BY qty DESC, pos, sku) AS relevance_rank
    FROM listing""",
)
def window_row_number_tiebreak(t):
    ranked = O.rank_rows(t.listing, ["rid"], [c("qty").desc(), *t.champion], "relevance_rank")
    return ranked.select("rid", "sku", "relevance_rank")


@bind(
    "window_rank",
    f"WITH {LISTING} SELECT rid, sku, rank() OVER (PARTITION BY rid ORDER BY qty) AS tied_rank FROM listing",
)
def window_rank(t):
    return O.rank_with_ties(t.listing, ["rid"], "qty", "tied_rank").select("rid", "sku", "tied_rank")


# The path of very large groups, with a limit that the three groups of the test table pass.
HOT_ROWS = 2000


@bind(
    "window_row_number_sliced",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (
      PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS place FROM lineitem""",
)
def window_row_number_sliced(t):
    order = [c("l_extendedprice").asc(), c("l_orderkey").asc(), c("l_linenumber").asc()]
    ranked = O.rank_rows(t.lineitem, ["l_returnflag"], order, "place", HOT_ROWS)
    return ranked.select("l_orderkey", "l_linenumber", "place")


@bind(
    "window_rank_sliced",
    """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS tied_rank
    FROM lineitem""",
)
def window_rank_sliced(t):
    ranked = O.rank_with_ties(t.lineitem, ["l_returnflag"], "l_quantity", "tied_rank", hot_rows=HOT_ROWS)
    return ranked.select("l_orderkey", "l_linenumber", "tied_rank")


@bind(
    "pick_one_per_key",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (
      PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem)
    WHERE r = 1""",
)
def pick_one_per_key(t):
    order = [c("l_extendedprice").desc(), c("l_orderkey").asc(), c("l_linenumber").asc(), c("l_quantity").asc()]
    picked = O.pick_one_per_key(t.lineitem, ["l_partkey"], order)
    return picked.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@bind(
    "window_share_of_total",
    """SELECT p_type, l_returnflag, n, CAST(sum(n) OVER (PARTITION BY p_type) AS BIGINT) AS total,
    round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY p_type) AS DOUBLE) * 100, 1) AS percentage
    FROM (SELECT p_type, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
)
def window_share_of_total(t):
    per_part = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    joined = per_part.join(t.part, c("l_partkey") == c("p_partkey"))
    counts = joined.groupBy("p_type", "l_returnflag").agg(F.sum("n").alias("n"))
    return O.share_of_total(counts, ["p_type"], "n", "total", "percentage")


# --- sorts, limits, samples

_REVENUE = """SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_lines
FROM lineitem GROUP BY l_partkey"""


def _revenue(t):
    exact = F.sum(c("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return t.lineitem.groupBy("l_partkey").agg(exact.alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


@bind("sort_desc", f"{_REVENUE} ORDER BY revenue DESC")
def sort_desc(t):
    return _revenue(t).orderBy(c("revenue").desc())


@bind("sort_multi", f"{_REVENUE} ORDER BY n_lines DESC, revenue DESC")
def sort_multi(t):
    return _revenue(t).orderBy(c("n_lines").desc(), c("revenue").desc())


@bind("top_n", f"{_REVENUE} ORDER BY revenue DESC, l_partkey LIMIT 100")
def top_n(t):
    return O.top_n(_revenue(t), [c("revenue").desc(), c("l_partkey").asc()], 100)


@bind("topk_per_group", f"WITH {RANKED} SELECT rid, sku, champ AS place FROM ranked WHERE champ <= 4")
def topk_per_group(t):
    return O.top_k_per_group(t.listing, ["rid"], t.champion, 4, "place").select("rid", "sku", "place")


@bind(
    "sample_fixed_n",
    f"""WITH {LISTING} SELECT rid, sku, score FROM listing
    ORDER BY md5('2024|' || CAST(rid AS VARCHAR) || '|' || CAST(sku AS VARCHAR)), rid, sku LIMIT 800""",
)
def sample_fixed_n(t):
    return O.fixed_sample(t.listing, ["rid", "sku"], 800, 2024).select("rid", "sku", "score")


_UNIFORM = """CAST('0x' || substr(md5('1|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 12)
    AS BIGINT) / CAST(281474976710656 AS DOUBLE)"""
_TIMES = " + ".join(f"CASE WHEN u >= CAST({step!r} AS DOUBLE) THEN 1 ELSE 0 END" for step in O.poisson_steps(0.5))


@bind(
    "sample_fraction",
    f"""SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, unnest(range(0, {_TIMES})) FROM
    (SELECT l_orderkey, l_partkey, l_quantity, {_UNIFORM} AS u FROM lineitem))""",
)
def sample_fraction(t):
    drawn = O.fraction_sample(t.lineitem, ["l_orderkey", "l_linenumber"], 0.5, 1)
    return drawn.select("l_orderkey", "l_partkey", "l_quantity")


# --- displacement


@bind(
    "group_completeness_filter",
    f"WITH {SCORED} SELECT rid, sku, pos, score FROM complete",
)
def group_completeness_filter(t):
    return D.complete_groups(t.scored, "rid", "score").select("rid", "sku", "pos", "score")


def displaced(t):
    return D.rank_displacement(t.scored, "rid", "pos", "score", "monetized", ["sku"])


@bind("rank_displacement", f"WITH {SCORED} SELECT rid, sku, shown_rank, relevance_rank, rank_diff FROM displaced")
def rank_displacement(t):
    return displaced(t).select("rid", "sku", "shown_rank", "relevance_rank", "rank_diff")


@bind(
    "rank_displacement_text_columns",
    f"""WITH {SCORED} SELECT CAST(rid AS VARCHAR) AS click_id, lpad(CAST(sku AS VARCHAR), 13, '0') AS upc, shown_rank,
    relevance_rank, rank_diff FROM displaced""",
)
def rank_displacement_text_columns(t):
    """The same from a clickstream record, in which every column is text."""
    page, shown = c("rid").cast("string"), c("pos").cast("string")
    raw = t.scored.select(
        page.alias("session"),
        page.alias("click_id"),
        F.lit("2024-01-01").alias("click_date"),
        F.lpad(c("sku").cast("string"), 13, "0").alias("upc"),
        shown.alias("item_index"),
        F.when(c("monetized"), "true").otherwise("false").alias("monetized"),
        c("score").cast("string").alias("relevance_score"),
        F.lit("internal-search").alias("scenario"),
        F.lit(None).cast("string").alias("component"),
        F.lit(None).cast("string").alias("text_typed"),
        F.lit(None).cast("string").alias("banner"),
    )
    ranked = D.rank_displacement(conform(raw, "search_listing"))
    return ranked.select("click_id", "upc", "shown_rank", "relevance_rank", "rank_diff")


@bind(
    "rank_displacement_raw_position",
    f"""WITH {SCORED}, early AS (SELECT *, rank() OVER (PARTITION BY rid ORDER BY score) AS relevance_rank FROM complete)
    SELECT rid, sku, relevance_rank, relevance_rank - pos AS rank_diff FROM early WHERE monetized""",
)
def rank_displacement_raw_position(t):
    early = D.rank_displacement_by_raw_position(t.scored, "rid", "pos", "score", "monetized")
    return early.select("rid", "sku", "relevance_rank", "rank_diff")


@bind(
    "rank_displacement_histogram",
    f"WITH {SCORED} SELECT rank_diff, count(*) AS n_listings FROM displaced GROUP BY rank_diff",
)
def rank_displacement_histogram(t):
    return D.displacement_histogram(displaced(t))


@bind(
    "organic_vs_paid_rank",
    "SELECT l_linenumber - CAST(l_quantity AS INTEGER) AS rank_diff, count(*) AS n_listings FROM lineitem GROUP BY 1",
)
def organic_vs_paid_rank(t):
    log = t.lineitem.select(c("l_linenumber").alias("organic"), c("l_quantity").cast("int").alias("paid"))
    return D.organic_against_paid(log, "organic", "paid")


@bind(
    "clicked_listings",
    f"WITH {SCORED}, {VIEWS} SELECT rid, sku, rank_diff FROM displaced JOIN views USING (rid, sku) WHERE rank_diff < 0",
)
def clicked_listings(t):
    lower = displaced(t).filter(c("rank_diff") < 0)
    return D.clicked_listings(lower, t.views, ["rid", "sku"]).select("rid", "sku", "rank_diff")


@bind(
    "clicked_listings_dedup",
    f"""WITH {SCORED}, {VIEWS} SELECT rid, sku, rank_diff FROM displaced d WHERE rank_diff < 0
    AND EXISTS (SELECT 1 FROM views v WHERE v.rid = d.rid AND v.sku = d.sku)""",
)
def clicked_listings_dedup(t):
    lower = displaced(t).filter(c("rank_diff") < 0)
    return D.clicked_listings(lower, t.views, ["rid", "sku"], dedupe=True).select("rid", "sku", "rank_diff")


# Views are listings of a search, clicks are product views, most of them from within the search.
_STREAM = """stream AS (SELECT user_id AS session, CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 AS upc, event_id, ts,
  CASE event_type WHEN 'view' THEN 'internal-search' WHEN 'click' THEN 'view-product' END AS scenario,
  CASE WHEN value < 60 THEN 'internal search' WHEN value < 90 THEN 'home page' END AS component FROM events),
  seen AS (SELECT v.session, v.upc, v.event_id AS view_id, v.ts AS viewed_at, l.event_id AS listing_id, l.ts AS listed_at
    FROM (SELECT * FROM stream WHERE scenario = 'view-product' AND component = 'internal search') v
    ASOF LEFT JOIN (SELECT * FROM stream WHERE scenario = 'internal-search') l
    ON v.session = l.session AND v.upc = l.upc AND v.ts >= l.ts)"""


def _clickstream(t):
    scenario = F.when(c("event_type") == "view", "internal-search").when(c("event_type") == "click", "view-product")
    return t.events.select(
        c("user_id").alias("session"),
        (F.get_json_object("props", "$.k").cast("int") % 12).alias("upc"),
        c("event_id").alias("click_id"),
        c("ts").alias("click_time"),
        scenario.alias("scenario"),
        F.when(c("value") < 60, "internal search").when(c("value") < 90, "home page").alias("component"),
    )


def _time_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@bind(
    "views_in_order",
    f"""WITH {_STREAM} SELECT * REPLACE (strftime(viewed_at, '%Y-%m-%d %H:%M:%S.%f') AS viewed_at,
    strftime(listed_at, '%Y-%m-%d %H:%M:%S.%f') AS listed_at) FROM seen""",
)
def views_in_order(t):
    views = D.views_in_order(_clickstream(t))
    return views.withColumns({"viewed_at": _time_text("viewed_at"), "listed_at": _time_text("listed_at")})


@bind(
    "clicked_listings_from_clickstream",
    f"""WITH {_STREAM} SELECT session, upc, listing_id, count(*) AS n_views, strftime(min(viewed_at), '%Y-%m-%d %H:%M:%S.%f') AS first_view FROM seen
    WHERE listing_id IS NOT NULL GROUP BY 1, 2, 3""",
)
def clicked_listings_from_clickstream(t):
    clicked = D.clicked_in_order(D.views_in_order(_clickstream(t)))
    return clicked.withColumn("first_view", _time_text("first_view"))


@bind(
    "deboost_metrics",
    f"""WITH {SCORED}, {VIEWS}, t AS (
      SELECT (SELECT count(*) FROM scored) AS total_results, (SELECT count(*) FROM scored WHERE monetized) AS total_paid,
      (SELECT count(*) FROM displaced WHERE rank_diff < 0) AS paid_lower,
      (SELECT count(*) FROM displaced WHERE rank_diff >= 0) AS paid_higher,
      (SELECT count(*) FROM displaced JOIN views USING (rid, sku) WHERE rank_diff < 0) AS clicks_lower,
      (SELECT count(*) FROM displaced JOIN views USING (rid, sku) WHERE rank_diff >= 0) AS clicks_higher)
    SELECT *, paid_lower + paid_higher AS ranked_paid, CAST(total_paid AS DOUBLE) / total_results AS paid_share,
    CAST(paid_lower AS DOUBLE) / total_paid AS lower_of_paid, CAST(paid_lower AS DOUBLE) / total_results AS lower_of_results,
    CAST(clicks_lower AS DOUBLE) / paid_lower AS click_rate_lower,
    CAST(clicks_lower AS DOUBLE) / (paid_lower + paid_higher) AS clicks_lower_of_ranked,
    CAST(clicks_higher AS DOUBLE) / paid_higher AS click_rate_higher,
    CAST(clicks_higher AS DOUBLE) / (paid_lower + paid_higher) AS clicks_higher_of_ranked FROM t""",
)
def deboost_metrics(t):
    # Totals, bad pages and ranks all read the listings: they are built once.
    listings = cut_lineage(t.scored)
    ranked = D.rank_displacement(listings, "rid", "pos", "score", "monetized", ["sku"])
    return D.displacement_metrics(listings, ranked, t.views, "monetized", ["rid", "sku"])
