"""Champion-against-challenger evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import bind
from catalogue.tables import LISTING, RANKED
from shelfscope.functions import arrays as A
from shelfscope.operators.ordered import equal_width_histogram, share_of_total
from shelfscope.operators.selection import exact_median
from shelfscope.plans import rank_eval as E
from shelfscope.session import scratch_path
from shelfscope.sources.keyed import key_space
from shelfscope.sources.writers import materialize

c = F.col

# --- ranked lists


def _text_lists(lists, column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(lists)


# Each query on lists is bound twice: with whole lists, and cut to short segments that the test tables do fill.
LONG, SHORT = 10_000, 3


def _segment(rank, rows):
    return f"CAST(floor(({rank} - 1) / {rows}) AS BIGINT) AS segment"


def _bind_both(name, sql):
    def register(build):
        for suffix, rows in (("", LONG), ("_segments", SHORT)):
            bind(name + suffix, sql(rows))(lambda t, rows=rows: build(t, rows))
        return build

    return register


@_bind_both(
    "collect_ranked_list",
    lambda rows: f"""WITH {RANKED} SELECT rid, {_segment("champ", rows)}, string_agg(CAST(sku AS VARCHAR), ',' ORDER BY champ) AS skus,
    string_agg(CAST(click AS VARCHAR), ',' ORDER BY champ) AS clicks FROM ranked GROUP BY 1, 2""",
)
def collect_ranked_list(t, rows):
    lists = E.ranked_lists(t.ranked, "rid", "champ", ["sku", "click"], rows)
    return lists.select("rid", "segment", _text_lists("skus", c("sku")), _text_lists("clicks", c("click")))


def _retrieval(t):
    """Retrieval results as parallel arrays of scores and items."""
    return E.ranked_lists(t.ranked, "rid", "champ", ["score", "sku"])


@_bind_both(
    "array_zip_sort",
    lambda rows: f"""WITH {RANKED} SELECT rid, {_segment("chal", rows)}, max(score) AS best_score,
    string_agg(CAST(sku AS VARCHAR), ',' ORDER BY score DESC, sku DESC) AS skus FROM ranked GROUP BY 1, 2""",
)
def array_zip_sort(t, rows):
    # Items are ranked before they are cut into segments, so segments follow each other in the order of the whole list.
    lists = E.ranked_lists(t.ranked, "rid", "chal", ["score", "sku"], rows)
    pairs = lists.select("rid", "segment", A.sorted_pairs(c("score"), c("sku")).alias("pairs"))
    best = F.get("pairs.score", F.lit(0)).alias("best_score")
    return pairs.select("rid", "segment", _text_lists("skus", c("pairs.item")), best)


@bind("array_explode_zip", f"WITH {RANKED} SELECT rid, sku, score FROM ranked")
def array_explode_zip(t):
    lists = _retrieval(t)
    return lists.select("rid", F.inline(F.arrays_zip("sku", "score")))


@bind("challenger_rank", f"WITH {RANKED} SELECT rid, sku, score, chal AS chal_rank FROM ranked")
def challenger_rank(t):
    results = _retrieval(t).select("rid", F.arrays_zip("score", "sku").alias("results"))
    return E.challenger_items(results, "rid", "results")


@bind(
    "retrieval_completeness",
    f"""WITH {LISTING}, a AS (SELECT rid, count(*) AS n FROM listing GROUP BY rid),
    b AS (SELECT l_orderkey AS rid, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT count(*) AS n_requests, CAST(sum(a.n) AS BIGINT) AS n_items, avg(CAST(a.n AS DOUBLE)) AS mean_items
    FROM a JOIN b ON a.rid = b.rid AND a.n = b.n""",
)
def retrieval_completeness(t):
    retrieved = t.lineitem.select(c("l_orderkey").alias("rid"))
    return E.completeness_report(E.complete_requests(t.listing, retrieved, "rid"))


@bind(
    "clicked_requests",
    f"WITH {LISTING} SELECT rid, sku, click FROM listing WHERE rid IN (SELECT rid FROM listing WHERE click > 0)",
)
def clicked_requests(t):
    return E.clicked_requests(t.listing, "rid", "click").select("rid", "sku", "click")


@bind(
    "array_set_ops",
    f"""WITH {RANKED}, n AS (SELECT rid, count(*) FILTER (champ <= 4) AS nc, count(*) FILTER (chal <= 4) AS nh,
      count(*) FILTER (champ <= 4 AND chal <= 4) AS n_both FROM ranked GROUP BY rid)
    SELECT rid, CAST(nh - n_both AS INTEGER) AS n_inserted, CAST(n_both AS INTEGER) AS n_kept,
    nc = n_both AND nh = n_both AS same_items FROM n""",
)
def array_set_ops(t):
    top = E.top_lists(t.listing, "rid", "sku", t.champion, t.challenger)
    return top.select(
        "rid",
        F.size(F.array_except("chal_items", "champ_items")).alias("n_inserted"),
        F.size(F.array_intersect("chal_items", "champ_items")).alias("n_kept"),
        A.same_set(c("champ_items"), c("chal_items")).alias("same_items"),
    )


# --- error classes

_PLER = f"""{RANKED}, per AS (
    SELECT rid, min(CASE WHEN chal <= 4 AND champ > 4 THEN chal END) AS min_ins,
      min(CASE WHEN chal <= 4 AND click = 0 THEN chal END) AS min_non,
      count(*) FILTER (chal <= 4 AND champ > 4) > 0 AS differs FROM ranked GROUP BY rid),
  pler AS (
    SELECT r.rid, CASE WHEN chal > 4 THEN 'Deletion Error' WHEN chal = champ THEN 'Correct-same rank'
      WHEN chal < champ THEN 'Correct-better rank' WHEN NOT differs THEN 'Substitution Error'
      WHEN min_non IS NULL OR min_non > chal THEN 'Correct Substitution'
      WHEN min_ins < chal AND min_non < chal THEN 'Insertion Error Type 1' ELSE 'Insertion Error Type 2' END AS result_type,
      sku AS item
    FROM ranked r JOIN per ON r.rid = per.rid WHERE champ <= 4 AND click = 1
    UNION ALL
    SELECT rid, 'Correct-Inserted item', sku FROM ranked WHERE champ > 4 AND chal <= 4 AND click = 1)"""


def pler(t, listing=None):
    return E.classify_errors(E.top_lists(t.listing if listing is None else listing, "rid", "sku", t.champion, t.challenger, "click"), "rid")


@bind("pler_classify", f"WITH {_PLER} SELECT * FROM pler")
def pler_classify(t):
    return pler(t)


@bind(
    "pler_breakdown",
    f"""WITH {_PLER} SELECT result_type, count(DISTINCT rid) AS n_requests,
    CAST(count(DISTINCT rid) AS DOUBLE) / CAST((SELECT count(DISTINCT rid) FROM pler) AS DOUBLE) * 100 AS percentage
    FROM pler GROUP BY result_type""",
)
def pler_breakdown(t):
    return E.error_breakdown(pler(t), "rid")


def _enriched(t, listing=None):
    return E.enrich_errors(pler(t, listing), t.part, "p_partkey", ["p_name", "p_brand", "p_type"])


def _share(t, by):
    counts = _enriched(t).groupBy(by, "result_type").agg(F.count_distinct("rid").alias("n_requests"))
    return share_of_total(counts, [by], "n_requests", "total", "percentage")


def _share_sql(by):
    return f"""WITH {_PLER}, g AS (SELECT {by}, result_type, count(DISTINCT rid) AS n_requests
      FROM pler LEFT JOIN part ON item = p_partkey GROUP BY 1, 2)
    SELECT *, CAST(sum(n_requests) OVER w AS BIGINT) AS total,
    round(CAST(n_requests AS DOUBLE) / CAST(sum(n_requests) OVER w AS DOUBLE) * 100, 1) AS percentage
    FROM g WINDOW w AS (PARTITION BY {by})"""


@bind("pler_share_by_category", _share_sql("p_type"))
def pler_share_by_category(t):
    return _share(t, "p_type")


@bind("pler_share_by_brand", _share_sql("p_brand"))
def pler_share_by_brand(t):
    return _share(t, "p_brand")


def _lists_sql(prefix, rank, columns):
    return ", ".join(f"string_agg(CAST({c} AS VARCHAR), ',' ORDER BY {rank}) AS {prefix}_{c}" for c in columns)


_LISTED = ["sku", "click", "p_brand"]


def _pler_enriched_sql(rows):
    return f"""WITH {_PLER}, listed AS (SELECT * FROM ranked LEFT JOIN part ON sku = p_partkey),
    ours AS (SELECT rid, {_segment("champ", rows)}, string_agg(CAST(chal AS VARCHAR), ',' ORDER BY champ) AS corresp_chal_rank,
      {_lists_sql("champ", "champ", _LISTED)} FROM listed GROUP BY 1, 2),
    theirs AS (SELECT rid, {_segment("chal", rows)}, {_lists_sql("chal", "chal", _LISTED)} FROM listed GROUP BY 1, 2),
    lists AS (SELECT * FROM ours FULL JOIN theirs USING (rid, segment)),
    places AS (SELECT rid, sku AS item, {_segment("champ", rows)} FROM ranked)
    SELECT rid, segment, result_type, item, p_name, p_brand, p_type, corresp_chal_rank, champ_sku, champ_click, champ_p_brand,
      chal_sku, chal_click, chal_p_brand FROM pler LEFT JOIN part ON item = p_partkey JOIN places USING (rid, item)
      JOIN lists USING (rid, segment)"""


@_bind_both("pler_enriched", _pler_enriched_sql)
def pler_enriched(t, rows):
    # Lists, places and error classes all read the ranked listings: they are built once.
    ranked = materialize(t.ranked.select("rid", "sku", "click", "pos", "score", "champ", "chal"), scratch_path(t.spark, "ranked"))
    items = ranked.join(t.part, c("sku") == c("p_partkey"), "left")
    lists = E.evaluation_lists(items, "rid", "champ", "chal", _LISTED, rows)
    names = ["corresp_chal_rank", *[f"{side}_{n}" for side in ("champ", "chal") for n in _LISTED]]
    places = E.item_segments(ranked, "rid", "sku", ["champ", "chal"], rows).withColumnRenamed("sku", "item")
    shown = lists.select("rid", "segment", *[_text_lists(n, c(n)) for n in names])
    return _enriched(t, ranked).join(places, ["rid", "item"]).join(shown, ["rid", "segment"])


@_bind_both("pler_enriched_staged", _pler_enriched_sql)
def pler_enriched_staged(t, rows):
    items = t.ranked.join(t.part, c("sku") == c("p_partkey"), "left").withColumnRenamed("sku", "item")
    items = materialize(items.select("rid", "item", c("item").alias("sku"), "champ", "chal", "click", "p_brand"), scratch_path(t.spark, "items"))
    errors = materialize(_enriched(t), scratch_path(t.spark, "errors"))
    space = key_space([items, errors], ["rid"])
    found = E.enrich_in_place(space.stage(errors), space.stage(items), "item", "champ", "chal", _LISTED, rows).rows()
    names = ["corresp_chal_rank", *[f"{side}_{n}" for side in ("champ", "chal") for n in _LISTED]]
    kept = ["rid", "segment", "result_type", "item", "p_name", "p_brand", "p_type"]
    return found.select(*kept, *[_text_lists(n, c(n)) for n in names])


# --- overlap and rank correlation

_RBO = f"""{RANKED}, depth AS (SELECT unnest([1, 2, 3, 4]) AS d),
  overlap AS (SELECT rid, d, count(*) FILTER (champ <= d AND chal <= d) AS shared, max(n) AS n
    FROM ranked, depth GROUP BY rid, d),
  rbo AS (SELECT rid, round(sum(CASE WHEN d <= n THEN 0.22::DOUBLE * pow(0.78::DOUBLE, d - 1) * shared / d ELSE 0 END), 9)
    AS rbo FROM overlap GROUP BY rid)"""


def rbo(t):
    scores = E.rbo_top_k(E.top_lists(t.listing, "rid", "sku", t.champion, t.challenger), "rid", k=4, p=0.78)
    return scores.withColumn("rbo", F.round("rbo", 9))


@bind("rbo_topk", f"WITH {_RBO} SELECT * FROM rbo")
def rbo_topk(t):
    return rbo(t)


@bind("score_median", f"WITH {_RBO} SELECT round(median(rbo), 9) AS median FROM rbo")
def score_median(t):
    return exact_median(rbo(t), "rbo").select(F.round("median", 9).alias("median"))


@bind(
    "score_histogram",
    f"""WITH {_RBO}, m AS (SELECT min(rbo) AS low, max(rbo) AS high FROM rbo)
    SELECT CAST(least(floor((rbo - low) * 30 / (high - low)), 29) AS INTEGER) AS bin, count(*) AS n_rows
    FROM rbo, m GROUP BY 1""",
)
def score_histogram(t):
    return equal_width_histogram(rbo(t), "rbo", 30)


# Lists in the test tables have no ties and at most 33 items, so the p-value is the exact one: twice the chance that a
# random order has as few pairs out of place (or as few in place).
_TAU = f"""WITH RECURSIVE {RANKED}, inv(n, counts) AS (
    SELECT 1, [1.0::DOUBLE] UNION ALL
    SELECT n + 1, list_transform(range(0, (n + 1) * n // 2 + 1), lambda k:
      list_sum(counts[greatest(1, k - n + 1):least(k + 1, len(counts))]) / (n + 1)) FROM inv WHERE n < 33),
  pairs AS (SELECT a.rid, count(*) AS m, count(*) FILTER (b.chal < a.chal) AS discordant
    FROM ranked a JOIN ranked b ON a.rid = b.rid AND a.champ < b.champ GROUP BY a.rid),
  sized AS (SELECT r.rid, r.n, coalesce(m, 0) AS m, coalesce(discordant, 0) AS discordant
    FROM (SELECT rid, max(n) AS n FROM ranked GROUP BY rid) r LEFT JOIN pairs ON r.rid = pairs.rid)
  SELECT rid, s.n, discordant, CASE WHEN m > 0 THEN round(CAST(m - 2 * discordant AS DOUBLE) / m, 9) END AS tau,
  CASE WHEN m > 0 THEN round(CASE WHEN 2 * least(discordant, m - discordant) = m THEN 1.0
    ELSE least(1.0, 2 * list_sum(counts[1:least(discordant, m - discordant) + 1])) END, 9) END AS p_value
  FROM sized s JOIN inv ON s.n = inv.n"""


@bind("kendall_tau_blocks", _TAU)
def kendall_tau_blocks(t):
    """Lists cut into blocks of four, so that the doubling rounds run on the test tables."""
    scores = E.kendall_tau(t.ranked, "rid", "champ", "chal", block=4)
    return scores.withColumns({"tau": F.round("tau", 9), "p_value": F.round("p_value", 9)})


@bind("kendall_tau", _TAU)
def kendall_tau(t):
    scores = E.kendall_tau(t.ranked, "rid", "champ", "chal", tie_free=True)
    return scores.withColumns({"tau": F.round("tau", 9), "p_value": F.round("p_value", 9)})


# The normal approximation: p = erfc(|balance| / sqrt(2 * spread)), with erf as its series of positive terms.
_ERFC = """1 - 2 / sqrt(pi()) * exp(-h * h) * list_sum([exp((2 * k + 1) * ln(h) + 2 * k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))
    for k in range(0, 400)])"""


def _normal_tau(x, y):
    """Tau-b and its normal p-value of two expressions over the ranks, by comparing all pairs."""
    ties = lambda v, prefix: f"""(SELECT rid, sum(t * (t - 1) // 2) AS t{prefix}, sum(t * (t - 1) * (t - 2)) AS {prefix}0,
      sum(t * (t - 1) * (2 * t + 5)) AS {prefix}1 FROM (SELECT rid, count(*) AS t FROM r GROUP BY rid, {v}) GROUP BY rid)"""
    return f"""WITH {RANKED}, r AS (SELECT rid, champ, {x} AS x, {y} AS y FROM ranked),
  pairs AS (SELECT a.rid, count(*) FILTER (a.x < b.x AND a.y > b.y) AS discordant, count(*) FILTER (a.x < b.x AND a.y < b.y) AS concordant
    FROM r a JOIN r b ON a.rid = b.rid AND a.champ <> b.champ GROUP BY a.rid),
  sized AS (SELECT *, n * (n - 1) // 2 AS m FROM (SELECT rid, count(*) AS n FROM r GROUP BY rid) LEFT JOIN pairs USING (rid)
    JOIN {ties("x", "x")} USING (rid) JOIN {ties("y", "y")} USING (rid)),
  scaled AS (SELECT *, CASE WHEN m > tx AND m > ty THEN CAST(concordant - discordant AS DOUBLE) END AS balance,
    (n * (n - 1) * (2 * n + 5) - x1 - y1) / 18.0::DOUBLE + 2.0::DOUBLE * tx * ty / nullif(n * (n - 1), 0)
      + CASE WHEN n > 2 THEN x0 * y0 / (9.0::DOUBLE * n * (n - 1) * (n - 2)) ELSE 0 END AS spread FROM sized),
  placed AS (SELECT *, abs(balance) / sqrt(2 * spread) AS h FROM scaled)
  SELECT rid, n, coalesce(discordant, 0) AS discordant, round(balance / sqrt(CAST(m - tx AS DOUBLE) * CAST(m - ty AS DOUBLE)), 9) AS tau,
    CASE WHEN balance = 0 THEN 1.0::DOUBLE ELSE round({_ERFC}, 9) END AS p_value FROM placed"""


@bind("kendall_tau_normal", _normal_tau("champ", "chal"))
def kendall_tau_normal(t):
    scores = E.kendall_tau(t.ranked, "rid", "champ", "chal", tie_free=True, p_method="normal")
    return scores.withColumns({"tau": F.round("tau", 9), "p_value": F.round("p_value", 9)})


@bind("kendall_tau_ties", _normal_tau("champ // 2", "chal // 3"))
def kendall_tau_ties(t):
    """Ranks in bands of two and of three places, so that every longer list has ties."""
    banded = t.ranked.select("rid", F.floor(c("champ") / 2).alias("x"), F.floor(c("chal") / 3).alias("y"))
    scores = E.kendall_tau(banded, "rid", "x", "y", p_method="normal")
    return scores.withColumns({"tau": F.round("tau", 9), "p_value": F.round("p_value", 9)})
