import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import ordered as O
from shelfscope.plans import displacement as D
from shelfscope.schemas import schema_of
from shelfscope.session import cut_lineage

SCHEMA = "session string, click_id string, upc string, item_index int, monetized boolean, relevance_score double"


@pytest.fixture(scope="module")
def listings(spark):
    rows = [
        # gaps in positions, two equal scores
        ("s1", "g1", "a", 3, True, 0.1), ("s1", "g1", "b", 5, False, 0.9), ("s1", "g1", "c", 9, True, 0.9),
        # one listing without a score: the whole page drops out
        ("s2", "g2", "a", 1, True, None), ("s2", "g2", "b", 2, True, 0.4),
        # nothing paid, and a single listing
        ("s3", "g3", "a", 1, False, 0.3), ("s3", "g4", "d", 7, True, 0.5),
        # scores whose text order differs from their numeric order
        ("s5", "g5", "x", 1, True, 9.0), ("s5", "g5", "y", 2, True, 10.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def views(spark):
    return spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s5", "y"), ("s2", "b"), ("s9", "a")], "session string, upc string")


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_rank_displacement(listings, rows, hot_rows):
    ranked = D.rank_displacement(listings, hot_rows=hot_rows)
    assert rows(ranked, "click_id", "upc", "shown_rank", "relevance_rank", "rank_diff") == [
        ("g1", "a", 1, 3, 2), ("g1", "c", 3, 2, -1), ("g4", "d", 1, 1, 0), ("g5", "x", 1, 2, 1), ("g5", "y", 2, 1, -1),
    ]


def test_differences_cancel_on_a_page(listings):
    everything = listings.withColumn("monetized", F.lit(True))
    sums = D.rank_displacement(everything).groupBy("click_id").agg(F.sum("rank_diff").alias("s"))
    assert {r.s for r in sums.collect()} == {0}


def test_kept_and_dropped_pages_add_up(listings):
    kept = D.complete_groups(listings, "click_id", "relevance_score").select("click_id").distinct().count()
    dropped = listings.filter(F.col("relevance_score").isNull()).select("click_id").distinct().count()
    assert kept + dropped == listings.select("click_id").distinct().count()


def test_raw_position_variant(listings, rows):
    early = D.rank_displacement_by_raw_position(listings)
    assert rows(early, "click_id", "upc", "relevance_rank", "rank_diff") == [
        ("g1", "a", 1, -2), ("g1", "c", 2, -7), ("g4", "d", 1, -6), ("g5", "x", 1, 0), ("g5", "y", 2, 0),
    ]


def test_clicks_with_and_without_fan_out(listings, views, rows):
    ranked = D.rank_displacement(listings)
    assert rows(D.clicked_listings(ranked, views), "click_id", "upc") == [("g1", "a"), ("g1", "a"), ("g5", "y")]
    assert rows(D.clicked_listings(ranked, views, dedupe=True), "click_id", "upc") == [("g1", "a"), ("g5", "y")]


def test_metrics(listings, views):
    m = D.displacement_metrics(listings, D.rank_displacement(listings), views).first()
    assert (m.total_results, m.total_paid, m.ranked_paid) == (9, 7, 5)
    assert (m.paid_lower, m.paid_higher, m.clicks_lower, m.clicks_higher) == (2, 3, 1, 2)
    assert m.click_rate_lower == 0.5 and m.click_rate_higher == 2 / 3 and m.lower_of_results == 2 / 9
    assert m.lower_of_paid == 2 / 7 and m.clicks_lower_of_ranked == 0.2 and m.clicks_higher_of_ranked == 0.4


def test_metrics_of_nothing(listings, views):
    none = listings.filter(F.lit(False))
    m = D.displacement_metrics(none, D.rank_displacement(none), views).first()
    assert m.total_results == 0 and m.click_rate_lower is None and m.paid_share is None


def test_histograms(listings, spark, rows):
    assert rows(D.displacement_histogram(D.rank_displacement(listings))) == [(-1, 2), (0, 1), (1, 1), (2, 1)]
    log = spark.createDataFrame([(3, 1), (4, 2), (1, 1), (None, 2)], "o int, p int")
    assert rows(D.organic_against_paid(log, "o", "p")) == [(0, 1), (2, 2), (None, 1)]


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_views_belong_to_the_latest_listing_before_them(spark, hot_rows):
    """Random streams, one session with a third of all rows, equal times, a scenario and a component that do not count."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        session, upc = rng.choice(["hot", f"s{i % 20}", f"s{i % 20}"]), rng.choice(["a", "b", None])
        scenario, component = rng.choice(["internal-search", "view-product", "other", None]), rng.choice(["internal search", "internal search", "home", None])
        rows.append((session, upc, f"c{i:03}", rng.choice([None, *range(30)]), scenario, component))
    df = spark.createDataFrame(rows, "session string, upc string, click_id string, click_time int, scenario string, component string").repartition(4)
    for part in ("internal search", None):
        want = set()
        for s, u, i, at, scenario, component in rows:
            if scenario == "view-product" and at is not None and part in (None, component):
                earlier = [(t, c) for s2, u2, c, t, sc, _ in rows if (s2, u2, sc) == (s, u, "internal-search") and t is not None and t <= at]
                time, listing = max(earlier, default=(None, None))
                want.add((s, u, i, at, listing, time))
        got = D.views_in_order(df, view_component=part, hot_rows=hot_rows)
        assert got.columns == ["session", "upc", "view_id", "viewed_at", "listing_id", "listed_at"]
        found = [tuple(r) for r in got.collect()]
        assert set(found) == want and len(found) == len(want)
        clicked = {(r.session, r.upc, r.listing_id): r.n_views for r in D.clicked_in_order(got).collect()}
        assert clicked == Counter((s, u, listing) for s, u, _, _, listing, _ in want if listing)


def test_views_take_one_shuffle(spark):
    df = spark.createDataFrame([], schema_of("clickstream"))
    views = D.views_in_order(df)
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and views.count() == 0


def test_tasks_follow_the_files_not_the_shuffles_of_the_session(spark, rows, tmp_path, monkeypatch):
    made = spark.range(900).selectExpr("id % 90 AS page", "id AS sku", "id % 7 AS pos", "double(id * 13 % 11) AS score", "id % 2 = 0 AS paid")
    made.withColumn("score", F.when(F.col("sku") != 5, F.col("score"))).write.parquet(f"{tmp_path}/listings")
    listings = spark.read.parquet(f"{tmp_path}/listings")
    ranked = lambda df: D.rank_displacement(df, "page", "pos", "score", "paid", ["sku"])
    views = listings.select("page", "sku")
    want = rows(ranked(listings)), rows(D.displacement_metrics(listings, ranked(listings), views, "paid", ["page", "sku"]))
    monkeypatch.setattr(O, "TASK_BYTES", 1 << 10)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (listings, cut_lineage(listings)):
        assert O.deal(df, ["page"]).rdd.getNumPartitions() > tasks
        assert (rows(ranked(df)), rows(D.displacement_metrics(df, ranked(df), views, "paid", ["page", "sku"]))) == want
    assert O.deal(spark.range(3), ["id"]).columns == ["id"]
