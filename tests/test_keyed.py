"""Stages by key: the same rows as plain joins, no exchange where keys are in buckets, hot and null keys apart."""

import pytest
from pyspark.sql import functions as F

from shelfscope.plans import rank_eval as E
from shelfscope.sources.keyed import key_space


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    fact = [(k % 7 if k % 11 else None, k) for k in range(200)] + [(3, 1000 + k) for k in range(100)]
    names = [(k, f"n{k}") for k in range(2, 9)] + [(None, "null"), (3, "twice")]
    return spark.createDataFrame(fact, "k int, v int"), spark.createDataFrame(names, "k long, name string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [10_000, 30, 0])
def test_same_rows_as_a_plain_join(tables, rows, how, hot_rows):
    fact, names = tables
    space = key_space([fact, names], ["k"], buckets=5, hot_rows=hot_rows)
    staged = space.stage(fact)
    assert rows(staged.rows()) == rows(fact)
    hot = {r.k for r in staged.hot.collect()}
    assert hot == {10_000: {None}, 30: {None, 3}, 0: {None, *range(7)}}[hot_rows]
    assert rows(staged.join(space.stage(names), how=how).rows()) == rows(fact.join(names, "k", how))


def test_joins_and_groups_by_the_key_need_no_exchange(tables, no_broadcast, rows):
    fact, names = tables
    space = key_space([fact, names], ["k"], buckets=5)
    staged, named = space.stage(fact), space.stage(names)
    totals = staged.map(lambda df: df.groupBy("k").agg(F.sum("v").alias("total")))
    joined = staged.join(named).join(totals).join(totals.map(lambda df: df.withColumnRenamed("total", "again")), how="left")
    plan = plan_of(joined.even)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Bucketed: true" in plan
    want = fact.join(names, "k").join(fact.groupBy("k").agg(F.sum("v").alias("total")), "k").withColumn("again", F.col("total"))
    assert rows(joined.rows()) == rows(want)


def test_enrichment_by_request_needs_no_exchange(spark, no_broadcast, rows):
    listed = [(r, f"i{(r * 7 + p) % 40}", p + 1, (p * 3) % 8 + 1, p % 2) for r in range(30) for p in range(8)]
    listed += [(None, "i1", 1, 1, 1), (77, "only chal", None, 1, 0)]
    items = spark.createDataFrame(listed, "rid int, item string, champ int, chal int, click int")
    errors = items.filter("click = 1 OR rid = 77").select("rid", "item", F.lit("class").alias("result_type"))
    space = key_space([items, errors], ["rid"], buckets=4, hot_rows=1000)
    found = E.enrich_in_place(space.stage(errors), space.stage(items), "item", "champ", "chal", ["click"], 3)
    plan = plan_of(found.even)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
    lists = E.evaluation_lists(items, "rid", "champ", "chal", ["click"], 3)
    places = E.item_segments(items, "rid", "item", ["champ", "chal"], 3)
    want = errors.join(places, ["rid", "item"]).join(lists, ["rid", "segment"])
    assert rows(found.rows().select(*want.columns)) == rows(want)


def test_odd_stages(spark, tables, rows):
    fact, names = tables
    space = key_space([fact.limit(0), names.limit(0)], ["k"], buckets=3)
    assert rows(space.stage(fact.limit(0)).join(space.stage(names.limit(0))).rows()) == []
    # Keys get the widest type of all tables, else equal keys would be in different buckets.
    assert space.stage(fact).even.schema["k"].dataType.simpleString() == "bigint"
    two = key_space([names.withColumn("w", F.col("k") + 1)], ["k", "w"], hot_rows=1)
    assert {r.k for r in two.stage(names.withColumn("w", F.col("k") + 1)).hot.collect()} == {None, 3}
    with pytest.raises(ValueError, match="same key space"):
        space.stage(fact).join(two.stage(names.withColumn("w", F.col("k"))))
    with pytest.raises(ValueError, match="moves rows"):
        space.stage(fact).join(space.stage(names), how="full")
