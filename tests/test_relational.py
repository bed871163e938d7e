import pytest
from pyspark.sql import functions as F

from shelfscope.operators import relational as R


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 4), ("d", 5)], "k string, v int")


def test_list_filter_uses_a_set_and_ignores_nulls(spark, left, rows):
    listed = spark.createDataFrame([("a",), ("a",), (None,), ("None",)], "x string")
    assert rows(R.filter_by_list(left, "k", listed, "x")) == [("a", 1), ("a", 2)]


def test_group_drop_keeps_null_keys(left, rows):
    assert rows(R.drop_groups_with(left, ["k"], F.col("v").isNull() | (F.col("v") == 2))) == [("d", 5), (None, 4)]


def test_prefix_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`__meta` int, `with blank` int, c int")
    assert R.project_without_prefix(df).columns == ["with blank", "c"]


def test_broadcast_only_below_the_limit(spark, monkeypatch):
    fact, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(R.broadcast_join(fact, small, ["k"]))
    monkeypatch.setattr(R, "BROADCAST_BYTES", 1)
    assert not hinted(R.broadcast_join(fact, small, ["k"]))


def test_join_audit_counts_fan_out(spark, left):
    right = spark.createDataFrame([("a",), ("a",), ("a",), ("z",), (None,)], "k string")
    audit = R.join_audit(left, right, ["k"]).first()
    assert tuple(audit) == (5, 2, 6, 3)
    assert left.join(right, "k").count() == audit.rows_after


def test_uniqueness_and_duplicates(left, spark):
    assert tuple(R.count_and_distinct(left, ["k"]).first()) == (5, 4, 1)
    assert tuple(R.duplicate_impact(left, ["k"]).first()) == (5, 4, 20.0)
    empty = left.filter(F.lit(False))
    assert tuple(R.duplicate_impact(empty, ["k"]).first()) == (0, 0, None)


def test_distinct_values_count_a_null_once(left):
    assert tuple(R.distinct_values(left, ["k", "v"]).first()) == (4, 5)


def test_null_profile_and_column_report(left, rows):
    assert tuple(R.null_profile(left).first()) == (1, 1)
    assert rows(R.column_report(left)) == [("k", "string", 5, 1), ("v", "int", 5, 1)]


def test_rules_are_joined_by_and(left, rows):
    assert rows(R.with_rules(left, {"known": F.col("k").isNotNull(), "big": F.col("v") > 1})) == [("a", 2), ("d", 5)]
    assert R.with_rules(left, []).count() == 5


def test_cast_gives_null_for_bad_text(spark, rows):
    df = spark.createDataFrame([("1", "2.5"), ("x", ""), (None, "7")], "i string, d string")
    assert rows(R.cast_columns(df, {"i": "int", "d": "double"})) == [(1, 2.5), (None, 7.0), (None, None)]


def test_explode_join_drops_null_and_empty_arrays(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a", "a", "z"])], "id int, t array<string>")
    labels = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, label string")
    assert rows(R.explode_join(df, "t", labels, "key", "e"), "id", "label") == [(1, "A"), (1, "B"), (4, "A"), (4, "A")]


def test_range_join(spark, rows):
    facts = spark.createDataFrame([("c", 1), ("c", 5), ("c", 9), ("d", 5)], "c string, at int")
    periods = spark.createDataFrame([("c", 5, 8), ("c", 1, 1)], "c string, s int, e int")
    assert rows(R.join_within_range(facts, periods, ["c"], "at", "s", "e"), "c", "at") == [("c", 1), ("c", 5)]


@pytest.mark.parametrize("bucket", [1, 7, 32, 10_000])
def test_periods_in_buckets_equal_a_comparison_of_all(spark, rows, bucket):
    """Dates, open and reversed and null ends, a hot key, periods that start before all rows and end after them."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    facts = spark.range(300).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 > 0, "cold").alias("k"), F.when(F.col("id") != 7, day((F.col("id") * 7 % 100).cast("int"))).alias("at"), "id")
    ends = F.when(F.col("id") % 13 == 0, F.lit("9999-12-31").cast("date")).when(F.col("id") % 11 != 0, day((F.col("id") * 3 % 120).cast("int")))
    periods = spark.range(60).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("k"), day((F.col("id") * 5 % 130 - 20).cast("int")).alias("s"), ends.alias("e"), F.col("id").alias("p"))
    want = facts.join(periods, "k").filter(F.col("at").between(F.col("s"), F.col("e")))
    got = R.join_within_range(facts, periods, ["k"], "at", "s", "e", bucket)
    assert got.columns == want.columns and rows(got) == rows(want) != []


def test_a_hot_key_meets_periods_of_its_own_bucket_only(spark):
    facts = spark.range(4000).selectExpr("'hot' AS k", "id % 1000 AS at")
    periods = spark.range(500).selectExpr("'hot' AS k", "id * 2 AS s", "id * 2 + 1 AS e")
    joined = R.join_within_range(facts, periods, ["k"], "at", "s", "e", bucket=10)
    assert joined.count() == 4000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan.split("Join Inner")[1].split("\n")[0]
    # Ten units a bucket: five periods for each row instead of five hundred.
    bucketed = periods.selectExpr("k", "explode(sequence(s DIV 10, e DIV 10)) AS b")
    assert facts.selectExpr("k", "at DIV 10 AS b").join(bucketed, ["k", "b"]).count() == 4000 * 5


def test_cut_periods_are_not_broadcast_by_an_estimate_of_whole_ones(spark):
    facts = spark.range(3000).selectExpr("id % 30 AS k", "id AS at")
    periods = spark.range(30).selectExpr("id AS k", "0 AS s", "3000 AS e")
    joined = R.join_within_range(facts, periods, ["k"], "at", "s", "e", bucket=1)
    assert joined.count() == 3000
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_range_join_of_nothing(spark):
    facts, periods = spark.range(3).selectExpr("'a' AS k", "id AS at"), spark.range(3).selectExpr("'a' AS k", "id AS s", "id AS e")
    assert R.join_within_range(facts.limit(0), periods, ["k"], "at", "s", "e").count() == 0
    assert R.join_within_range(facts, periods.limit(0), ["k"], "at", "s", "e").count() == 0
