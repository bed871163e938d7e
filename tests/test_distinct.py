"""Distinct rows by fingerprint, and distinct counts by sketch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import fingerprints as P
from shelfscope.operators import sketches as S

SCHEMA = "a string, b string, c double, d array<string>, `e f` struct<g:int,h:string>"


def wide_rows(seed, n):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, "x", "y", ""])
    return [(pick(), pick(), rng.choice([None, 0.0, -0.0, 1.5, float("nan")]), rng.choice([None, [], [None, "x"], ["x", None]]), (rng.choice([1, None]), pick())) for _ in range(n)]


@pytest.mark.parametrize(("hash_bits", "copies"), [(64, 1), (64, 400), (3, 1), (0, 200)])
def test_distinct_rows_whatever_the_hash(spark, hash_bits, copies):
    """Also where hashes are cut to three bits or none, so that different rows share them."""
    rows = [("hot", "row", 1.0, ["z"], (7, "h"))] * copies + wide_rows(1, 150)
    rows += [(f"only {i}", None, None, None, (i, None)) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    # The two zeros are equal, and either may stand for both.
    listed = lambda rows: Counter(str(r).replace("-0.0", "0.0") for r in rows)
    want = listed(df.distinct().collect())
    assert listed(P.distinct_rows(df, hash_bits).collect()) == want
    assert tuple(P.count_and_distinct(df, df.columns, hash_bits).first()) == (len(rows), sum(want.values()), len(rows) - sum(want.values()))


def test_nothing_and_single_rows(spark):
    df = spark.createDataFrame(wide_rows(2, 1), SCHEMA)
    assert P.distinct_rows(df).count() == 1
    assert P.distinct_rows(df.limit(0)).count() == 0
    assert tuple(P.count_and_distinct(df.limit(0), df.columns).first()) == (0, 0, 0)


def test_rows_of_their_own_are_not_shuffled(spark):
    """One long text a row: what is shuffled is a fingerprint, and the rows that occur twice."""
    df = spark.range(3000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"))
    again = df.filter("id % 300 = 0")
    flagged = P.flag_repeats(df.unionByName(again), ["id", "text"])
    marked = {r["id"]: r["n"] for r in flagged.filter("__again").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert {i for i in range(0, 3000, 300)} <= marked.keys() and len(marked) < 60
    plan = P.distinct_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") == 1 and "SortMergeJoin" not in plan


def test_the_bitmap_has_a_bound(spark):
    """With far more repeated fingerprints than bits nearly all rows are compared, and the result is the same."""
    df = spark.range(2000).select(F.concat(F.lit("k"), F.col("id") % 1000).alias("k"))
    flagged = P.flag_repeats(df, ["k"], most_bits=P.LEAST_BITS)
    assert flagged.filter("NOT __again").isEmpty() and P.distinct_rows(df).count() == 1000


def test_narrow_keys_are_counted_directly(spark):
    df = spark.range(10).selectExpr("id % 3 AS a", "CAST(id AS int) % 2 AS b")
    assert P.is_narrow(df, ["a", "b"]) and not P.is_narrow(df.withColumn("t", F.lit("x")), ["a", "t"])
    assert tuple(P.count_and_distinct(df, ["a", "b"]).first()) == (10, 6, 4)


@pytest.mark.parametrize("n", [0, 1, 40, 30_000])
def test_sketches_of_days_unite_to_the_period(spark, n):
    """A third of all rows has one key, days overlap, nulls do not count."""
    df = spark.range(n).selectExpr("CAST(id % 7 AS int) AS day", "IF(id % 3 = 0, 'hot', 'rare') AS k", "IF(id % 11 = 0, NULL, id DIV 2) AS v")
    days = S.distinct_sketches(df, ["day", "k"], ["v"])
    period = {r.k: r.n_v for r in S.estimates(S.united(days, ["k"])).collect()}
    whole = {r.k: r.n_v for r in S.estimates(S.distinct_sketches(df, ["k"], ["v"])).collect()}
    exact = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert period.keys() == exact.keys() == whole.keys()
    for k, count in exact.items():
        assert abs(period[k] - count) <= max(1, 3 * S.standard_error() * count)
        assert abs(whole[k] - count) <= max(1, 3 * S.standard_error() * count)


def test_sketches_survive_a_written_table(spark, tmp_path):
    df = spark.range(5000).selectExpr("id % 5 AS day", "id % 997 AS v", "id % 13 AS w")
    S.distinct_sketches(df, ["day"], ["v", "w"]).write.parquet(str(tmp_path / "days"))
    row = S.estimates(S.united(spark.read.parquet(str(tmp_path / "days")), [])).first()
    assert abs(row.n_v - 997) <= 3 * S.standard_error() * 997 and row.n_w == 13
