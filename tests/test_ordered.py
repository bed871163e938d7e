"""Ranks and totals: the sliced plan must equal the plain window, row for row."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, another key is null, values repeat."""
    rng = random.Random(5)
    keys = ["hot"] * 60 + [None] * 30 + [f"k{i % 25}" for i in range(90)]
    rows = [(k, rng.randint(1, 6), i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "key string, value int, id int").repartition(4)


@pytest.mark.parametrize("hot_rows", [10, 40])
def test_sliced_row_number_equals_window(skewed, rows, hot_rows):
    order = [F.col("value").desc(), F.col("id").asc()]
    plain = O.rank_rows(skewed, ["key"], order, "r", hot_rows=10**9)
    sliced = O.rank_rows(skewed, ["key"], order, "r", hot_rows=hot_rows)
    assert rows(sliced, "key", "value", "id", "r") == rows(plain, "key", "value", "id", "r")
    assert sliced.schema["r"].dataType.simpleString() == "bigint"


def test_slices_follow_rows_not_the_limit_of_a_group():
    # Small slices up to the tasks of a shuffle, then as many as the rows need.
    assert [O._slices(n, 2000, 16) for n in (2001, 20_000, 600_000, 36_000_000, 216_000_000)] == [2, 10, 16, 72, 432]
    assert O._slices(216_000_000, O.HOT_GROUP_ROWS, 16) == 11 and O._slices(10**12, 2000, 16) == O.MOST_SLICES


def test_sliced_rank_keeps_ties(skewed, rows):
    for keys in (["key"], []):
        plain = O.rank_with_ties(skewed, keys, "value", "r", ascending=False, hot_rows=10**9)
        sliced = O.rank_with_ties(skewed, keys, "value", "r", ascending=False, hot_rows=4)
        assert rows(sliced, "id", "r") == rows(plain, "id", "r")


def test_several_ranks_share_one_shuffle(skewed, rows):
    orders = {"a": [F.col("value").desc(), F.col("id").asc()], "b": [F.col("a").desc()]}
    plain = O.rank_rows_by(skewed, ["key"], orders, hot_rows=10**9)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    sliced = O.rank_rows_by(skewed, ["key"], orders, hot_rows=9)
    assert rows(sliced, "id", "a", "b") == rows(plain, "id", "a", "b")


def test_long_cut_per_group(skewed, rows, monkeypatch):
    order = [F.col("value").asc(), F.col("id").asc()]
    short = rows(O.top_k_per_group(skewed, ["key"], order, 5, "place"), "id", "place")
    monkeypatch.setattr(O, "GROUP_LIMIT", 2)
    assert rows(O.top_k_per_group(skewed, ["key"], order, 5, "place"), "id", "place") == short


def test_sliced_total_over_the_whole_table(skewed, rows):
    order = [F.col("value").asc(), F.col("id").asc()]
    plain = O.running_total(skewed, [], order, "value", "t", hot_rows=10**9)
    assert rows(O.running_total(skewed, [], order, "value", "t", hot_rows=9), "id", "t") == rows(plain, "id", "t")


def test_no_group_is_large_leaves_one_window(skewed):
    ranked = O.rank_rows(skewed, ["key"], [F.col("id").asc()], "r", hot_rows=1000)
    assert "__slice" not in ranked._jdf.queryExecution().toString()


def test_large_input_is_probed_and_small_is_not(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(O, "cut_lineage", lambda df: calls.append(1) or df)
    small = spark.range(100).withColumn("k", F.col("id") % 3)
    O.rank_rows(small, ["k"], [F.col("id").asc()], "r")
    assert calls == []
    monkeypatch.setattr(O, "ONE_TASK_BYTES", 10)
    O.rank_rows(small, ["k"], [F.col("id").asc()], "r")
    assert calls == [1]


def test_top_k_limits_groups_before_the_shuffle(skewed, rows):
    top = O.top_k_per_group(skewed, ["key"], [F.col("value").desc(), F.col("id").asc()], 2, "place")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("2, Final") < plan.index("Exchange hashpartitioning") < plan.index("2, Partial")
    best = {}
    for k, v, i in sorted(rows(skewed), key=lambda r: (-r[1], r[2])):
        best.setdefault(k, []).append(i)
    expected = {(k, i, p) for k, ids in best.items() for p, i in enumerate(ids[:2], 1)}
    assert set(rows(top, "key", "id", "place")) == expected


def test_pick_one_per_key(skewed, rows):
    picked = O.pick_one_per_key(skewed, ["key"], [F.col("value").asc(), F.col("id").asc()])
    assert picked.count() == skewed.select("key").distinct().count()


def test_histogram_closes_the_last_bin(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in range(31)] + [(None,)], "v double")
    bins = dict(rows(O.equal_width_histogram(df, "v", 30)))
    assert bins[29] == 2 and sum(bins.values()) == 31
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert rows(O.equal_width_histogram(same, "v", 30)) == [(15, 2)]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 5), ("c", "x", 0)], "g string, t string, n int")
    shares = O.share_of_total(df, ["g"], "n", "total", "percent").collect()
    assert {(r.g, r.t): r.percent for r in shares} == {
        ("a", "x"): 33.3, ("a", "y"): 66.7, ("b", "x"): 100.0, ("c", "x"): None,
    }


def test_samples(spark, rows):
    df = spark.range(500)
    first, again = O.fixed_sample(df, ["id"], 50, 2024), O.fixed_sample(df.repartition(7), ["id"], 50, 2024)
    assert rows(first) == rows(again) and len(set(rows(first))) == 50
    assert rows(first) != rows(O.fixed_sample(df, ["id"], 50, 1))
    drawn = rows(O.fraction_sample(df, ["id"], 0.5, 1))
    assert 150 < len(drawn) < 350 and len(set(drawn)) < len(drawn)
    assert drawn == rows(O.fraction_sample(df.repartition(7), ["id"], 0.5, 1)) != rows(O.fraction_sample(df, ["id"], 0.5, 2))
