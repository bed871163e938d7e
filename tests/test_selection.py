"""Ranks found by counting in ranges, against sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import selection as S

CASES = {
    "one": [3.0],
    "two": [1.0, 2.0],
    "a third equal": [5.0] * 400 + [random.Random(1).gauss(0, 1) for _ in range(801)],
    "all equal": [2.5] * 50,
    "outlier": [*[i / 1000 for i in range(999)], 1e300],
    "both ends": [-1.7e308, 1.7e308, 0.1, 0.2, 0.3, 0.4],
    "infinite": [float("-inf"), float("inf"), float("inf"), 1.0, 2.0, 3.0],
    "neighbours": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1e9],
}


@pytest.mark.parametrize("ranges", [2, 7, 4096])
@pytest.mark.parametrize("name", CASES)
def test_median(spark, monkeypatch, name, ranges):
    monkeypatch.setattr(S, "RANGES", ranges)
    df = spark.createDataFrame([(v,) for v in CASES[name]] + [(None,)], "v double").repartition(3)
    assert S.exact_median(df, "v").first()[0] == statistics.median(CASES[name])


def test_median_of_whole_numbers_and_of_nothing(spark):
    big = [2**60 + i for i in (0, 1, 2, 3, 4, 5, 6)] + [2**60 + 3] * 4 + [-(2**60)]
    df = spark.createDataFrame([(v,) for v in big], "v bigint")
    n = len(big)
    assert S.values_at(df, "v", ((n + 1) // 2, (n + 2) // 2)) == tuple(sorted(big)[i - 1] for i in ((n + 1) // 2, (n + 2) // 2))
    assert S.exact_median(df.filter("v IS NULL"), "v", "middle").first().asDict() == {"middle": None}
    assert S.exact_median(spark.createDataFrame([(None,), (7,)], "v int"), "v").first()[0] == 7.0


@pytest.mark.parametrize("n", [1, 10, 100, 450, 2000])
def test_first_rows_hold_the_first_n_and_few_more(spark, n):
    rng = random.Random(n)
    words = ["".join(rng.choices("abcé", k=rng.randrange(0, 30))) for _ in range(1500)]
    rows = [(w, 1 if i % 3 else rng.randrange(1, 40)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "w string, n int").repartition(4)
    kept = [tuple(r) for r in S.first_rows(df, [-F.col("n"), *S.text_codes(F.col("w"))], n).collect()]
    order = lambda r: (-r[1], r[0].encode())
    assert sorted(kept, key=order)[:n] == sorted(rows, key=order)[:n]
    assert len(kept) <= max(2 * n, 2)


def test_first_rows_keep_all_ties(spark):
    df = spark.createDataFrame([(5,)] * 100 + [(6,)] * 100, "n int")
    assert S.first_rows(df, [F.col("n")], 10).count() == 100


def test_texts_are_ordered_by_their_codes(spark):
    texts = [None, "", "a", "a\x00", "aa", "ab", "abcdef", "abcdefg", "abcdefh", "b", "é", "\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    codes = [tuple(r) for r in df.select(*S.text_codes(F.col("t"))).collect()]
    assert codes == sorted(codes)


def test_no_sort_and_no_range_exchange(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: plans.append(df) or df)
    S.exact_median(spark.range(1000).select(F.rand(1).alias("v")), "v")
    found = S.first_rows(spark.range(1000).select(F.rand(1).alias("v")), [F.col("v")], 10)
    for df in [*plans, found]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort" not in plan
