import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.functions import arrays as A
from shelfscope.functions import columns as C
from shelfscope.functions import taxonomy as T
from shelfscope.functions.inversions import inversions
from shelfscope.functions.language import primary_tag, trigrams


def one(spark, column, *values, schema):
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("code", "padded"),
    [("42", "0" * 11 + "42"), ("4900002890", "0004900002890"), ("1" * 13, "1" * 13), ("1" * 15, "1" * 15), ("ab", "0" * 11 + "ab"), (None, None)],
)
def test_pad_code(spark, code, padded):
    assert one(spark, C.pad_code(F.col("c")), code, schema="c string") == padded


def test_money(spark):
    cents = lambda m: one(spark, C.rounded_dollars(F.col("m")), m, schema="m bigint")
    assert [cents(m) for m in (1_005_000, 1_004_999, 0, -1_005_000, 10**18)] == [1.01, 1.0, 0.0, -1.01, 1e12]
    assert one(spark, C.dollars(F.col("m")), 1_500_000, schema="m bigint") == 1.5


def test_ratios_by_zero_are_null(spark):
    assert one(spark, C.ratio(F.col("a"), F.col("b")), 1, 0, schema="a int, b int") is None
    assert one(spark, C.percent_of(F.col("a"), F.col("b")), 1, 4, schema="a int, b int") == 25.0


def test_keys(spark):
    assert one(spark, C.concat_key(F.col("a"), F.col("b")), "014", 7, schema="a string, b int") == "0147"
    assert one(spark, C.concat_key(F.col("a"), F.col("b")), "014", None, schema="a string, b int") is None
    assert one(spark, C.sheet_safe(F.col("a")), "007", schema="a string") == "'007"


@pytest.mark.parametrize("day", [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(8)])
def test_recent_friday(spark, day):
    friday = day - dt.timedelta(days=(day.weekday() - 4) % 7)
    assert one(spark, C.recent_friday(F.col("d")), day, schema="d date") == friday
    assert one(spark, C.weeks_before(F.col("d")), day, schema="d date") == day - dt.timedelta(days=56)


def test_attribution_days(spark):
    day = dt.date(2024, 3, 1)
    df = spark.createDataFrame([(day,)], "d date")
    got = df.select(C.earliest_exposure(F.col("d")), C.latest_exposure(F.col("d")), C.latest_conversion(F.col("d"))).first()
    assert tuple(got) == (dt.date(2024, 2, 27), dt.date(2024, 3, 4), dt.date(2024, 3, 15))


# Three paths: a name with a comma, a second one in the same commodity, and a bare department.
TAXONOMY = "63 Bicycles 512 Lighting 81040 Dynamo hubs, wired,63 Bicycles 512 Lighting 81077 Reflectors,70 Camping"


def test_taxonomy_sub_categories(spark, rows):
    df = spark.createDataFrame([("x", TAXONOMY), ("y", None), ("z", "without codes")], "sku string, taxonomy string")
    found = rows(T.explode_sub_categories(df, "taxonomy"), "sku", "sub_category")
    assert found == [("x", ""), ("x", "DYNAMO HUBS, WIRED"), ("x", "REFLECTORS"), ("z", "")]


def test_taxonomy_levels_of_each_path(spark, rows):
    df = spark.createDataFrame([("x", TAXONOMY), ("y", None), ("z", "without codes")], "sku string, taxonomy string")
    levels = rows(T.parse_levels(df, "taxonomy"), "sku", "path_no", "department", "commodity", "sub_commodity")
    assert levels == [
        ("x", 0, "Bicycles", "Lighting", "Dynamo hubs, wired"),
        ("x", 1, "Bicycles", "Lighting", "Reflectors"),
        ("x", 2, "Camping", "", ""),
        ("z", 0, "", "", ""),
    ]


def test_taxonomy_texts_without_codes(spark):
    named, barred = spark.createDataFrame([(TAXONOMY,)], "t string").select(T.labelled(F.col("t")), T.piped(F.col("t"))).first()
    lighting = "DEPT: Bicycles |COMMODITY: Lighting |SUB_COMMODITY: "
    assert named.split(" ||") == [lighting + "Dynamo hubs, wired", lighting + "Reflectors", "DEPT: Camping"]
    assert barred == "BICYCLES|LIGHTING|DYNAMO HUBS, WIRED,|BICYCLES|LIGHTING|REFLECTORS,|CAMPING"


def test_taxonomy_with_a_missing_level(spark, rows):
    df = spark.createDataFrame([("1", "19 Records 40551 Jazz")], "sku string, taxonomy string")
    assert rows(T.parse_levels(df, "taxonomy"), "department", "commodity", "sub_commodity") == [("Records", "", "Jazz")]


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c", "a", "x"], [1, 0, 1], [2.0, 9.0, 2.0])], "a array<string>, b array<string>, f array<int>, s array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        A.same_set(a, F.reverse(F.concat(a, a))), A.same_set(a, b), A.select_where(a, F.col("f"), 1),
        A.common_in_first(a, b, 1), A.common_in_first(a, b, 3), A.sorted_pairs(F.col("s"), a)["item"],
    ).first()
    assert tuple(got) == (True, False, ["a", "c"], 0, 2, ["b", "c", "a"])


def test_trigrams_and_tags(spark):
    texts = ["It's a CAT, 7", "", None, "--", "Ünï"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(trigrams(F.col("t"))).collect()]
    assert found == [[" it", "it ", " s ", " a ", " ca", "cat", "at "], [], None, [], [" ün", "ünï", "nï "]]
    tags = spark.createDataFrame([("en-US",), ("FR_ca",), ("de",), ("",), (None,)], "t string").select(primary_tag(F.col("t")))
    assert [r[0] for r in tags.collect()] == ["en", "fr", "de", "", None]


@pytest.mark.parametrize("seed", range(4))
def test_inversions_of_many_lists(seed):
    rng = random.Random(seed)
    lists = [[rng.randrange(rng.choice([2, 50])) for _ in range(rng.choice([0, 1, 2, 3, 17, 64, 65]))] for _ in range(30)]
    starts = np.cumsum([0] + [len(v) for v in lists])
    want = [sum(a > b for a, b in itertools.combinations(v, 2)) for v in lists]
    assert inversions(np.array(sum(lists, []), dtype="int64"), starts).tolist() == want
    assert inversions(np.zeros(0, dtype="int64"), np.zeros(1, dtype="int64")).tolist() == []
