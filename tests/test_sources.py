import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shelfscope import schemas
from shelfscope.plans.inventory import period_from_daily, store_daily
from shelfscope.session import CHECKPOINT_SETTING, scratch_path, shared_folder
from shelfscope.sources import readers, writers
from shelfscope.sources.workspace import Dimension, Log, Workspace


def test_csv_without_a_schema_is_text(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.export_csv(spark.createDataFrame([("007", 1.5)], "code string, v double"), path, single_file=True)
    back = readers.scan_csv(spark, path)
    assert [f.dataType.simpleString() for f in back.schema] == ["string", "string"]
    assert back.first() == ("007", "1.5")
    typed = readers.scan_csv(spark, path, "code string, v double")
    assert typed.first() == ("007", 1.5)


def test_pipe_export_has_no_header(spark, tmp_path):
    path = tmp_path / "p"
    writers.export_pipe(spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int").coalesce(1), str(path))
    assert next(path.glob("part-*")).read_text().split() == ["a|1", "b|2"]


def test_materialize_refuses_to_overwrite(spark, tmp_path):
    path = writers.dated_path(str(tmp_path / "stage"), "2024-01-01", "2024-01-31")
    assert path.endswith("stage_2024-01-01_2024-01-31")
    assert writers.materialize(spark.range(3), path).count() == 3
    with pytest.raises(AnalysisException):
        writers.materialize(spark.range(3), path)
    assert writers.materialize(spark.range(5), path, mode="overwrite").count() == 5


@pytest.fixture(scope="module")
def log(spark):
    days = [(i, f"2024-01-{i:02d}") for i in range(1, 11)]
    return spark.createDataFrame(days, "id int, day string").select(
        "id", "day", F.to_date("day").alias("date"), F.expr("cast(concat(day, ' 23:59:59') as timestamp_ntz)").alias("ts")
    )


@pytest.mark.parametrize("column", ["day", "date", "ts"])
def test_both_days_are_included(log, column):
    kept = readers.between_days(log, column, "2024-01-03", dt.date(2024, 1, 5))
    assert sorted(r.id for r in kept.collect()) == [3, 4, 5]


def test_date_filter_prunes_partitions(spark, log, tmp_path):
    path = str(tmp_path / "log")
    writers.materialize(log.select("id", "day"), path, partition_by=["day"])
    stored = readers.scan(spark, path, schema=spark.read.parquet(path).schema)
    kept = readers.between_days(stored, "day", "2024-01-03", "2024-01-05")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-01-03" in filters and "2024-01-05" in filters
    assert kept.count() == 3


def test_partitioned_stage_has_few_files(spark, tmp_path):
    rows = spark.range(0, 800, 1, 8).withColumn("day", F.concat(F.lit("d"), F.col("id") % 4))
    writers.materialize(rows, str(tmp_path / "s"), partition_by=["day"])
    assert len(list((tmp_path / "s").glob("day=*/part-*"))) == 4


def test_timestamp_filter_is_pushed(spark, log, tmp_path):
    path = str(tmp_path / "ts")
    writers.materialize(log.select("id", "ts"), path)
    kept = readers.between_days(readers.scan(spark, path), "ts", "2024-01-03", "2024-01-05")
    pushed = kept._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_literal_column(spark, rows):
    assert rows(readers.literal_column(spark, ["b", "a"], "x")) == [("a",), ("b",)]


def test_workspace(spark, log, rows):
    events = log.select("id", "day", F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("kind"))
    names = spark.createDataFrame([(2, "two"), (4, "four")], "key int, name string")
    space = Workspace({"ads": Log(events, "day", "kind", {"CLICK": "click"})}, {"n": Dimension(names, "key", "id")})
    clicks = space.log("ads", "2024-01-02", "2024-01-06", "CLICK")
    assert rows(space.join_dimensions(clicks, "n"), "id", "name") == [(2, "two"), (4, "four"), (6, None)]
    assert rows(space.join_dimensions(clicks, ["n"], how="inner"), "id") == [(2,), (4,)]
    sold = space.transactions("2024-01-01", "2024-01-10", ["n"], {"late": F.col("id") > 2}, log="ads")
    assert rows(sold, "id") == [(4,)]
    assert space.clickstream("2024-01-01", "2024-01-10", ["n"], log="ads").count() == 10
    assert space.dimension("n").count() == 2


def test_conform_casts_text_and_reports_missing_columns(spark):
    raw = spark.createDataFrame([("c1", "2024-01-01", "0", "x")], "id string, start_date string, budget string, status string")
    campaign = schemas.conform(raw, "campaign")
    assert campaign.schema == schemas.schema_of("campaign")
    assert campaign.first() == ("c1", dt.date(2024, 1, 1), 0.0, "x")
    with pytest.raises(ValueError, match="status"):
        schemas.conform(raw.drop("status"), "campaign")
    for table in schemas.TABLES:
        assert len(schemas.schema_of(table)) > 0


def session_stub(master, setting=None, own=None):
    """A session with as much as the shared folder looks at."""
    state = {"dir": own}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d)
    )
    conf = SimpleNamespace(get=lambda key, default: setting if key == CHECKPOINT_SETTING else default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_shared_folder_follows_the_setting():
    named = session_stub("yarn", "s3://shared/cp")
    assert shared_folder(named) == "s3://shared/cp" == named.sparkContext.getCheckpointDir()
    assert scratch_path(named, "x").startswith("s3://shared/cp/") and scratch_path(named, "x") != scratch_path(named, "x")
    assert shared_folder(session_stub("yarn", own="hdfs:///cp")) == "hdfs:///cp"
    with pytest.raises(RuntimeError, match=CHECKPOINT_SETTING):
        shared_folder(session_stub("yarn"))
    local = session_stub("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.sparkContext.getCheckpointDir()


def test_days_of_integers_texts_and_datetimes(spark):
    day = dt.datetime(2023, 10, 31, 8, 30)
    numbers = spark.createDataFrame([(20231030,), (20231031,), (20231101,), (None,)], "d int")
    assert [r.d for r in readers.between_days(numbers, "d", "2023-10-31", day).collect()] == [20231031]
    texts = spark.createDataFrame([("2023-10-30 23:59:59",), ("2023-10-31",), ("2023-10-31 08:00:00",), ("2023-11-01",), (None,)], "d string")
    assert [r.d for r in readers.between_days(texts, "d", day, day).collect()] == ["2023-10-31", "2023-10-31 08:00:00"]


def test_a_day_is_run_again_alone(spark, tmp_path, rows):
    """Files of other days stay as they are, whatever the session's own setting; merged days equal the whole log."""
    path = str(tmp_path / "daily")
    log = spark.range(1000).selectExpr("date_add(DATE'2024-01-01', CAST(id % 5 AS int)) AS day", "id % 3 AS k", "id AS v", "id")
    store_daily(log, path, "day", ["k"], ["v"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").glob("day=*/*.parquet")}
    changed = log.filter("day = DATE'2024-01-03' AND id % 2 = 0").withColumn("v", F.lit(1).cast("bigint"))
    daily = store_daily(changed, path, "day", ["k"], ["v"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "daily").glob("day=*/*.parquet")}
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.parent.name for p in before.keys() - same} == {"day=2024-01-03"}
    whole = log.filter("day <> DATE'2024-01-03'").unionByName(changed)
    merged = period_from_daily(daily, "day", ["k"], "2024-01-01", "2024-01-31")
    assert rows(merged, "k", "n_rows", "sum_v") == rows(whole.groupBy("k").agg(F.count("*"), F.sum("v")))
    part = period_from_daily(daily, "day", ["k"], "2024-01-02", "2024-01-03")
    assert rows(part, "k", "n_rows", "sum_v") == rows(whole.filter("day BETWEEN DATE'2024-01-02' AND DATE'2024-01-03'").groupBy("k").agg(F.count("*"), F.sum("v")))
