"""Scans and date-bounded logs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType, TimestampNTZType, TimestampType


def scan(
    spark: SparkSession, path: str | None = None, fmt: str = "parquet", schema: StructType | None = None, **options
) -> DataFrame:
    """Read a table of any installed format; a directory may be hive-partitioned.

    Sources without a path, such as a table behind JDBC, are described by their options alone.
    """
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def scan_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, sep: str = ","
) -> DataFrame:
    """Read CSV. Without a schema all columns are text: nothing is inferred, so there is one pass only."""
    reader = spark.read.option("header", header).option("sep", sep)
    return (reader.schema(schema) if schema else reader).csv(path)


def literal_column(spark: SparkSession, values: list, name: str) -> DataFrame:
    """A short list of literals as a table of one column, built without a Python task."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def _day(value: str | date) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else datetime.strptime(value, "%Y-%m-%d").date()


def between_days(df: DataFrame, column: str, start: str | date, end: str | date) -> DataFrame:
    """Rows from the start day to the end day, both included.

    The predicate stays on the raw column, so it prunes partitions of a date, integer or ISO-text column and reaches
    the file statistics of a timestamp column. Integers are read as yyyyMMdd; a text may hold a date or a timestamp.
    """
    first, last = _day(start), _day(end)
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        low = F.lit(f"{first} 00:00:00").cast(kind)
        high = F.lit(f"{last + timedelta(days=1)} 00:00:00").cast(kind)
        return df.filter((F.col(column) >= low) & (F.col(column) < high))
    if isinstance(kind, IntegralType):
        return df.filter(F.col(column).between(int(f"{first:%Y%m%d}"), int(f"{last:%Y%m%d}")))
    if kind.typeName() == "date":
        return df.filter(F.col(column).between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    # As text everything on the last day, with or without a time, comes before the day after.
    return df.filter((F.col(column) >= str(first)) & (F.col(column) < str(last + timedelta(days=1))))
