"""Writers: materialised stages and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def dated_path(base: str, start: str, end: str) -> str:
    """Path of a dataset for a period."""
    return f"{base}_{start}_{end}"


def materialize(
    df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write a stage and read it back, so that later steps start from the files. Fails if the path exists.

    Rows for a partitioned stage are gathered by partition first, so that not every task writes a file to every one of
    them; a partition with a large share of the rows is spread over several tasks.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.mode(mode).format(fmt).partitionBy(*partition_by).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Write ``df`` over the partitions it has rows for, and leave the files of all others as they are.

    For re-runs of a day or a week. The first call creates the dataset. A partition of which no row is left is not emptied:
    nothing in ``df`` names it.
    """
    rows = df.hint("rebalance", *partition_by)
    writer = rows.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def export_csv(
    df: DataFrame, path: str, sep: str = ",", header: bool = True, single_file: bool = False, mode: str = "errorifexists"
) -> None:
    """Export as delimited text. ``single_file`` sends all rows through one task: for reports, not for logs."""
    rows = df.coalesce(1) if single_file else df
    rows.write.mode(mode).option("sep", sep).option("header", header).csv(path)


def export_pipe(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export as pipe-delimited text without a header, one file per task."""
    export_csv(df, path, sep="|", header=False, mode=mode)
