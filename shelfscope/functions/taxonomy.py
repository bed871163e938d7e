"""Parsing of product taxonomy text.

A text holds one or more paths, each ``DD department CCC commodity SSSSS sub-commodity`` with codes of two, three and
five digits. Paths are joined by a comma without blanks; commas inside names are followed by a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that recognise the codes and the markers that replace them.
PATH_SEPARATOR = r"(?<!\s),(?!\s)"
FIRST_DEPARTMENT = (r"^[0-9]{2}\s+", "DEPT: ")
NEXT_DEPARTMENT = (r",[0-9]{2}\s+", " ||DEPT: ")
COMMODITY = (r"\s+[0-9]{3}\s+", " |COMMODITY: ")
SUB_COMMODITY = (r"\s+[0-9]{5}\s+", " |SUB_COMMODITY: ")
CODE_WITH_BLANKS = r"\s*(\d+)\s*"


def labelled(taxonomy: Column) -> Column:
    """The text with every code replaced by the name of its level."""
    text = taxonomy
    for pattern, marker in (FIRST_DEPARTMENT, NEXT_DEPARTMENT, COMMODITY, SUB_COMMODITY):
        text = F.regexp_replace(text, pattern, marker)
    return text


def piped(taxonomy: Column) -> Column:
    """Upper-cased names separated by ``|`` instead of their codes; the first separator is dropped."""
    bars = F.regexp_replace(taxonomy, CODE_WITH_BLANKS, "|")
    return F.upper(F.regexp_replace(bars, r"^([^|]*)[|]", "$1"))


def paths(taxonomy: Column) -> Column:
    """The paths of a text as an array."""
    return F.split(taxonomy, PATH_SEPARATOR)


def sub_category(path: Column) -> Column:
    """Upper-cased name of the lowest level of one path: what follows a code of five digits or more."""
    return F.upper(F.regexp_extract(path, r"\d{5,}\s+(.*)$", 1))


def _level(path: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(path, pattern, 1))


def explode_sub_categories(df: DataFrame, taxonomy: str, path: str = "path", name: str = "sub_category") -> DataFrame:
    """One row per path with its sub-category name. Rows without a text drop out."""
    exploded = df.withColumn(path, F.explode(paths(F.col(taxonomy))))
    return exploded.withColumn(name, sub_category(F.col(path)))


def parse_levels(df: DataFrame, taxonomy: str) -> DataFrame:
    """One row per path with its place in the text and the names of its three levels; a missing level is ''."""
    known = df.filter(F.col(taxonomy).isNotNull())
    split = known.select("*", F.posexplode(F.split(labelled(F.col(taxonomy)), r"[|][|]")).alias("path_no", "__path"))
    path = F.trim(F.col("__path"))
    return split.select(
        *[F.col(c) for c in df.columns],
        F.col("path_no"),
        path.alias("path"),
        _level(path, r"^DEPT:\s*([^|]*)").alias("department"),
        _level(path, r"[|]COMMODITY:\s*([^|]*)").alias("commodity"),
        _level(path, r"[|]SUB_COMMODITY:\s*(.*)$").alias("sub_commodity"),
    )
