"""A workspace names the logs and dimensions of a deployment, so that analyses ask for them by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.relational import with_rules
from shelfscope.sources.readers import between_days


@dataclass(frozen=True)
class Log:
    """A dated event log. ``types`` maps a log type to its value in ``type_column``."""

    table: DataFrame
    date_column: str
    type_column: str | None = None
    types: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Dimension:
    """A lookup table: ``key`` in it, ``foreign_key`` in the tables that refer to it."""

    table: DataFrame
    key: str
    foreign_key: str


@dataclass
class Workspace:
    """Logs and dimensions by name."""

    logs: dict[str, Log] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)

    def dimension(self, name: str) -> DataFrame:
        return self.dimensions[name].table

    def log(self, name: str, start: str | date, end: str | date, log_type: str | None = None) -> DataFrame:
        """Rows of a log from the start day to the end day, both included, optionally of one log type."""
        source = self.logs[name]
        rows = between_days(source.table, source.date_column, start, end)
        if log_type is None:
            return rows
        return rows.filter(F.col(source.type_column) == source.types.get(log_type, log_type))

    def join_dimensions(self, df: DataFrame, names: str | Sequence[str], how: str = "left") -> DataFrame:
        """Join named dimensions on their keys.

        Left outer by default: a row whose key has no entry is kept, with nulls. The planner broadcasts a dimension
        by its measured size.
        """
        for name in [names] if isinstance(names, str) else names:
            dim = self.dimensions[name]
            if dim.key == dim.foreign_key:
                df = df.join(dim.table, dim.key, how)
            else:
                df = df.join(dim.table, df[dim.foreign_key] == dim.table[dim.key], how)
        return df

    def transactions(
        self,
        start: str | date,
        end: str | date,
        join_with: Sequence[str] = (),
        rules: dict[str, Column] | Sequence[Column] = (),
        log: str = "transactions",
        how: str = "inner",
    ) -> DataFrame:
        """Dated transactions with their attribute tables, restricted to rows that satisfy every rule."""
        return with_rules(self.join_dimensions(self.log(log, start, end), join_with, how), rules)

    def clickstream(
        self,
        start: str | date,
        end: str | date,
        join_with: Sequence[str] = (),
        log: str = "clickstream",
        how: str = "left",
    ) -> DataFrame:
        """Dated clickstream records with the tables they refer to."""
        return self.join_dimensions(self.log(log, start, end), join_with, how)
