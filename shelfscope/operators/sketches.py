"""Distinct counts that can be stored and added up: a sketch per day, united over any period.

An exact distinct count of a month cannot be had from those of its days; a sketch of a few kilobytes can. Exact counts stay
the default elsewhere, this is the choice for dashboards and long periods. Nulls are not counted, as in ``COUNT(DISTINCT)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registers of a sketch, as a power of two: 4096 take 4 KB at most.
LOG_REGISTERS = 12


def standard_error(log_registers: int = LOG_REGISTERS) -> float:
    """Relative standard error of an estimate, also of united sketches. Three of them hold 99.7 % of all estimates."""
    return 1.04 / (1 << log_registers) ** 0.5


def distinct_sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], log_registers: int = LOG_REGISTERS) -> DataFrame:
    """One row per group with a sketch ``sketch_<column>`` of each column, to be written and united later.

    A table of many columns is read once and not multiplied; each task sends one sketch per group and column.
    """
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c), F.lit(log_registers)).alias(f"sketch_{c}") for c in columns])


def united(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups: those of a period from those of its days."""
    names = [c for c in sketches.columns if c.startswith("sketch_")]
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in names])


def estimates(sketches: DataFrame) -> DataFrame:
    """Estimated distinct counts ``n_<column>`` in place of the sketches."""
    names = [c for c in sketches.columns if c.startswith("sketch_")]
    others = [F.col(c) for c in sketches.columns if c not in names]
    return sketches.select(*others, *[F.hll_sketch_estimate(c).alias("n_" + c.removeprefix("sketch_")) for c in names])


def within_error(estimate: Column, exact: Column, log_registers: int = LOG_REGISTERS) -> Column:
    """Whether an estimate lies within three standard errors of the exact count, or off by one where that is less."""
    return F.abs(estimate - exact) <= F.greatest(3 * standard_error(log_registers) * exact, F.lit(1))
