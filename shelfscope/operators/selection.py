"""Values and rows at a rank without sorting the table.

Rows are counted in a few thousand ranges of equal width, and the range that holds the rank is cut again, until it is small
enough. Each round is one pass over a narrow column that tasks reduce to a row per range; nothing is sorted or shuffled by
range, and equal values cost nothing however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.session import cut_lineage

# Ranges that a round counts; so many rows come back to the driver.
RANGES = 4096
# Characters of a text that go into one number: six bytes are exact in a double.
CODE_BYTES = 6
CODES_OF_A_TEXT = 4


@dataclass
class _Range:
    n: int
    low: float
    high: float


def _is_special(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _ranges(df: DataFrame, value: str, low: float | None, high: float | None) -> list[_Range]:
    """Filled ranges in ascending order. Below and above all others stand the infinities, and NaN last."""
    x = F.col(value).cast("double")
    # Halves cannot overflow. The number of a range never falls as the value grows, which is all that matters.
    at = F.try_divide((x / 2 - F.lit(low) / 2) * RANGES, F.lit(high) / 2 - F.lit(low) / 2) if low is not None else F.lit(0.0)
    slot = F.when(F.isnan(x), RANGES + 2).when(x == float("inf"), RANGES + 1).when(x == float("-inf"), -1)
    slot = slot.otherwise(F.coalesce(F.floor(at), F.lit(0)))
    counted = df.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return [_Range(r["n"], r["low"], r["high"]) for r in sorted(counted.collect(), key=lambda r: r["__slot"])]


def _ends(df: DataFrame, value: str) -> tuple[float | None, float | None]:
    x = F.col(value).cast("double")
    finite = F.when(~_is_special(x), x)
    return tuple(df.agg(F.min(finite), F.max(finite)).first())


def _settled(r: _Range) -> bool:
    return r.low == r.high or (r.low != r.low and r.high != r.high)


def _holding(ranges: list[_Range], rank: int) -> tuple[int, int]:
    """The place of the range that holds a rank, counted from 1, and the rows before it."""
    before = 0
    for i, r in enumerate(ranges):
        if before + r.n >= rank:
            return i, before
        before += r.n
    raise ValueError("rank beyond the rows")


def values_at(df: DataFrame, value: str, ranks: tuple[int, int]) -> tuple:
    """The values at two ranks, equal or next to each other, of a column without nulls; its type must be numeric."""
    first, second = ranks
    low, high = _ends(df, value)
    while True:
        ranges = _ranges(df, value, low, high)
        i, before = _holding(ranges, first)
        j, _ = _holding(ranges, second)
        if i != j:
            # Neighbours in rank: the last value of one range and the first of the next.
            return ranges[i].high, ranges[j].low
        held = ranges[i]
        if _settled(held):
            return held.low, held.low
        if float(held.low) == float(held.high) or (float(held.low), float(held.high)) == (low, high):
            # Whole numbers that a double does not tell apart; few can lie so close.
            near = df.filter(F.col(value).between(held.low, held.high)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
            ranges = [_Range(r["n"], r[value], r[value]) for r in sorted(near.collect(), key=lambda r: r[value])]
            return ranges[_holding(ranges, first - before)[0]].low, ranges[_holding(ranges, second - before)[0]].low
        df = df.filter(F.col(value).between(held.low, held.high))
        first, second, low, high = first - before, second - before, float(held.low), float(held.high)


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """Exact median of a numeric column in one row, ignoring nulls; null where there is nothing else."""
    known = cut_lineage(df.filter(F.col(value).isNotNull()).select(value))
    n = known.count()
    middle = None
    if n:
        low, high = values_at(known, value, ((n + 1) // 2, (n + 2) // 2))
        middle = (float(low) + float(high)) / 2 if not isinstance(low, int) else (low + high) / 2
    return df.sparkSession.createDataFrame([(middle,)], f"`{name}` double")


def text_codes(text: Column) -> list[Column]:
    """Numbers that order texts by their first bytes; each goes on where the one before ends. Nulls come first."""
    data = text.cast("binary")
    part = lambda i: F.rpad(F.hex(F.substring(data, 1 + i * CODE_BYTES, CODE_BYTES)), 2 * CODE_BYTES, "0")
    return [F.coalesce(F.conv(part(i), 16, 10).cast("double"), F.lit(-1.0)) for i in range(CODES_OF_A_TEXT)]


def first_rows(df: DataFrame, codes: Sequence[Column], n: int) -> DataFrame:
    """Rows of ``df`` among which are its first ``n`` by the codes: hardly more than twice as many, if codes tell rows apart.

    ``codes`` are numeric, never null, and in ascending order. Where they tie all ties are kept, so any finer order may follow.
    """
    names = [f"__code{i}" for i in range(len(codes))]
    coded = df.withColumns({name: code.cast("double") for name, code in zip(names, codes)})
    narrow = cut_lineage(coded.select(*names))
    kept, tied, left = F.lit(False), F.lit(True), n
    for name in names:
        part = narrow.filter(tied)
        low, high = _ends(part, name)
        while True:
            ranges = _ranges(part, name, low, high)
            if sum(r.n for r in ranges) <= max(left, n):
                return coded.filter(kept | tied).drop(*names)
            i, before = _holding(ranges, left)
            held, left = ranges[i], left - before
            kept = kept | (tied & (F.col(name) < held.low))
            if held.n <= n:
                return coded.filter(kept | (tied & F.col(name).between(held.low, held.high))).drop(*names)
            if _settled(held) or (held.low, held.high) == (low, high):
                tied = tied & F.col(name).between(held.low, held.high)
                break
            part, low, high = part.filter(F.col(name).between(held.low, held.high)), held.low, held.high
    return coded.filter(kept | tied).drop(*names)
