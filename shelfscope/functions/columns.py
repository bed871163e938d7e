"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_LENGTH = 13
MICROS_PER_DOLLAR = 1_000_000


def pad_code(code: Column, length: int = CODE_LENGTH) -> Column:
    """Left-pad a product code with zeros. Codes that are longer already are left whole, not cut."""
    return F.when(F.length(code) <= length, F.lpad(code, length, "0")).otherwise(code)


def sheet_safe(code: Column) -> Column:
    """Prefix an apostrophe so that a spreadsheet keeps the leading zeros of a code."""
    return F.concat(F.lit("'"), code)


def concat_key(*parts: Column) -> Column:
    """One key from several columns; null if any part is null."""
    return F.concat(*[p.cast("string") for p in parts])


def dollars(micros: Column) -> Column:
    """Micro-dollars as dollars."""
    return micros.cast("double") / F.lit(float(MICROS_PER_DOLLAR))


def rounded_dollars(micros: Column) -> Column:
    """A bigint sum of micro-dollars as dollars rounded half up to cents.

    Adding integers and rounding as a decimal gives the same cents whatever the order of the addition.
    """
    exact = micros.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    return F.round(exact, 2).cast("double")


def percent_of(part: Column, whole: Column) -> Column:
    """Percentage, null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def ratio(part: Column, whole: Column) -> Column:
    """Ratio, null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def earliest_exposure(start: Column) -> Column:
    """First transaction day that an exposure window looks at: three days before its start."""
    return F.date_sub(start, 3)


def latest_exposure(end: Column) -> Column:
    """Last transaction day of the exposure window: three days after its end."""
    return F.date_add(end, 3)


def latest_conversion(end: Column) -> Column:
    """Last day on which a conversion counts: fourteen days after the end."""
    return F.date_add(end, 14)


def recent_friday(day: Column) -> Column:
    """The Friday on or before a day."""
    return F.next_day(F.date_sub(day, 7), "FRI")


def weeks_before(day: Column, weeks: int = 8) -> Column:
    """The day that lies a number of weeks earlier."""
    return F.date_sub(day, 7 * weeks)
