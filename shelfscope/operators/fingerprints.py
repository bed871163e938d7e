"""Distinct rows of wide tables by fingerprint.

Making wide rows distinct shuffles every column of every row, although hardly any row occurs twice. Here only a
fingerprint of 128 bits is shuffled for each row. Fingerprints that occur more than once go into a bitmap of bounded size,
which is sent to all tasks. A row whose bit is not set is the only one of its kind and stays where it is; the others, real
copies and what happens to share a bit with them, are compared as whole rows. So no result depends on a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.session import cut_lineage

# Bits of the bitmap for each fingerprint that repeats, and its smallest and largest size: 4 KB and 64 MB.
BITS_PER_REPEAT = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 29
# Bits in one row of the bitmap, as Spark's bitmap functions have it.
ROW_BITS = 1 << 15
# Keys of fixed width up to this many bytes are no wider than what would replace them.
NARROW_BYTES = 32
_WIDTH = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}

_FIRST, _SECOND, _AGAIN = "__first_hash", "__second_hash", "__again"


def is_narrow(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the columns have a fixed width that a fingerprint would not undercut."""
    widths = [_WIDTH.get(df.schema[c].dataType.typeName()) for c in columns]
    return None not in widths and sum(widths) <= NARROW_BYTES


def fingerprint(columns: Sequence[str], bits: int = 64) -> tuple[Column, Column]:
    """Two hashes of 64 bits over the columns; nulls are told apart by place. ``bits`` shortens both, for tests."""
    parts = [p for c in columns for p in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *reversed(parts))
    return hashes if bits == 64 else tuple(F.pmod(h, F.lit(1 << bits)) for h in hashes)


def _bit(bits: int) -> Column:
    """The place in the bitmap of a row's fingerprint, from 0."""
    return F.pmod(F.xxhash64(_FIRST, _SECOND), F.lit(bits))


def flag_repeats(df: DataFrame, columns: Sequence[str], hash_bits: int = 64, most_bits: int = MOST_BITS) -> DataFrame:
    """Add ``__again``: false for rows that certainly occur once in ``columns``, true for all copies and few others.

    ``df`` is read twice, the second time by whatever reads the result.
    """
    first, second = fingerprint(columns, hash_bits)
    marked = df.withColumns({_FIRST: first, _SECOND: second})
    counted = marked.select(_FIRST, _SECOND).groupBy(_FIRST, _SECOND).agg(F.count(F.lit(1)).alias("__n"))
    repeats = cut_lineage(counted.filter("__n > 1").select(_FIRST, _SECOND))
    wanted = max(LEAST_BITS, BITS_PER_REPEAT * repeats.count())
    bits = min(most_bits, 1 << (wanted - 1).bit_length())
    # bits / ROW_BITS rows of 4 KB: at most 64 MB.
    place = repeats.select(_bit(bits).alias("__bit"))
    bitmap = place.groupBy(F.floor(F.col("__bit") / ROW_BITS).alias("__row")).agg(F.bitmap_construct_agg(F.pmod("__bit", F.lit(ROW_BITS))).alias("__map"))
    joined = marked.withColumn("__bit", _bit(bits)).withColumn("__row", F.floor(F.col("__bit") / ROW_BITS)).join(F.broadcast(bitmap), "__row", "left")
    within = F.pmod("__bit", F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("__map", (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    again = F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(_AGAIN, again).select(*[F.col(f"`{c}`") for c in df.columns], _AGAIN)


def distinct_rows(df: DataFrame, hash_bits: int = 64) -> DataFrame:
    """The rows of ``df``, each once. Equality is that of ``distinct``: nulls are equal to each other."""
    if is_narrow(df, df.columns):
        return df.distinct()
    flagged = flag_repeats(df, df.columns, hash_bits)
    once = flagged.filter(~F.col(_AGAIN)).drop(_AGAIN)
    return once.unionByName(flagged.filter(_AGAIN).drop(_AGAIN).distinct())


def count_and_distinct(df: DataFrame, columns: Sequence[str], hash_bits: int = 64) -> DataFrame:
    """One row: rows, distinct keys and the rows beyond the first of each key."""
    if is_narrow(df, columns):
        per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__rows")).select(F.lit(1).alias("__keys"), "__rows")
    else:
        keys = [F.col(f"`{c}`") for c in columns]
        flagged = flag_repeats(df.select(*keys), columns, hash_bits)
        once = flagged.filter(~F.col(_AGAIN)).agg(F.count(F.lit(1)).alias("__keys"), F.count(F.lit(1)).alias("__rows"))
        more = flagged.filter(_AGAIN).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        per_key = once.unionByName(more.agg(F.count(F.lit(1)).alias("__keys"), F.sum("__rows").alias("__rows")))
    rows, distinct = F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.sum("__keys").cast("bigint"), F.lit(0))
    return per_key.agg(rows.alias("n_rows"), distinct.alias("n_distinct"), (rows - distinct).alias("n_extra"))
