"""Ranks and running totals whose largest group may be a large share of the table.

A window sorts each group in one task. That is the right plan while groups fit a task, and the wrong one when a
single key owns a third of the rows or when there is no key at all. The functions here use the plain window where
the input is small or no group is large, and otherwise cut the large groups into ordered slices: a range shuffle on
(keys, order) spreads a group over many tasks, every slice is ranked by itself, and the total of the slices before
it is added. The result is the same row for row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shelfscope.operators.selection import first_rows
from shelfscope.session import cut_lineage, input_bytes, read_bytes

# A group above this many rows is split over several tasks.
HOT_GROUP_ROWS = 20_000_000
# Most slices that large groups are cut into; beyond it slices grow.
MOST_SLICES = 10_000
# Rows that a slice should have at least, once there are slices for every task of a shuffle: each slice costs the driver a
# sample for its bounds and the results of its tasks.
SLICE_ROWS = 500_000
# Files that one task should sort or group the rows of, where the session's shuffles have too few tasks for the input. Rows take
# many times the bytes of their files, and a task that ranks twice holds them in several sorts.
TASK_BYTES = 4 << 20
# Keys of large groups are broadcast while there are at most this many; there is one per HOT_GROUP_ROWS rows at most.
BROADCAST_GROUPS = 100_000
# Inputs up to this size are never probed for large groups: one task could sort all of it.
ONE_TASK_BYTES = 256 << 20
# Longest cut per group that Spark applies before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Tasks that share the merging of a short cut of a whole table, before the last one merges theirs.
MERGE_TASKS = 64

_SLICE, _AMOUNT, _BEFORE = "__slice", "__amount", "__before"


def _window(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on ``keys`` that keeps the left names only."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def deal(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle ``df`` by ``keys`` into a part for each ``TASK_BYTES`` of its files, if that is more than the session's shuffles have.

    Steps that need these keys together stay in the parts, so their tasks do not grow with the input. Otherwise ``df`` as it is.
    """
    wanted = -(-(read_bytes(df) or 0) // TASK_BYTES)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@dataclass(frozen=True)
class _Step:
    """One running figure: its name, its order, what a row adds to it and its value within one window.

    ``total`` adds up the rows of a slice, and ``after`` puts the total of earlier slices before a value; null if there is none.
    """

    name: str
    order: list[Column]
    amount: Column
    local: Callable[[WindowSpec], Column]
    total: Callable[[Column | str], Column] = F.sum
    after: Callable[[Column, Column], Column] = lambda value, before: value + F.coalesce(before, F.lit(0))

    def plain(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn(self.name, self.local(_window(keys, self.order)))

    def sliced(self, df: DataFrame, keys: list[str], slices: int) -> DataFrame:
        """Work within range slices, then shift every slice by what lies before it."""
        ranges = [*[F.col(k) for k in keys], *self.order]
        # The checkpoint fixes which slice a row is in: both readers below must agree, also after a lost executor.
        cut = cut_lineage(df.repartitionByRange(slices, *ranges).withColumn(_SLICE, F.spark_partition_id()))
        # At most one row per slice and one per large group.
        totals = cut.groupBy(*keys, _SLICE).agg(self.total(self.amount).alias(_AMOUNT))
        earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*keys, _SLICE, self.total(_AMOUNT).over(earlier).alias(_BEFORE))
        shifted = _match_keys(self.plain(cut, [*keys, _SLICE]), before, [*keys, _SLICE], "inner")
        return shifted.withColumn(self.name, self.after(F.col(self.name), F.col(_BEFORE))).drop(_SLICE, _BEFORE)


def _large_groups(df: DataFrame, keys: list[str], hot_rows: int | None) -> tuple[DataFrame, int, int] | None:
    """Keys of the groups that one task should not sort, their number and their rows; None if there are none."""
    size = input_bytes(df) if hot_rows is None else None
    if size is not None and size <= ONE_TASK_BYTES:
        return None
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_AMOUNT)).filter(F.col(_AMOUNT) > limit)
    hot = cut_lineage(counts)
    groups, rows = hot.agg(F.count(F.lit(1)), F.sum(_AMOUNT)).first()
    if not groups:
        return None
    hot_keys = hot.select(*keys)
    return F.broadcast(hot_keys) if groups <= BROADCAST_GROUPS else hot_keys, rows, max(1, limit)


def _slices(rows: int, limit: int, tasks: int) -> int:
    """Number of slices for that many rows of large groups: none needs more rows than ``limit`` or ``SLICE_ROWS``, the larger."""
    return min(MOST_SLICES, max(2, min(-(-rows // limit), max(tasks, -(-rows // SLICE_ROWS)))))


def _accumulate(df: DataFrame, keys: Sequence[str], steps: Sequence[_Step], hot_rows: int | None) -> DataFrame:
    keys = list(keys)
    if not keys:
        # Nothing needs to stay together: the whole table is always worked on in slices, as many as a shuffle has tasks.
        slices = min(MOST_SLICES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        return reduce(lambda part, step: step.sliced(part, keys, slices), steps, df)
    found = _large_groups(df, keys, hot_rows)
    if found is None:
        return reduce(lambda rows, step: step.plain(rows, keys), steps, df)
    hot_keys, rows, limit = found
    slices = _slices(rows, limit, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = _match_keys(df, hot_keys, keys, "left_semi")
    large = reduce(lambda part, step: step.sliced(part, keys, slices), steps, large)
    small = _match_keys(df, hot_keys, keys, "left_anti")
    return reduce(lambda part, step: step.plain(part, keys), steps, small).unionByName(large)


def rank_rows_by(
    df: DataFrame, keys: Sequence[str], ranks: dict[str, Sequence[Column]], hot_rows: int | None = None
) -> DataFrame:
    """Add several row numbers over the same groups, as bigints: name to order. A later order may use earlier names.

    Every order must be total, for a repeatable result and because equal rows cannot be split. The large groups are
    looked up once, and in the plain case all windows share one shuffle.
    """
    number = lambda window: F.row_number().over(window).cast("bigint")
    one = F.lit(1).cast("bigint")
    return _accumulate(df, keys, [_Step(name, list(order), one, number) for name, order in ranks.items()], hot_rows)


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, hot_rows: int | None = None
) -> DataFrame:
    """Add the row number of each row in its group, see :func:`rank_rows_by`."""
    return rank_rows_by(df, keys, {name: order}, hot_rows)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, hot_rows: int | None = None
) -> DataFrame:
    """Add the running sum of ``value`` up to and including each row. ``order`` must be total."""
    rows_so_far = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = _Step(name, list(order), F.col(value), lambda window: F.sum(value).over(rows_so_far(window)))
    return _accumulate(df, keys, [step], hot_rows)


def largest_so_far(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str, hot_rows: int | None = None
) -> DataFrame:
    """Add the largest ``value`` up to and including each row; nulls are passed over. ``order`` must be total.

    With a value that grows in ``order``, such as a struct of time and id that only some rows have, it is the latest of them.
    """
    rows_so_far = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = _Step(name, list(order), value, lambda window: F.max(value).over(rows_so_far(window)), F.max, F.greatest)
    return _accumulate(df, keys, [step], hot_rows)


def rank_with_ties(
    df: DataFrame, keys: Sequence[str], value: str, name: str, ascending: bool = True, hot_rows: int | None = None
) -> DataFrame:
    """Add the rank of ``value`` in its group as a bigint: equal values share a rank and a gap follows.

    In large groups equal values are counted first, so a value that most rows share is no heavier than another.
    """
    keys = list(keys)
    order = [F.col(value).asc() if ascending else F.col(value).desc()]
    plain = lambda rows: rows.withColumn(name, F.rank().over(_window(keys, order)).cast("bigint"))
    found = _large_groups(df, keys, hot_rows)
    if found is None:
        return plain(df)
    hot_keys = found[0]
    large = _match_keys(df, hot_keys, keys, "left_semi") if keys else df
    counted = large.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__equal"))
    upto = running_total(counted, keys, order, "__equal", "__upto", hot_rows)
    first = upto.select(*keys, value, (F.col("__upto") - F.col("__equal") + 1).alias(name))
    ranked = _match_keys(large, first, [*keys, value], "inner")
    return plain(_match_keys(df, hot_keys, keys, "left_anti")).unionByName(ranked) if keys else ranked


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, with their position as a bigint.

    The filter sits directly on ``row_number``, so Spark keeps k rows per group in every map task before the
    shuffle and a large group costs no more than k rows per task. It does so up to a thousand rows; a longer cut ranks
    all rows.
    """
    if k > GROUP_LIMIT:
        return rank_rows(df, keys, order, name).filter(F.col(name) <= k)
    position = F.row_number().over(_window(list(keys), list(order)))
    return df.withColumn(name, position).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def pick_one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first under a total order."""
    return top_k_per_group(df, keys, order, 1, "__pick").drop("__pick")


def top_n(df: DataFrame, order: Sequence[Column], n: int, codes: Sequence[Column] = ()) -> DataFrame:
    """The first ``n`` rows of the whole table, in order.

    Up to a thousand rows every task keeps n rows, which are merged in two steps, so that the last task sees n rows of
    each of a few others however many partitions there are. For more rows a bound is looked for first, if ``codes`` gives numbers
    whose ascending order agrees with ``order``, see :func:`~shelfscope.operators.selection.first_rows`: only about n rows
    are sorted. Without codes a longer cut ranks all rows.
    """
    if n > GROUP_LIMIT and not codes:
        return rank_rows(df, [], order, "__at").filter(F.col("__at") <= n).drop("__at").orderBy(*order)
    if n > GROUP_LIMIT:
        return first_rows(df, codes, n).orderBy(*order).limit(n)
    shared = df.withColumn("__merge", F.spark_partition_id() % MERGE_TASKS)
    place = F.row_number().over(_window(["__merge"], order))
    kept = shared.withColumn("__at", place).filter(F.col("__at") <= n).drop("__merge", "__at")
    return kept.orderBy(*order).limit(n)


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, total: str, percent: str) -> DataFrame:
    """Total of ``value`` per group and each row's percentage of it, to one decimal.

    Meant for tables that are aggregated already, where a group has one row per category.
    """
    window = Window.partitionBy(*keys)
    with_total = df.withColumn(total, F.sum(value).over(window))
    share = F.try_divide(F.col(value).cast("double"), F.col(total).cast("double"))
    return with_total.withColumn(percent, F.round(share * 100, 1))


def fixed_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run: the smallest hashes of seed and key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    leading = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return top_n(df, [F.md5(text).asc(), *[F.col(k).asc() for k in key]], n, [leading])


def poisson_steps(mean: float) -> list[float]:
    """Distribution function of a Poisson count at 0, 1, 2 ... until it is 1 to twelve digits."""
    term, steps = exp(-mean), [exp(-mean)]
    while steps[-1] < 1 - 1e-12:
        term *= mean / len(steps)
        steps.append(steps[-1] + term)
    return steps


def fraction_sample(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """A fraction with replacement, the same rows on every run.

    The hash of seed and key is a uniform number, whose Poisson quantile is how often the row is drawn. Rows with equal
    keys are drawn equally often.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    uniform = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)
    times = reduce(lambda n, step: n + F.when(uniform >= step, 1).otherwise(0), poisson_steps(fraction), F.lit(0))
    drawn = df.withColumn("__times", times).filter("__times > 0")
    return drawn.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__draw")


def equal_width_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins over [min, max]; the last bin is closed and empty bins are not listed.

    Returns (bin, n_rows). When all values are equal they fall in the middle bin.
    """
    known = df.filter(F.col(value).isNotNull())
    ends = known.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    slot = F.least(F.floor(F.try_divide((F.col(value) - low) * bins, high - low)), F.lit(bins - 1))
    numbered = known.select(F.when(low == high, bins // 2).otherwise(slot).cast("int").alias("bin"))
    return numbered.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
