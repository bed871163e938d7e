"""Functions on ranked lists held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_set(left: Column, right: Column) -> Column:
    """Equality of two arrays as sets."""
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def sorted_pairs(scores: Column, items: Column, descending: bool = True) -> Column:
    """Zip scores with items and sort by score, then item."""
    return F.sort_array(F.arrays_zip(scores.alias("score"), items.alias("item")), asc=not descending)


def select_where(items: Column, flags: Column, value: int) -> Column:
    """Items whose flag, at the same position, has a value."""
    marked = F.transform(items, lambda item, i: F.when(F.get(flags, i) == value, item))
    return F.filter(marked, lambda item: item.isNotNull())


def common_in_first(left: Column, right: Column, depth: int) -> Column:
    """How many items the first ``depth`` places of two lists share."""
    return F.size(F.array_intersect(F.slice(left, 1, depth), F.slice(right, 1, depth)))
