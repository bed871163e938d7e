"""Counts on many ranked lists at once, for batches of lists that Spark has gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a list is counted into: its length, pairs out of order, and sums over ties in x, in y and in both.
COUNTS = ("n", "discordant", "tx", "x0", "x1", "ty", "y0", "y1", "txy")


def inversions(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each list the pairs whose earlier value is larger, as a merge sort counts them.

    ``values`` holds the lists one after the other, as whole numbers from 0; ``starts`` says where each begins, with the end of the last.
    All lists are merged together: at width w the right half of every block of 2w places counts what its left half has
    that is larger.
    """
    n, total = len(values), np.zeros(len(starts) - 1, dtype="int64")
    sizes = np.diff(starts)
    list_of = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - starts[list_of]
    span = int(values.max(initial=0)) + 1
    width = 1
    while width < sizes.max(initial=0):
        block = place // (2 * width)
        # Blocks of one list follow each other, so a running number tells all blocks apart.
        number = np.cumsum(np.diff(block, prepend=-1).astype(bool) | np.diff(list_of, prepend=-1).astype(bool)) - 1
        right = (place // width) % 2
        order = np.argsort((number * span + values) * 2 + right, kind="stable")
        left_so_far = np.cumsum(1 - right[order])
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        before = np.concatenate([[0], left_so_far])[first]
        left_in_block = np.diff(np.concatenate([before, left_so_far[-1:]]))
        larger = left_in_block[number[order]] - (left_so_far - before[number[order]])
        np.add.at(total, list_of[order], np.where(right[order] == 1, larger, 0))
        width *= 2
    return total


def _codes(column: pa.Array) -> np.ndarray:
    """Values by their place in ascending order, nulls first and NaN last; equal values share a number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype("int64") - 1


def _tie_sums(runs: np.ndarray, list_of: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over tie groups of size t of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5); ``runs`` marks where groups begin."""
    first = np.flatnonzero(runs)
    t = np.diff(np.concatenate([first, [len(runs)]]))
    sums = tuple(np.zeros(lists, dtype="int64") for _ in range(3))
    for out, term in zip(sums, (t * (t - 1) // 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5))):
        np.add.at(out, list_of[first], term)
    return sums


def count_lists(x: pa.Array, y: pa.Array, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each list of pairs (x, y)."""
    sizes = np.diff(starts)
    lists, list_of = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    x, y = (_codes(v) if len(v) else np.zeros(0, dtype="int64") for v in (x, y))
    changed = lambda v: np.diff(v, prepend=-1).astype(bool)
    by_x = np.lexsort((y, x, list_of))
    by_y = np.lexsort((y, list_of))
    new_x = changed(list_of) | changed(x[by_x])
    new_both = new_x | changed(y[by_x])
    out = {"n": sizes.astype("int64"), "discordant": inversions(y[by_x], starts)}
    out["tx"], out["x0"], out["x1"] = _tie_sums(new_x, list_of, lists)
    out["ty"], out["y0"], out["y1"] = _tie_sums(changed(list_of) | changed(y[by_y]), list_of, lists)
    out["txy"] = _tie_sums(new_both, list_of, lists)[0]
    return out


def count_list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (request, list of pairs) the request and its counts."""
    for batch in batches:
        lists = batch.column(1)
        flat, starts = lists.flatten(), np.asarray(lists.offsets, dtype="int64")
        counts = count_lists(flat.field(0), flat.field(1), starts - starts[0])
        yield pa.record_batch([batch.column(0), *[pa.array(counts[c]) for c in COUNTS]], names=[batch.schema.names[0], *COUNTS])
