"""Repeated passages by seed and extend.

Every window of ``window`` words has an anchor: the smallest hash of the short word runs inside it. Windows with the same
words have the same anchor, so only anchors that occur twice (seeds) can carry a repeat. A seed is extended both ways over the
windows that share it, as the list of their hashes; equal lists are merged before they are compared, so thousands of copies
count as one list with a number. A window is repeated if its (anchor, hash), 128 bits that both depend on all its words,
occurs at two places, and the words of all repeated windows make up the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import BROADCAST_BYTES, hinted, stage, texts
from shelfscope.llm.ragged import as_signed, rows_of, runs, slices, sliding, text_bytes, unspaced, valid_starts, words

SEED_WORDS = 8
# Windows in one list: their repeats fit the bits of a long.
RUN_WINDOWS = 64


def _anchored(part: pa.RecordBatch, window: int, seed: int):
    """Words, hashes of all windows and of all seeds, the anchor of each window, and which windows lie inside a text."""
    found = words(*text_bytes(part.column("__text")), unspaced())
    grams, hashes = runs(found.hash, seed), runs(found.hash, window)
    if not len(hashes):
        return found, hashes, grams, hashes, np.zeros(0, bool)
    anchors = sliding(grams, window - seed + 1)
    return found, hashes, grams, anchors, valid_starts(found.offsets, window, len(hashes))


def seed_counts(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """How often each anchor stands in a text: (anchor, n), with a row for each part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        reach = window - seed + 1
        for batch in batches:
            for part in slices(batch, "__text"):
                _, _, grams, anchors, valid = _anchored(part, window, seed)
                if not valid.any():
                    continue
                pad = np.zeros(reach - 1, np.uint64)
                # A run of words is an anchor if a window around it has it as its smallest.
                highest = sliding(np.concatenate([pad, np.where(valid, anchors, np.uint64(0)), pad]), reach, np.maximum)
                values, counts = np.unique(grams[(highest == grams) & (highest > 0)], return_counts=True)
                yield pa.record_batch({"anchor": pa.array(as_signed(values), pa.int64()), "n": pa.array(counts, pa.int64())})

    return rows.select("__text").mapInArrow(run, "anchor long, n long")


def window_lists(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Consecutive windows with one anchor: document, anchor, first word of the first window, hashes of the windows."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "__text"):
                found, hashes, _, anchors, valid = _anchored(part, window, seed)
                at = np.flatnonzero(valid)
                if not len(at):
                    continue
                anchor = anchors[at]
                fresh = np.ones(len(at), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
                begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                first = np.flatnonzero((np.arange(len(at)) - begun) % RUN_WINDOWS == 0)
                row = rows_of(found.offsets)[at[first]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(as_signed(hashes[at])))
                take = pa.array(row)
                yield pa.record_batch({
                    "__id": part.column("__id").take(take), "text_hash": part.column("text_hash").take(take),
                    "anchor": pa.array(as_signed(anchor[first]), pa.int64()), "start": pa.array(at[first] - found.offsets[row], pa.int32()), "windows": lists,
                })

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, text_hash long, anchor long, start int, windows array<long>")


def _kept(window: int, with_text: bool):
    """Counts and the digest (or the text) of what stays of each document, from the repeated windows of its runs."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            total, removed, left = [], [], []
            for text, starts, masks in zip(batch.column("__text"), batch.column("starts"), batch.column("masks"), strict=True):
                tokens = text.as_py().encode().split()
                total.append(len(tokens))
                kept = tokens
                if starts.is_valid:
                    first = starts.values.to_numpy()
                    bits = masks.values.to_numpy().view(np.uint64)[:, None] >> np.arange(RUN_WINDOWS, dtype=np.uint64) & np.uint64(1)
                    run_of, bit = np.nonzero(bits)
                    depth = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(depth, first[run_of] + bit, 1)
                    np.add.at(depth, first[run_of] + bit + window, -1)
                    kept = list(compress(tokens, (np.cumsum(depth[:-1]) == 0).tolist()))
                removed.append(len(tokens) - len(kept))
                joined = b" ".join(kept)
                left.append(joined.decode() if with_text else hashlib.sha256(joined).hexdigest())
            yield pa.record_batch({
                "__id": batch.column("__id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(left, pa.string()),
            })

    return run


def repeated_windows(rows: DataFrame, window: int, seed: int = SEED_WORDS) -> DataFrame:
    """Written table of the runs with repeated windows: document, first window, and a bit for each repeated window."""
    seeds = seed_counts(rows, window, seed).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    seeds = stage(seeds, "seeds")
    seeded = stage(window_lists(rows, window, seed).join(hinted(seeds, 32), "anchor"), "seeded")
    distinct = seeded.groupBy("anchor", "windows").agg(F.count(F.lit(1)).alias("n"))
    distinct = stage(distinct.withColumn("run", F.xxhash64("windows")), "lists")
    each = distinct.select("anchor", "run", "n", F.posexplode("windows").alias("bit", "hash"))
    repeated = stage(each.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "hash"), "repeated")
    masks = each.join(repeated, ["anchor", "hash"], "left_semi").groupBy("anchor", "run").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    masks = stage(masks, "masks")
    places = seeded.select("__id", "text_hash", "anchor", F.xxhash64("windows").alias("run"), "start")
    return places.join(masks, ["anchor", "run"]).select("__id", "text_hash", "start", "mask")


def remove_repeats(docs: DataFrame, window: int = 35, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``n_words``, ``n_removed`` and ``kept``.

    Words are runs of anything but ASCII white space. Words covered by a window of ``window`` words whose words also start
    anywhere else are removed; all windows are judged on the input. ``kept`` is the SHA-256 of the words that stay, joined
    by one blank, or with ``with_text`` those words. Null and empty texts have no words; texts shorter than a window keep
    all. Rows that repeat id and text are copies like any others: their windows occur twice, and each
    row is returned. An empty table gives no rows; other columns are not read.
    """
    rows = texts(docs, id_column, text_column).select("__id", F.xxhash64("__text").alias("text_hash"), "__text")
    found = repeated_windows(rows, window).groupBy("__id", "text_hash").agg(F.collect_list(F.struct("start", "mask")).alias("l"))
    found = found.select(F.col("__id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("l.start").alias("starts"), F.col("l.mask").alias("masks"))
    found = stage(found, "covered")
    held = found.agg(F.coalesce(F.sum(48 + 16 * F.size("starts")), F.lit(0)).alias("b")).head()["b"]
    same = F.col("__id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash"))
    joined = rows.join(F.broadcast(found) if held <= BROADCAST_BYTES else found, same, "left")
    kind = rows.schema["__id"].dataType.simpleString()
    ready = joined.select("__id", "__text", "starts", "masks")
    return ready.mapInArrow(_kept(window, with_text), f"__id {kind}, n_words long, n_removed long, kept string")
