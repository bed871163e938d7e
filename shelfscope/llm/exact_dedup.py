"""Exact duplicates by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes meets a condition, so equal stretches are cut alike. Chunks
become identifiers: a hash, verified by comparing the bytes of all chunks that share it, with a variant number where
they differ. A document is then the ordered list of its identifiers, and equal lists mean equal texts. The bytes of a
chunk move once, after equal ones have been merged in each task; what moves later are lists of numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, stage, texts
from shelfscope.llm.ragged import BLOCK, mix, slices, text_bytes

WINDOW = 32
CHUNK_BITS = 11
LONGEST_CHUNK = 1 << 15
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS, longest: int = LONGEST_CHUNK) -> np.ndarray:
    """Ends of all chunks of all texts. A cut depends on the 32 bytes before it, and on the text's start alone."""
    found = []
    for at in range(0, len(data), BLOCK):
        first = max(0, at - WINDOW + 1)
        rolling = _GEAR[data[first : at + BLOCK]]
        for step in (1, 2, 4, 8, 16):
            rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint32(step))
        hit = np.flatnonzero(rolling[at - first :] >> np.uint32(32 - bits) == 0)
        found.append(hit + at + 1)
    cuts = np.concatenate(found) if found else np.zeros(0, np.int64)
    row_start = offsets[np.searchsorted(offsets, cuts, "left") - 1]
    cuts = np.union1d(cuts[cuts - row_start >= WINDOW], offsets[1:][np.diff(offsets) > 0])
    gaps = np.diff(cuts, prepend=0)
    wide = np.flatnonzero(gaps > longest)
    if len(wide):
        more = [np.arange(cuts[i] - gaps[i] + longest, cuts[i], longest) for i in wide]
        cuts = np.union1d(cuts, np.concatenate(more))
    return cuts


def _chunked(batches: Iterator[pa.RecordBatch], hash_bits: int):
    shift = 64 - hash_bits
    for batch in batches:
        for part in slices(batch, "__text"):
            data, offsets = text_bytes(part.column(part.schema.get_field_index("__text")))
            ends = cut_points(data, offsets)
            raw = memoryview(np.ascontiguousarray(data))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            bounds = list(zip(starts.tolist(), ends.tolist(), strict=True))
            hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) >> shift for a, b in bounds], np.uint64).view(np.int64)
            yield part, raw, offsets, bounds, hashes, np.searchsorted(ends, offsets, "right")


def chunk_rows(docs: DataFrame, hash_bits: int = 64, digests: bool = False) -> DataFrame:
    """One row for each chunk: hash and bytes; with ``digests`` also its position and the digest of its text."""

    def run(batches):
        for part, raw, offsets, bounds, hashes, first in _chunked(batches, hash_bits):
            columns = {"chunk_hash": pa.array(hashes, pa.int64()), "chunk": pa.array([bytes(raw[a:b]) for a, b in bounds], pa.binary())}
            if digests:
                rows = np.repeat(np.arange(part.num_rows), np.diff(first))
                columns["seq"] = pa.array(np.arange(len(rows)) - first[rows], pa.int64())
                columns["digest"] = _digests(raw, offsets).take(pa.array(rows))
            yield pa.record_batch(columns)

    return docs.mapInArrow(run, "chunk_hash long, chunk binary" + (", seq long, digest string" if digests else ""))


def _digests(raw: memoryview, offsets: np.ndarray) -> pa.Array:
    places = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in places], pa.string())


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row for each document: the ordered hashes of its chunks and the digest of its text."""

    def run(batches):
        for part, raw, offsets, bounds, hashes, first in _chunked(batches, hash_bits):
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes, pa.int64()))
            yield pa.record_batch({"__id": part.column("__id"), "recipe": lists, "digest": _digests(raw, offsets)})

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.mapInArrow(run, f"__id {kind}, recipe array<long>, digest string")


def _variants(docs: DataFrame, clashes: DataFrame, hash_bits: int) -> DataFrame:
    """For texts with a chunk whose hash stands for several contents: the places of such chunks and their variants.

    Only chunks with such a hash leave the tasks that cut them.
    """
    chunks = chunk_rows(docs, hash_bits, digests=True).join(hinted(clashes, 32), "chunk_hash", "left_semi")
    chunks = stage(chunks.distinct(), "clashing")
    order = Window.partitionBy("chunk_hash").orderBy("chunk")
    numbered = chunks.select("chunk_hash", "chunk").distinct().withColumn("variant", F.row_number().over(order))
    named = chunks.join(numbered, ["chunk_hash", "chunk"]).select("digest", F.struct("seq", "variant").alias("v"))
    return named.groupBy("digest").agg(F.array_sort(F.collect_list("v")).alias("variants"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``keep_id`` (largest id with the same text), ``group_size``, ``kept``, ``digest``.

    Texts are equal when all their code points are; null counts as empty, and all empty texts are equal. Of the rows
    with one text exactly one is kept: one with the largest id, or with none if all lack an id. Rows that repeat id and text
    count each. ``keep_id`` is null where no row of the text has an id. An empty table gives no rows; other columns of ``docs`` are
    not read. ``hash_bits`` below 64 makes chunk hashes clash, for tests.
    """
    rows = texts(docs, id_column, text_column)
    per_hash = chunk_rows(rows, hash_bits).groupBy("chunk_hash").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    clashes = stage(per_hash.filter(F.col("least") != F.col("most")).select("chunk_hash"), "clashes")
    written = recipes(rows, hash_bits)
    none = F.array().cast("array<struct<seq:bigint,variant:int>>")
    if clashes.isEmpty():
        written = written.withColumn("variants", none)
    else:
        written = written.join(_variants(rows, clashes, hash_bits), "digest", "left").withColumn("variants", F.coalesce("variants", none))
    recipe = F.coalesce("recipe", F.array().cast("array<long>")).alias("recipe")
    # The number of a row is fixed by the file it is written to.
    written = stage(written.select("__id", "digest", recipe, "variants", F.monotonically_increasing_id().alias("row")), "recipes")
    shared = written.groupBy("recipe", "variants").agg(F.max(F.struct("__id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    shared = stage(shared.filter("group_size > 1"), "groups")
    joined = written.join(shared, ["recipe", "variants"], "left")
    alone = F.col("keep").isNull()
    return joined.select(
        "__id", F.when(alone, F.col("__id")).otherwise(F.col("keep.__id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "digest",
    )


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` with one row for each text, all columns unchanged.

    The row with the largest id stays. Of rows that repeat id and text one stays, whichever, and of equal texts that all lack an
    id too; a row without an id goes if its text is there with an id.
    """
    found = exact_duplicates(docs, id_column, text_column)
    pairs = found.groupBy("__id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    changed = stage(pairs.filter("n > 1 OR NOT stays"), "changed")
    return keep_pairs(docs, changed, id_column, text_column)


def keep_pairs(docs: DataFrame, changed: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` without the pairs of id and text digest that ``changed`` says do not stay, and each of its others once.

    ``changed`` is a written table of (__id, digest, stays); rows of ``docs`` it does not name stay as they are.
    """
    prefix = "__changed"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = {c: f"{prefix}{c}" for c in ("__id", "digest", "stays")}
    own, digest, stays = names.values()
    digests = F.sha2(F.coalesce(docs[text_column], F.lit("")), 256)
    small = hinted(changed.select(*[F.col(c).alias(n) for c, n in names.items()]), 160)
    named = docs[id_column].eqNullSafe(small[own]) & (digests == small[digest])
    untouched = docs.join(small, named, "left_anti")
    if changed.filter("stays").isEmpty():
        return untouched
    once = docs.join(small.filter(stays), named, "inner").dropDuplicates([own, digest])
    return untouched.unionByName(once.select(*docs.columns))
