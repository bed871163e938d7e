"""Hard negatives by Kronecker-packed products.

Components are whole numbers. Biased to be non-negative, the same component of several candidates goes into separated
fields of one wide integer, wide enough that a whole inner product fits a field. One multiplication by a component of an
anchor then multiplies all fields; added over the components, the fields hold the biased scores, and sums known
beforehand take the bias out again. Scores are exact.

Anchors meet all rows in a grid of cells: a block of anchors and a block of candidates, both of bounded size, dealt out by
one shuffle. A cell returns a few rows for each of its anchors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import stage

# Bytes of the components of one cell's candidates, and of its anchors.
CANDIDATE_BYTES = 16 << 20
ANCHOR_BYTES = 4 << 20
# Fewer candidates are not worth a cell of their own.
CELL_ROWS = 512
# Scores held at a time.
SCORES = 1 << 21
LONG = np.iinfo(np.int64)


def packed_scores(candidates: np.ndarray, anchors: np.ndarray):
    """Inner products of each anchor with all candidates, yielded as (first anchor, rows of scores).

    Products beyond 64 bits are held at the limits of a long.
    """
    n, width = candidates.shape
    chunk = max(1, SCORES // max(n, 1))
    if not n or not width:
        for at in range(0, len(anchors), chunk):
            yield at, np.zeros((len(anchors[at : at + chunk]), n), np.int64)
        return
    low_c, low_a = min(0, int(candidates.min())), min(0, int(anchors.min()))
    bits = max(1, (width * (int(candidates.max()) - low_c) * (int(anchors.max()) - low_a)).bit_length())
    fields = 64 // bits
    if fields >= 2:
        yield from _packed_words(candidates, anchors, low_c, low_a, bits, fields, chunk)
    else:
        yield from _packed_integers(candidates, anchors, low_c, low_a, -(-bits // 64) * 8, chunk)


def _packed_words(candidates, anchors, low_c, low_a, bits, fields, chunk):
    """Two or more fields in words of 64 bits."""
    n, width = candidates.shape
    rows = -(-n // fields)
    biased = np.zeros((rows * fields, width), np.uint64)
    biased[:n] = candidates - low_c
    packed = np.zeros((width, rows), np.uint64)
    for k in range(fields):
        packed |= biased[k * rows : (k + 1) * rows].T << np.uint64(k * bits)
    # sum((c - low_c) * (a - low_a)) = score - low_a * sum(c) - low_c * sum(a) + width * low_c * low_a
    sums_c, sums_a = candidates.sum(1), anchors.sum(1)
    mask = np.uint64((1 << bits) - 1)
    for at in range(0, len(anchors), chunk):
        block = anchors[at : at + chunk]
        total = np.zeros((len(block), rows), np.uint64)
        product = np.empty_like(total)
        factors = (block - low_a).astype(np.uint64)
        for j in range(width):
            np.multiply(factors[:, j, None], packed[j], out=product)
            total += product
        scores = np.empty((len(block), rows * fields), np.int64)
        for k in range(fields):
            scores[:, k * rows : (k + 1) * rows] = (total >> np.uint64(k * bits)) & mask
        yield at, scores[:, :n] + (low_a * sums_c)[None, :] + (low_c * sums_a[at : at + chunk] - width * low_c * low_a)[:, None]


def _packed_integers(candidates, anchors, low_c, low_a, size, chunk):
    """All candidates in one integer of any width, with fields of ``size`` bytes: for components of any size."""
    n, width = candidates.shape
    columns = [[int(x) for x in column] for column in candidates.T]
    packed = [int.from_bytes(b"".join((x - low_c).to_bytes(size, "little") for x in column), "little") for column in columns]
    sums_c = [sum(row) for row in zip(*columns, strict=True)]
    for at in range(0, len(anchors), chunk):
        out = []
        for anchor in anchors[at : at + chunk].tolist():
            total = sum((a - low_a) * p for a, p in zip(anchor, packed, strict=True)).to_bytes(n * size, "little")
            fixed = low_c * sum(anchor) - width * low_c * low_a
            exact = (int.from_bytes(total[i * size : (i + 1) * size], "little") + low_a * s + fixed for i, s in enumerate(sums_c))
            out.append([max(LONG.min, min(LONG.max, x)) for x in exact])
        yield at, np.array(out, np.int64).reshape(-1, n)


def highest(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties in the order they stand."""
    if len(scores) > most:
        bound = np.partition(scores, len(scores) - most)[len(scores) - most]
        places = np.flatnonzero(scores >= bound)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(~scores[places], kind="stable")[:most]]


class _Cell:
    """Candidates of a cell in order of id, its anchors, and the components of both as matrices."""

    def __init__(self, candidates: pa.Table, anchors: pa.Table):
        candidates = candidates.sort_by([("id", "ascending"), ("row", "ascending")])
        self.anchors = anchors
        self.id, self.row, self.label = (candidates.column(c).to_numpy() for c in ("id", "row", "label"))
        self.key, self.anchor_id, self.anchor_label = (anchors.column(c).to_numpy() for c in ("key", "id", "label"))
        sizes = [pa.compute.list_value_length(t.column("v")).to_numpy() for t in (candidates, anchors)]
        width = max((int(s.max()) for s in sizes if len(s)), default=0)
        self.vectors, self.anchor_vectors = (self._matrix(t, s, width) for t, s in zip((candidates, anchors), sizes, strict=True))

    @staticmethod
    def _matrix(table: pa.Table, sizes: np.ndarray, width: int) -> np.ndarray:
        """Shorter vectors end in zeros."""
        values = pa.compute.list_flatten(table.column("v")).to_numpy()
        if (sizes == width).all():
            return values.reshape(len(sizes), width)
        out = np.zeros((len(sizes), width), np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = values
        return out


def _best_of_label(most: int):
    """Per anchor of a cell the highest rows of its own label, under another id."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        cell = _Cell(candidates, anchors)
        found: list[list] = [[], [], [], []]
        for label in np.unique(cell.anchor_label):
            mine, theirs = np.flatnonzero(cell.anchor_label == label), np.flatnonzero(cell.label == label)
            for at, rows in packed_scores(cell.vectors[theirs], cell.anchor_vectors[mine]):
                for i, scores in enumerate(rows, at):
                    other = np.flatnonzero(cell.id[theirs] != cell.anchor_id[mine[i]])
                    best = other[highest(scores[other], most)]
                    for column, values in zip(found, (np.full(len(best), cell.key[mine[i]]), cell.id[theirs[best]], cell.row[theirs[best]], scores[best]), strict=True):
                        column.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(("key", "id", "row", "score"), found, strict=True)})

    return run


def _best_in_bands(most: int):
    """Per anchor and positive the highest rows of other labels whose score lies in the positive's band."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        cell = _Cell(candidates, anchors)
        bands = [[(p["place"], -(-p["score"] // 2), 19 * p["score"] // 20) for p in b] for b in anchors.column("bands").to_pylist()]
        found: list[list] = [[], [], [], [], []]
        for at, rows in packed_scores(cell.vectors, cell.anchor_vectors):
            for i, scores in enumerate(rows, at):
                low, high = min(b[1] for b in bands[i]), max(b[2] for b in bands[i])
                places = np.flatnonzero((scores >= low) & (scores <= high) & (cell.label != cell.anchor_label[i]))
                places = places[np.argsort(~scores[places], kind="stable")]
                ordered = ~scores[places]
                for place, least, largest in bands[i]:
                    first = np.searchsorted(ordered, ~largest, "left")
                    best = places[first : first + most]
                    best = best[scores[best] >= least]
                    for column, values in zip(found, (np.full(len(best), cell.key[i]), np.full(len(best), place), cell.id[best], cell.row[best], scores[best]), strict=True):
                        column.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(("key", "place", "id", "row", "score"), found, strict=True)})

    return run


def whole_components(vector: Column) -> Column:
    """Components times 256, rounded down; beyond a long they stay at its limits."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def first_of(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each group: higher scores, then smaller ids. Named ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels.

    ``rows`` has ``id``, ``label`` and ``vector``. Rows in which one of them, or a component, is null or not finite take no part. The
    score of two rows is the inner product of their whole components; a shorter vector counts as ending in zeros. Positives are the
    highest rows of the anchor's label under another id; negatives have another label and between 50 % and 95 %
    of the positive's score. Ties go to the smaller id. Of rows that repeat a candidate each counts; anchors that
    repeat id, label and vector are one. Anchors without positives, and positives without such rows, give no rows; neither does an empty table.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(F.forall("vector", finite))
    written = stage(
        whole.select(
            F.col("id").cast("long"), F.col("label").cast("long").alias("label"), whole_components(F.col("vector")).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")
        ),
        "vectors",
    )
    n, width = written.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    anchors = stage(written.filter("anchor").groupBy("id", "label", "v").agg(F.min("row").alias("key")), "anchors")
    per_row = 8 * max(width, 1)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    columns = max(1, math.ceil(n * per_row / CANDIDATE_BYTES), min(tasks, n // CELL_ROWS))
    lines = max(1, math.ceil(anchors.count() * per_row / ANCHOR_BYTES))
    deal = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
    candidates = written.select("id", "label", "v", "row", deal("row", columns).alias("column"), every(lines).alias("line"))

    def meet(some_anchors: DataFrame, run, schema: str) -> DataFrame:
        spread = some_anchors.select("*", deal("key", lines).alias("line"), every(columns).alias("column"))
        return candidates.groupBy("column", "line").cogroup(spread.groupBy("column", "line")).applyInArrow(run, schema)

    near = meet(anchors, _best_of_label(positives), "key long, id long, row long, score long")
    near = first_of(near, ["key"], positives).select("key", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stage(near, "positives")
    bands = near.groupBy("key").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("bands"))
    hard = meet(anchors.join(bands, "key"), _best_in_bands(negatives), "key long, place long, id long, row long, score long")
    hard = first_of(hard, ["key", "place"], negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    names = anchors.select("key", F.col("id").alias("anchor_id"))
    return hard.join(near, ["key", "place"]).join(names, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
