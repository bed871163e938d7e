"""Exact nearest neighbours by cosine similarity, as a join over a two-level tree of pivots.

Comparing every key with every other is what this avoids. On unit vectors the straight-line distance is a metric and
orders neighbours as the cosine does, so the pivot method for nearest-neighbour joins applies (Lu, Shen, Chen and Ooi
2012). Pivots are sampled keys, as many as there are blocks of keys; a few of them head the others. A key belongs to its
nearest head and there to the nearest pivot, its leaf, so it is measured against two short lists however many leaves there are.

Leaves are packed into groups of bounded size, a large leaf into several. A first pass finds, inside each block of keys, a
distance that the k-th neighbour of a query cannot exceed, and rules out heads and leaves by the triangle inequality. The
queries of a block then travel once to each group in which a leaf is left. There one task holds the group and its
queries, narrows the bounds as it goes from leaf to leaf, and returns at most k rows for a query. Candidates are picked in
single precision with room for its error and decided in double precision, so the result is that of a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.operators.ordered import top_k_per_group
from shelfscope.session import cut_lineage

# Bounds of what the driver and every task hold of the tree: leaves, and bytes of their pivots.
MOST_LEAVES = 1 << 16
PIVOT_BYTES = 32 << 20
BLOCK_ROWS = 2048
# Bytes of the vectors of a group of leaves, and of the queries that one task compares with it.
GROUP_BYTES = 16 << 20
QUERY_BYTES = 16 << 20
# Similarities are compared at this many decimals, so that equal vectors tie exactly.
DECIMALS = 9
# Visited groups that leave a task in one batch, which bounds its memory.
GROUPS_AT_ONCE = 4
# Queries that are multiplied with a block of keys at a time.
QUERIES_AT_ONCE = 1024
# More candidates than this many times k per query are thinned out before they are sorted.
FEW_PER_QUERY = 4
# Queries up to this size are sent to all tasks instead of being routed.
SCAN_BYTES = 32 << 20
# Slack on distances against rounding in the last places, and on similarities in single precision.
SLACK = 1e-6
SINGLE_SLACK = 2e-5


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _unpack(flat, n: int) -> np.ndarray:
    """The matrix of a block, whose vectors are stored one after the other."""
    return np.asarray(flat, dtype="float64").reshape(n, -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


@dataclass
class _Tree:
    """Pivots in the order of their heads; the leaves of head h are ``first[h]`` up to ``first[h + 1]``."""

    heads: np.ndarray
    pivots: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(sample: np.ndarray) -> _Tree:
        """As many heads as the square root of the pivots; each head is one of its own pivots."""
        heads = sample[: max(1, round(len(sample) ** 0.5))]
        of_head = _distances(sample, heads).argmin(axis=1)
        # Copies of an earlier head would otherwise leave a head without a leaf.
        of_head[: len(heads)] = np.arange(len(heads))
        order = np.argsort(of_head, kind="stable")
        return _Tree(heads, sample[order], np.concatenate([[0], np.cumsum(np.bincount(of_head, minlength=len(heads)))]))

    def locate(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Head, distance to it, leaf, distance to its pivot."""
        to_heads = _distances(units, self.heads)
        head = to_heads.argmin(axis=1)
        leaf, gap = np.zeros(len(units), dtype="int64"), np.zeros(len(units))
        for h in np.unique(head):
            rows = np.flatnonzero(head == h)
            gaps = _distances(units[rows], self.pivots[self.first[h] : self.first[h + 1]])
            nearest = gaps.argmin(axis=1)
            leaf[rows], gap[rows] = self.first[h] + nearest, gaps[np.arange(len(rows)), nearest]
        return head, to_heads[np.arange(len(units)), head], leaf, gap


@dataclass
class _Layout:
    """How far keys lie from the pivots and heads they belong to, and which groups hold the blocks of a leaf.

    ``pair_leaf`` lists the leaves of group 0, then of group 1 and so on, and ``pair_start`` where each group begins.
    """

    head_low: np.ndarray
    head_high: np.ndarray
    leaf_low: np.ndarray
    leaf_high: np.ndarray
    pair_leaf: np.ndarray
    pair_start: np.ndarray


def _assign_leaves(tree: _Tree, key_type: str):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            vectors = _matrix(batch["vector"])
            length = np.linalg.norm(vectors, axis=1)
            batch, vectors = batch[length > 0], vectors[length > 0]
            if batch.empty:
                continue
            unit = vectors / length[length > 0][:, None]
            head, head_gap, leaf, gap = tree.locate(unit)
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "is_query": batch["is_query"],
                    "unit": list(unit),
                    "head": head.astype("int32"),
                    "head_gap": head_gap,
                    "leaf": leaf.astype("int32"),
                    "gap": gap,
                }
            )

    return assign, f"key {key_type}, is_query boolean, unit array<double>, head int, head_gap double, leaf int, gap double"


def _ruled_out(to_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Where the triangle inequality leaves nothing within the bound."""
    return np.maximum(to_pivot - high, low - to_pivot) > bound[:, None] + SLACK


def _route_queries(tree: _Tree, layout: _Layout, k: int, key_type: str):
    """Bound the k-th distance of each query by its own block, then send it to the groups it has to visit.

    One row per block and visited group, with the queries of the block that go there.
    """

    def visits(queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
        heads = ~_ruled_out(_distances(queries, tree.heads), layout.head_low, layout.head_high, bound)
        leaves = np.zeros((len(queries), len(tree.pivots)), dtype=bool)
        for h in np.flatnonzero(heads.any(axis=0)):
            rows, own = np.flatnonzero(heads[:, h]), slice(tree.first[h], tree.first[h + 1])
            gaps = _distances(queries[rows], tree.pivots[own])
            leaves[rows, own] = ~_ruled_out(gaps, layout.leaf_low[own], layout.leaf_high[own], bound[rows])
        return np.logical_or.reduceat(leaves[:, layout.pair_leaf], layout.pair_start, axis=1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, units, flags in zip(batch["keys"], batch["units"], batch["flags"]):
                asked = np.flatnonzero(np.asarray(flags, dtype=bool))
                if not len(asked):
                    continue
                units = _unpack(units, len(keys))
                queries = units[asked]
                if len(units) > k:
                    gaps = _distances(queries, units)
                    gaps[np.arange(len(asked)), asked] = np.inf
                    bound = np.partition(gaps, k - 1, axis=1)[:, k - 1] + SLACK
                else:
                    bound = np.full(len(asked), 2.0 + SLACK)
                going, keys = visits(queries, bound), np.asarray(keys)[asked]
                targets = np.flatnonzero(going.any(axis=0))
                for start in range(0, len(targets), GROUPS_AT_ONCE):
                    some = targets[start : start + GROUPS_AT_ONCE]
                    chosen = [np.flatnonzero(going[:, t]) for t in some]
                    yield pd.DataFrame(
                        {
                            "group": some.astype("int32"),
                            "q_keys": [keys[i] for i in chosen],
                            "q_units": [queries[i].ravel() for i in chosen],
                            "bounds": [bound[i] for i in chosen],
                        }
                    )

    return route, f"group int, q_keys array<{key_type}>, q_units array<double>, bounds array<double>"


class _Best:
    """The best k matches of each query so far, as (query, code of the match, similarity)."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor
        self.kept = (np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0))
        self.found: list[tuple] = []
        self.waiting = 0

    def add(self, query: np.ndarray, match: np.ndarray, score: np.ndarray) -> None:
        self.found.append((query, match, score))
        self.waiting += len(query)
        if self.waiting > FEW_PER_QUERY * self.k * self.n:
            self.settle()

    def settle(self) -> tuple:
        query, match, score = (np.concatenate(x) for x in zip(self.kept, *self.found))
        order = np.lexsort((match, -score, query))
        query, match, score = query[order], match[order], score[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=self.n))])
        place = np.arange(len(query)) - starts[query]
        self.kept = (query[place < self.k], match[place < self.k], score[place < self.k])
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.found, self.waiting = [], 0
        return self.kept


def _compare_group(tree: _Tree, layout: _Layout, k: int, key_type: str):
    """Best k matches of each query among the keys of a group of leaves, within the bound of the query."""

    def compare(blocks: pd.DataFrame, routed: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or routed.empty:
            return pd.DataFrame({"key": [], "match": [], "similarity": []})
        q_keys = np.concatenate([np.asarray(x) for x in routed["q_keys"]])
        queries = _unpack(np.concatenate(list(routed["q_units"])), len(q_keys))
        bound = np.concatenate(list(routed["bounds"]))
        best = _Best(len(q_keys), k, 1.0 - bound**2 / 2.0 - SLACK)
        # Keys by number: their order decides ties.
        names, codes = np.unique(np.concatenate([*[np.asarray(x) for x in blocks["keys"]], q_keys]), return_inverse=True)
        q_codes, at = codes[len(codes) - len(q_keys) :], 0
        single = queries.astype("float32")
        for keys, units, leaf in zip(blocks["keys"], blocks["units"], blocks["leaf"]):
            units, own = _unpack(units, len(keys)), codes[at : at + len(keys)]
            at += len(keys)
            within = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best.floor)) + SLACK
            gaps = _distances(queries, tree.pivots[[leaf]])
            open_ = np.flatnonzero(~_ruled_out(gaps, layout.leaf_low[[leaf]], layout.leaf_high[[leaf]], within)[:, 0])
            narrow = units.astype("float32").T
            for start in range(0, len(open_), QUERIES_AT_ONCE):
                some = open_[start : start + QUERIES_AT_ONCE]
                similarity = single[some] @ narrow
                reach = (best.floor[some] - SINGLE_SLACK).astype("float32")
                close = similarity >= reach[:, None]
                if similarity.shape[1] > k + 1 and np.count_nonzero(close) > FEW_PER_QUERY * k * len(some):
                    # Loose bounds: no more than k of this block can matter, plus the query itself and ties.
                    reach = np.maximum(reach, np.partition(similarity, -(k + 1), axis=1)[:, -(k + 1)] - SINGLE_SLACK)
                    close = similarity >= reach[:, None]
                row, column = np.nonzero(close)
                other = q_codes[some[row]] != own[column]
                row, column = some[row[other]], column[other]
                best.add(row, own[column], np.round(np.einsum("ij,ij->i", queries[row], units[column]), DECIMALS))
        query, match, score = best.settle()
        return pd.DataFrame({"key": q_keys[query], "match": names[match], "similarity": score})

    return compare, f"key {key_type}, match {key_type}, similarity double"


def _scan_keys(q_keys: np.ndarray, queries: np.ndarray, k: int, key_type: str):
    """Best k matches of every query among the keys of a task: one pass over the keys, at most k rows per query out."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, floor = pd.DataFrame({"query": [], "match": [], "similarity": []}), np.full(len(queries), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                rows = batch.iloc[start : start + BLOCK_ROWS]
                vectors = _matrix(rows["vector"])
                length = np.linalg.norm(vectors, axis=1)
                units, keys = vectors[length > 0] / length[length > 0][:, None], rows["key"].to_numpy()[length > 0]
                found = [best]
                for at in range(0, len(queries) if len(keys) else 0, BLOCK_ROWS):
                    similarity = queries[at : at + BLOCK_ROWS] @ units.T
                    reach = floor[at : at + BLOCK_ROWS] - SLACK
                    if similarity.shape[1] > k + 1:
                        # No more than k of this block can matter, plus the query itself and ties.
                        reach = np.maximum(reach, np.partition(similarity, -(k + 1), axis=1)[:, -(k + 1)] - SLACK)
                    row, column = np.nonzero(similarity >= reach[:, None])
                    other = q_keys[at + row] != keys[column]
                    row, column = row[other], column[other]
                    score = np.round(similarity[row, column], DECIMALS)
                    found.append(pd.DataFrame({"query": at + row, "match": keys[column], "similarity": score}))
                found = pd.concat([f for f in found if len(f)] or [best])
                found = found.sort_values(["similarity", "match"], ascending=[False, True], kind="stable")
                best = found.groupby("query", sort=False).head(k)
                full = best.groupby("query")["similarity"].agg(["size", "min"])
                full = full[full["size"] == k]
                floor[full.index.to_numpy(dtype=int)] = full["min"]
        if len(best):
            yield pd.DataFrame({"key": q_keys[best["query"].to_numpy(dtype=int)], "match": best["match"], "similarity": best["similarity"]})

    return scan, f"key {key_type}, match {key_type}, similarity double"


def similar_topk(
    table: DataFrame,
    key: str,
    vector: str,
    k: int = 5,
    is_query: str | None = None,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    scan_bytes: int = SCAN_BYTES,
) -> DataFrame:
    """The k most similar other keys of every key: (key, match, similarity, place).

    ``is_query`` names a boolean column that restricts which keys are looked up; all keys can be matches. Equal
    similarities go to the smaller key. Vectors of length zero have no direction and take no part. Keys are unique.

    Queries whose vectors take up to ``scan_bytes`` are sent to every task, which passes over its keys once: no vector is
    shuffled. More queries are routed over the tree of pivots, of which ``pivots`` fixes the number of leaves; both ways
    decide all pairs and give the same rows.
    """
    key_type = table.schema[key].dataType.simpleString()
    flag = F.col(is_query) if is_query else F.lit(True)
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"), flag.alias("is_query"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("vector").isNotNull())
    if pivots is None:
        asked = rows.filter("is_query").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        if asked[0] * max(asked[1], 1) * 8 <= scan_bytes:
            known = [r for r in rows.filter("is_query").select("key", "vector").collect() if np.any(np.asarray(r["vector"], dtype="float64"))]
            if known:
                queries = _matrix([r["vector"] for r in known])
                queries = queries / np.linalg.norm(queries, axis=1)[:, None]
                q_keys = pd.Series([r["key"] for r in known]).to_numpy()
                found = rows.select("key", "vector").mapInPandas(*_scan_keys(q_keys, queries, k, key_type))
                return top_k_per_group(found, ["key"], [F.col("similarity").desc(), F.col("match").asc()], k, "place")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v.cast("double") * v)
    directed = rows.filter(squares > 0)
    n, width = directed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        empty = rows.select("key", F.col("key").alias("match"), F.lit(0.0).alias("similarity"))
        return empty.withColumn("place", F.lit(0).cast("bigint")).filter(F.lit(False))
    # A leaf for each block of keys, as far as the bounds go; further blocks make leaves larger.
    leaves = pivots or max(1, min(MOST_LEAVES, PIVOT_BYTES // (8 * width), n // block_rows))
    tree = _Tree.of(_sample(directed, n, leaves))

    assigned = cut_lineage(rows.mapInPandas(*_assign_leaves(tree, key_type)))
    layout, places = _lay_out(tree, assigned, n, width, block_rows)
    # A leaf with a large share of the keys becomes many blocks; a block is one row of bounded size.
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    key_blocks = (
        assigned.join(F.broadcast(places), "leaf")
        .select("leaf", block.alias("block"), (F.col("first_group") + F.floor(block / F.col("per_group"))).cast("int").alias("group"), "key", "unit", "is_query")
        .groupBy("leaf", "block", "group")
        .agg(F.collect_list(F.struct("key", "unit", "is_query")).alias("m"))
        .select("leaf", "group", F.col("m.key").alias("keys"), F.flatten("m.unit").alias("units"), F.col("m.is_query").alias("flags"))
    )
    key_blocks = cut_lineage(key_blocks)
    routed = cut_lineage(key_blocks.mapInPandas(*_route_queries(tree, layout, k, key_type)))
    # One row per group: its queries are cut into slots of bounded size, and its keys go to each slot.
    per_slot = max(1, QUERY_BYTES // (8 * width))
    slots = routed.groupBy("group").agg(F.ceil(F.sum(F.size("q_keys")) / per_slot).alias("slots"))
    slots = F.broadcast(table.sparkSession.createDataFrame(slots.collect(), "group int, slots bigint"))
    queries = routed.join(slots, "group").withColumn("slot", F.pmod(F.xxhash64("q_keys"), F.col("slots"))).drop("slots")
    held = key_blocks.drop("flags").join(slots, "group").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)))
    found = held.drop("slots").groupBy("group", "slot").cogroup(queries.groupBy("group", "slot")).applyInPandas(*_compare_group(tree, layout, k, key_type))
    return top_k_per_group(found, ["key"], [F.col("similarity").desc(), F.col("match").asc()], k, "place")


def _sample(directed: DataFrame, n: int, most: int) -> np.ndarray:
    """Unit vectors of about ``most`` keys, chosen by a hash of the key; the number is bounded by that of the leaves."""
    mark = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30))
    wanted = directed.filter(mark < max(1, min(1 << 30, (most << 30) // n))) if most < n else directed
    if most <= 1000:
        wanted = directed.orderBy(mark, "key").limit(most)
    vectors = [r["vector"] for r in wanted.select("vector").collect()]
    units = _matrix(vectors)
    return units / np.linalg.norm(units, axis=1)[:, None]


def _lay_out(tree: _Tree, assigned: DataFrame, n: int, width: int, block_rows: int) -> tuple[_Layout, DataFrame]:
    """Distances within heads and leaves, and the groups of leaves; also as a table with a row per leaf."""
    size = lambda m: (np.full(m, np.inf), np.full(m, -1.0))
    (head_low, head_high), (leaf_low, leaf_high) = size(len(tree.heads)), size(len(tree.pivots))
    rows = np.zeros(len(tree.pivots), dtype="int64")
    # At most MOST_LEAVES rows.
    figures = assigned.groupBy("head", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"),
        F.min("head_gap").alias("head_low"), F.max("head_gap").alias("head_high"),
    )
    for r in figures.collect():
        rows[r["leaf"]] += r["n"]
        leaf_low[r["leaf"]], leaf_high[r["leaf"]] = r["low"] - SLACK, r["high"] + SLACK
        head_low[r["head"]] = min(head_low[r["head"]], r["head_low"] - SLACK)
        head_high[r["head"]] = max(head_high[r["head"]], r["head_high"] + SLACK)
    tasks = 2 * assigned.sparkSession.sparkContext.defaultParallelism
    group_rows = max(block_rows, min(GROUP_BYTES // (8 * width), -(-n // tasks)))
    per_group = max(1, group_rows // block_rows)
    group, filled, pairs, table = 0, 0, [], []
    for leaf in np.flatnonzero(rows):
        blocks = -(-int(rows[leaf]) // block_rows)
        if filled and filled + blocks > per_group:
            group, filled = group + 1, 0
        table.append((int(leaf), blocks, group, per_group))
        parts = -(-blocks // per_group)
        pairs += [(group + i, int(leaf)) for i in range(parts)]
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + blocks)
    of_group = np.array([g for g, _ in pairs])
    starts = np.flatnonzero(np.diff(of_group, prepend=-1))
    layout = _Layout(head_low, head_high, leaf_low, leaf_high, np.array([leaf for _, leaf in pairs]), starts)
    return layout, assigned.sparkSession.createDataFrame(table, "leaf int, blocks bigint, first_group int, per_group int")
