"""Token counts by rank-synchronous merging of ragged arrays.

A batch of pre-tokens lies in one flat array of symbols. In every round each pre-token looks up its adjacent pairs, finds
its lowest rank, and merges that pair wherever it stands; pre-tokens without a pair that merges leave the array, and the
number of symbols they have left is their token count. Counts of pre-tokens seen before are remembered within a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Memory, texts

REMEMBERED = 250_000
NEVER = np.int32(2**31 - 1)
SPACE = "▁"


class PieceTable:
    """Pieces of a byte-pair model with byte fallback: symbols, and which pairs of symbols merge at which rank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [i for i in range(n) if model.is_control(i) or model.is_byte(i) or model.is_unknown(i)]
        normal = sorted(set(range(n)) - set(special))
        score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        if model.encode("a", out_type=str) != [SPACE + "a"] or not any(model.is_byte(i) for i in range(n)):
            raise ValueError("needs a byte-pair model with a leading space and byte fallback")
        if any(SPACE in piece.lstrip(SPACE) for piece in score):
            raise ValueError("a piece crosses a word start")
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        characters = {c for piece in score for c in piece}
        self.symbols = {s: i for i, s in enumerate(sorted(score.keys() | characters))}
        # Tokens that a surviving symbol stands for: itself, or its bytes if it is no piece.
        self.tokens = np.array([1 if s in score else len(s.encode()) for s in sorted(self.symbols)], np.int32)
        left, right, rank, merged = [], [], [], []
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(ranks[value]), merged.append(self.symbols[piece])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], np.array(rank, np.int32)[order], np.array(merged, np.int32)[order]
        inner = {c for piece in score if len(piece) > 1 for c in piece}
        # A line end that no longer piece holds never merges, so texts may be cut there.
        self.pattern = re.compile(" +[^ \n]*|[^ \n]+|\n" if "\n" not in inner else " +[^ ]*|[^ ]+")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; symbols below zero are unknown characters and never merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token (not empty), with spaces written as they are."""
        flat = "".join(pretokens).replace(" ", SPACE)
        codes, back = np.unique(np.frombuffer(flat.encode("utf-32-le"), np.uint32), return_inverse=True)
        # An unknown character is a symbol of its own: minus the number of its bytes.
        known = np.array([self.symbols.get(chr(c), -len(chr(c).encode())) for c in codes.tolist()], np.int32)
        symbol = known[back]
        lengths = np.array([len(p) for p in pretokens], np.int64)
        counts = np.zeros(len(pretokens), np.int64)
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        rank, merged = self._pairs(symbol, owner)
        while len(symbol):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NEVER
            if done.any():
                spans = np.diff(np.append(starts, len(symbol)))
                finished = np.repeat(done, spans)
                left = symbol[finished]
                each = np.where(left >= 0, self.tokens[np.maximum(left, 0)], -left)
                counts += np.bincount(owner[finished], each, minlength=len(counts)).astype(np.int64)
                symbol, owner, rank, merged = (x[~finished] for x in (symbol, owner, rank, merged))
                if not len(symbol):
                    break
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                lowest = lowest[~done]
            symbol, owner, rank, merged = self._round(symbol, owner, rank, merged, starts, lowest)
        return counts

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(symbol), NEVER, np.int32), np.zeros(len(symbol), np.int32)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside], merged[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        return rank, merged

    def _round(self, symbol, owner, rank, merged, starts, lowest):
        """Merge the lowest pair of every sequence, everywhere at once where that equals one by one from the left."""
        spans = np.diff(np.append(starts, len(symbol)))
        place = np.flatnonzero(rank == np.repeat(lowest, spans))
        sequence = np.searchsorted(starts, place, "right") - 1
        # Of overlapping places every second one counts, from the left.
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        pick = (np.arange(len(place)) - run) % 2 == 0
        out = self._merge(symbol, owner, rank, merged, place[pick])
        several = np.bincount(sequence[pick], minlength=len(starts)) > 1
        if several.any():
            # Where a new pair ranks as low as the one just merged, it would have come first: go back to one merge there.
            floor = np.repeat(lowest, np.diff(np.append(starts, len(symbol))))
            kept = np.ones(len(symbol), bool)
            kept[place[pick] + 1] = False
            early = (out[2] <= floor[kept]) & (out[2] != NEVER)
            again = several & (np.bincount(np.searchsorted(starts, np.flatnonzero(kept)[early], "right") - 1, minlength=len(starts)) > 0)
            if again.any():
                first = np.ones(len(place), bool)
                first[1:] = sequence[1:] != sequence[:-1]
                out = self._merge(symbol, owner, rank, merged, place[pick & (first | ~again[sequence])])
        return out

    def _merge(self, symbol, owner, rank, merged, place):
        symbol, rank, merged = symbol.copy(), rank.copy(), merged.copy()
        symbol[place] = merged[place]
        keep = np.ones(len(symbol), bool)
        keep[place + 1] = False
        at = place - np.arange(len(place))
        symbol, owner, rank, merged = symbol[keep], owner[keep], rank[keep], merged[keep]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        after = np.minimum(touched + 1, len(symbol) - 1)
        inside = (touched + 1 < len(symbol)) & (owner[touched] == owner[after])
        rank[touched] = NEVER
        touched, after = touched[inside], after[inside]
        rank[touched], merged[touched] = self.lookup(symbol[touched], symbol[after])
        return symbol, owner, rank, merged


@cache
def piece_table(path: str) -> PieceTable:
    """The table of a model file, built once per process."""
    return PieceTable(path)


def count_tokens(column: list[str], table: PieceTable, memory: Memory) -> list[int]:
    """Tokens of each text. ``memory`` keeps counts of pre-tokens from one call to the next."""
    known = [list(map(memory.__getitem__, table.pattern.findall(" " + t.replace(SPACE, " ")))) if t else [] for t in column]
    fresh = memory.learn(lambda pretokens: table.count(pretokens).tolist())
    return [sum([v if v.__class__ is int else fresh[v] for v in values]) for values in known]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Null and empty texts have no bytes and no tokens. Rows are independent of each other: repeated rows are counted
    again, an empty table gives no rows, other columns are not read. ``model_path`` is opened in every task.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        table, memory = piece_table(model_path), Memory(REMEMBERED, {})
        for batch in batches:
            n_tokens, column = [], batch.column("__text")
            for at in range(0, len(column), 100):
                n_tokens += count_tokens(column.slice(at, 100).to_pylist(), table, memory)
            yield pa.record_batch({"__id": batch.column("__id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(n_tokens, pa.int64())})

    rows = texts(docs, id_column, text_column).withColumn("n_bytes", F.octet_length("__text").cast("long"))
    kind = rows.schema["__id"].dataType.simpleString()
    counted = rows.select("__id", "n_bytes", "__text").mapInArrow(run, f"__id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
