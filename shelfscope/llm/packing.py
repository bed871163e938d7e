"""Packing token sequences by minimum bin slack.

Documents become tails shorter than a window and pieces that fill a window alone. The histogram of tail lengths, which has fewer
entries than a window has tokens however many documents there are, is planned on the driver: the longest tail left opens a
window, a subset-sum over bitsets finds the lengths that fill it closest to capacity, their counts are traced back, and the
choice is repeated while the counts last. Lengths that leave too much slack are strung together and cut at window ends.
Tasks then look up the place of every piece by its rank among pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, stage, texts
from shelfscope.llm.ragged import slices

REMEMBERED = 250_000
# Texts are encoded together up to this many bytes, new words up to this many pre-tokens.
TOGETHER = 4 << 20
IN_A_CALL = 1000
# New words are encoded, and ids of texts put together, this many words at a time, so that what is only needed meanwhile stays small.
WORDS_AT_A_TIME = 1 << 14
# Words that the tokenizer only folds to lower case, and how it then splits them; a line end parts words.
LETTERS = "a-zªµºß-öø-ÿ"
PLAIN = re.compile(f"[!-~¡§«°»¿À-ÖØ-Þ{LETTERS}]+")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\n0-9{LETTERS}]+|\n")
SAMPLE = ["Größe", "it's", "ÉTÉ1984.,", "«¿qué?»", "''re-d'", "x", "naïveté"]
# Pieces of one length are ranked in groups of about this many.
RANK_GROUP = 2000


class Encoder:
    """Token ids of whole texts as little-endian bytes, from a memory of words of bounded size.

    No token of the vocabulary spans a blank or a line end, so words between them are encoded alone. Texts within
    Latin-1 are folded to lower case first, as the tokenizer does itself, which makes fewer distinct words. The distinct
    words of a list of texts are looked up once, and those not remembered are encoded many in a call.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marked, self.ends = _marked(self.tokenizer)
        # Remembered words, their ids one behind the other, and where each word's begin.
        self.words, self.flat, self.starts = pa.array([""], pa.large_string()), np.zeros(0, "<u4"), np.zeros(2, np.int64)
        alone, joined, *both = [e.ids for e in self.tokenizer.encode_batch_fast(["Ab cd", "ab\ncd", "ab", "cd"], add_special_tokens=False)]
        if alone != joined or alone != sum(both, []):
            raise ValueError("needs a vocabulary of words in lower case, without white space")
        if any((x != y).any() for x, y in zip(self._by_model(SAMPLE), self._by_library(SAMPLE), strict=True)):
            raise ValueError("needs a byte-level model of letters, digits, the short English endings and the rest")

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind the other, and how many each has."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in encoded for i in ids], "<u4"), np.array([len(ids) for ids in encoded], np.int64)

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of ``PLAIN`` characters, which normalising and splitting treat in a known way, by the model alone."""
        found = SPLIT.findall("\n".join(words).lower() + "\n")
        pretokens = [p for p in found if p != "\n"]
        last = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found))) - np.arange(1, len(words) + 1)
        calls = ["\n".join(pretokens[at : at + IN_A_CALL]) + "\n" for at in range(0, len(pretokens), IN_A_CALL)]
        encoded = self.marked.encode_batch_fast([c.encode().decode("latin-1") for c in calls], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in encoded])
        return ids, np.diff(np.flatnonzero(self.ends[ids])[last], prepend=-1)

    def _learned(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words, where each word's begin, and how many it has."""
        flat, begin, count = zip(*[self._encoded(new.slice(at, WORDS_AT_A_TIME).to_pylist()) for at in range(0, len(new), WORDS_AT_A_TIME)], strict=True)
        before = np.cumsum([0] + [len(x) for x in flat[:-1]])
        return np.concatenate(flat), np.concatenate([b + n for b, n in zip(begin, before, strict=True)]), np.concatenate(count)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for some words."""
        plain = np.array([PLAIN.fullmatch(w) is not None and "<|" not in w for w in words], bool)
        order, begin, count, parts = np.argsort(~plain, kind="stable"), np.empty(len(words), np.int64), np.empty(len(words), np.int64), []
        for method, of in ((self._by_model, plain), (self._by_library, ~plain)):
            if of.any():
                ids, count[of] = method(list(compress(words, of)))
                parts.append(ids)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(parts), begin, count

    def ids(self, column: list[str]) -> list[bytes]:
        out = self._ids(column) if column else []
        # Arrow keeps what it freed for later, in each worker of an executor and beyond the end of the query.
        pa.default_memory_pool().release_unused()
        return out

    def _ids(self, column: list[str]) -> list[bytes]:
        split = pa.compute.split_pattern(pa.array([_folded(t).replace("\n", " ") for t in column], pa.large_string()), " ")
        # Remembered words come first, so that a word's code is its place among them or among the new ones behind them.
        coded, first = pa.chunked_array([self.words, split.flatten()]).dictionary_encode().chunk(1), split.offsets.to_numpy()
        del split
        flat, begin, count, known = self.flat, self.starts[:-1], np.diff(self.starts), len(self.words)
        if len(coded.dictionary) > known:
            ids, at, n = self._learned(coded.dictionary.slice(known))
            flat, begin, count = np.concatenate([flat, ids]), np.concatenate([begin, at + len(flat)]), np.concatenate([count, n])
            if known < REMEMBERED:
                self.words = coded.dictionary.take(pa.array(np.arange(min(REMEMBERED, len(begin)))))
                self.flat, self.starts = _strung(flat, begin[:REMEMBERED], count[:REMEMBERED])
        code, out, row = coded.indices.to_numpy(), [], 0
        while row < len(column):
            # As many texts as have so many words together, one at least.
            stop = max(row + 1, int(np.searchsorted(first, first[row] + WORDS_AT_A_TIME, "right")) - 1)
            some = code[first[row] : first[stop]]
            ids, starts = _strung(flat, begin[some], count[some])
            out += [ids[a:b].tobytes() for a, b in pairwise(starts[first[row : stop + 1] - first[row]].tolist())]
            row = stop
        return out


def _strung(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` one behind the other, and where each begins and the last one ends."""
    starts = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(count, out=starts[1:])
    return flat[np.repeat(begin - starts[:-1], count) + np.arange(starts[-1])], starts


def _folded(text: str) -> str:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per process."""
    return Encoder(path)


def _marked(tokenizer) -> tuple:
    """The model of a tokenizer over words each followed by a line end, and which of its tokens end a word.

    The line end joins the byte before it ahead of all other merges, which gives what the model itself begins a word's end
    with, and nothing joins on behind it: so the ids of many words in one text are those of each word alone.
    """
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    model = json.loads(tokenizer.to_str())["model"]
    suffix = model["end_of_word_suffix"]
    if model["type"] != "BPE" or not suffix or any(model[k] for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        raise ValueError("needs a byte-pair model with a mark at word ends")
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(0x100) if b not in shown]
    # Bytes as characters of the same number; a line end inside a word, which only the whole library meets, as one beyond.
    byte = {0x100 + n: chr(b) if b != 0x0A else chr(0x100) for n, b in enumerate(hidden)}
    spelled = {t: t.removesuffix(suffix).translate(byte) + ("\n" if t.endswith(suffix) else "") for t in model["vocab"]}
    vocabulary = {spelled[t]: i for t, i in model["vocab"].items()}
    singles = [t for t in vocabulary if len(t) == 1]
    if len(vocabulary) != len(spelled) or "\n" in vocabulary or any(t + "\n" not in vocabulary for t in singles):
        raise ValueError("needs a byte-level vocabulary with each byte inside and at the end of a word")
    merges = [(spelled[a], spelled[b]) for a, b in model["merges"]]
    if any("\n" in a for a, _ in merges):
        raise ValueError("a merge goes on behind a word end")
    ends = np.zeros(max(vocabulary.values()) + 2, bool)
    ends[[i for t, i in vocabulary.items() if t[-1] == "\n"]] = True
    vocabulary["\n"] = len(ends) - 1
    # Calls are too long to be met again: no cache.
    return Tokenizer(BPE(vocabulary, [(t, "\n") for t in singles] + merges, cache_capacity=0)), ends


@dataclass
class Plan:
    """Where pieces go: (length, first rank, pieces per window, first window, offset), and what is left of each length."""

    window: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=dict)
    stream: dict[int, int] = field(default_factory=dict)
    stream_tokens: int = 0
    windows: int = 0


def fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths and how many of each whose sum comes closest to ``capacity`` without passing it; long ones first."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity or reach >> capacity & 1:
            continue
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def make_plan(counts: dict[int, int], window: int, slack: int) -> Plan:
    """Plan for tails given as length -> number. At most ``slack`` tokens of a window with whole tails stay empty."""
    plan, left, aside = Plan(window), dict(counts), {}
    rank = dict.fromkeys(counts, 0)
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fill(window - longest, {k: v for k, v in rest.items() if v})
        used[longest] = used.get(longest, 0) + 1
        if sum(k * v for k, v in used.items()) < window - slack:
            aside[longest] = left.pop(longest)
            continue
        times, offset = min(left[k] // v for k, v in used.items()), 0
        for length in sorted(used, reverse=True):
            n = used[length]
            plan.rows.append((length, rank[length], n, plan.windows, offset))
            rank[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        plan.windows += times
    plan.placed = rank
    for length in sorted(aside):
        plan.stream[length] = plan.stream_tokens
        plan.stream_tokens += length * aside[length]
    return plan


def last_cuts(tokens: int) -> list[int]:
    """Ends of the powers of two that make up the last, incomplete window of the stream."""
    ends, at = [], 0
    for bit in reversed(range(tokens.bit_length())):
        if tokens >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class Places:
    """Looks up places by length and rank."""

    def __init__(self, plan: Plan):
        rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
        self.plan, self.rows = plan, rows
        self.keys = rows[:, 0] << 44 | rows[:, 1]
        full = plan.stream_tokens // plan.window * plan.window
        self.tail_start, self.tail_ends = full, [full + e for e in last_cuts(plan.stream_tokens - full)]

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the tail, length, window, offset) of each part of a tail."""
        plan = self.plan
        if rank < plan.placed.get(length, 0):
            _, first, n, window, offset = self.rows[np.searchsorted(self.keys, length << 44 | rank, "right") - 1].tolist()
            return [(0, length, window + (rank - first) // n, offset + (rank - first) % n * length)]
        at = plan.stream[length] + (rank - plan.placed[length]) * length
        end, begun, parts = at + length, at, []
        while at < end:
            if at < self.tail_start:
                start, number = at // plan.window * plan.window, at // plan.window
                stop = start + plan.window
            else:
                k = int(np.searchsorted(self.tail_ends, at, "right"))
                start, stop = ([self.tail_start] + self.tail_ends)[k], self.tail_ends[k]
                number = self.tail_start // plan.window + k
            parts.append((at - begun, min(end, stop) - at, plan.windows + number, at - start))
            at = min(end, stop)
        return parts


def _measure(vocabulary: str, separator: int, window: int):
    mark = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(vocabulary)
        for batch in batches:
            tokens, whole, tails = [], [], []
            for part in slices(batch, "__text", TOGETHER):
                for ids in encode.ids(part.column("__text").to_pylist()):
                    ids = memoryview(ids + mark)
                    n, step = len(ids) // 4, window * 4
                    tokens.append(n)
                    cut = n // window * step
                    whole.append([zlib.crc32(ids[a : a + step]) for a in range(0, cut, step)])
                    tails.append(zlib.crc32(ids[cut:]))
            yield pa.record_batch({
                "__id": batch.column("__id"), "text_hash": batch.column("text_hash"), "doc_tokens": pa.array(tokens, pa.int64()),
                "whole": pa.array(whole, pa.list_(pa.int64())), "tail_crc": pa.array(tails, pa.int64()),
            })

    return run


def _cut_crcs(vocabulary: str, separator: int):
    mark = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(vocabulary)
        for batch in batches:
            out = []
            for part in slices(batch, "__text", TOGETHER):
                rows = part.drop_columns(["__text"]).to_pylist()
                for row, ids in zip(rows, encode.ids(part.column("__text").to_pylist()), strict=True):
                    ids = memoryview(ids + mark)
                    for p in row["pieces"]:
                        a = p["start"] * 4
                        out.append({"__id": row["__id"], **p, "ids_crc32": zlib.crc32(ids[a : a + p["length"] * 4])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("__id", batch.schema.field("__id").type), *[(c, pa.int64()) for c in PIECE]]))

    return run


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _ranked(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """Pieces with their rank among those of the same length; a frequent length is ranked in many groups.

    ``lengths`` has ``n``, the number of pieces of each ``length``.
    """
    # Not a table made of rows on the driver: Spark reads that through further Python workers, which executors keep.
    groups = lengths.select("length", F.ceil(F.col("n") / RANK_GROUP).alias("groups"))
    hashed = F.xxhash64("__id", "text_hash", "start")
    keyed = pieces.join(F.broadcast(groups), "length").withColumn("slice", F.pmod(hashed, "groups")).drop("groups")
    per_group = keyed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(per_group.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    own = Window.partitionBy("length", "slice").orderBy("__id", "text_hash", "start")
    rank = F.row_number().over(own) - 1 + F.col("base")
    return keyed.join(hinted(bases, 40), ["length", "slice"]).withColumn("rank", rank).drop("slice", "base")


def pack(
    docs: DataFrame, vocabulary: str, separator: int, window: int = 4096, slack: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per piece: ``__id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are the separator alone. Repeated rows are packed once each; rows without an id are packed too.
    An empty table gives no rows; other columns are not read. Windows of whole tails are filled but for at most ``slack`` tokens; the
    other sequences are full or a power of two long. Ties go by id, text and start, so places are the same in each run.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    rows = texts(docs, id_column, text_column).select("__id", F.xxhash64("__text").alias("text_hash"), "__text")
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, text_hash long, doc_tokens long, whole array<long>, tail_crc long"
    measured = stage(rows.mapInArrow(_measure(vocabulary, separator, window), schema), "measured")

    tail = F.pmod("doc_tokens", F.lit(window))
    whole = measured.select("__id", "text_hash", "doc_tokens", F.posexplode("whole").alias("k", "ids_crc32"))
    whole = whole.select("__id", "text_hash", "doc_tokens", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32")
    tails = measured.filter(tail > 0).select("__id", "text_hash", "doc_tokens", (F.col("doc_tokens") - tail).alias("start"), tail.alias("length"), F.col("tail_crc").alias("ids_crc32"))
    pieces = whole.unionByName(tails)
    lengths = stage(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in lengths.collect()}
    plan = make_plan({k: v for k, v in counts.items() if k < window}, window, slack)
    full_base = plan.windows + plan.stream_tokens // window + plan.stream_tokens.bit_length()

    def place(batches: Iterator[pa.RecordBatch]):
        places = Places(plan)
        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            parts = [[(0, window, full_base + r, 0)] if n == window else places.of(n, r) for n, r in zip(lengths, ranks, strict=True)]
            take = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            at, length, sequence, offset = (pa.array(x, pa.int64()) for x in zip(*[q for p in parts for q in p], strict=True)) if parts else [pa.array([], pa.int64())] * 4
            out = batch.take(take)
            start = pa.compute.add(out.column("start"), at)
            crc = pa.compute.if_else(pa.compute.equal(length, out.column("length")), out.column("ids_crc32"), pa.scalar(None, pa.int64()))
            yield pa.record_batch({"__id": out.column("__id"), "text_hash": out.column("text_hash"), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": out.column("doc_tokens"), "sequence_id": sequence, "offset": offset})

    ranked = _ranked(pieces, lengths).select("__id", "text_hash", "start", "length", "ids_crc32", "doc_tokens", "rank")
    columns = ", ".join(f"{c} long" for c in PIECE)
    placed = stage(ranked.mapInArrow(place, f"__id {kind}, text_hash long, {columns}"), "placed")

    cut = placed.filter(F.col("ids_crc32").isNull()).groupBy("__id", "text_hash").agg(F.collect_list(F.struct(*[c for c in PIECE if c != "ids_crc32"])).alias("pieces"))
    cut = stage(cut, "cut").select(F.col("__id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "pieces")
    wanted = F.col("__id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash"))
    again = rows.join(hinted(cut, 120), wanted).dropDuplicates(["__id", "text_hash"]).select("__id", "__text", "pieces")
    redone = again.mapInArrow(_cut_crcs(vocabulary, separator), f"__id {kind}, {columns}")
    return placed.filter(F.col("ids_crc32").isNotNull()).select("__id", *PIECE).unionByName(redone.select("__id", *PIECE))
