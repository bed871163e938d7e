"""Language of a document by Bayesian fusion of its text, its declared language, its address suffix and its host.

Letters trigrams give a likelihood for each language, and one for no language at all. The decisions of this text model,
counted per host, per suffix and overall for all documents, give a prior that falls back from host to suffix to everything;
how often a language declares itself as which gives the likelihood of the declaration. The product decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, stage, without
from shelfscope.llm.html_extract import parse
from shelfscope.llm.ragged import BLOCK, slices, text_bytes

# Rows of each language that the text model is fitted on, about: chosen by a hash of the text, the same at any order.
SAMPLE_PER_LANGUAGE = 2000
# Languages whose slots a task spreads out at once; all languages are scored, one block of them after the other.
BLOCK_LANGUAGES = 64
# Numbers of (row, language) that a task holds at once.
MOST_NUMBERS = 1 << 20
SLOTS = 1 << 15
# Neighbouring trigrams tell much the same; each counts for this part of its log likelihood.
TEMPERATURE = 0.3
HOST_STRENGTH, SUFFIX_STRENGTH, DECLARED_STRENGTH = 20.0, 50.0, 20.0
NO_LANGUAGE = 1e-4


def _letters() -> np.ndarray:
    """What each byte counts as: letters in lower case, bytes beyond ASCII as they are, all others as a gap."""
    byte = np.arange(256)
    letter = (byte >= 0x80) | ((byte >= 0x61) & (byte <= 0x7A)) | ((byte >= 0x41) & (byte <= 0x5A))
    folded = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    return np.where(letter, folded, 0).astype(np.uint32)


_LETTER = _letters()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each trigram with two letters at least, and the first trigram of each text."""
    found, places = [], []
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        b = _LETTER[data[at : at + BLOCK + 2]]
        x, y, z = b[:-2], b[1:-1], b[2:]
        keep = np.flatnonzero((y > 0) & ((x > 0) | (z > 0)))
        slot = (x[keep] * np.uint32(0x9E3779B1) ^ y[keep] * np.uint32(0x85EBCA6B) ^ z[keep] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        found.append((slot >> np.uint32(17)).astype(np.int32))
        places.append(keep + at)
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    slot, place = np.concatenate(found), np.concatenate(places)
    inside = offsets[np.searchsorted(offsets, place, "right")] - place > 2
    return slot[inside], np.searchsorted(place[inside], offsets)


@dataclass(frozen=True)
class Model:
    """Log probability of trigram slots by language: only the slots that a language has, and one value for all its others."""

    first: np.ndarray
    slot: np.ndarray
    log: np.ndarray
    unseen: np.ndarray

    def block(self, at: int) -> np.ndarray:
        """One line of all slots for each language from ``at`` on, at most a block of them."""
        stop = min(at + BLOCK_LANGUAGES, len(self.unseen))
        out = np.repeat(self.unseen[at:stop, None], SLOTS, axis=1)
        entries = slice(self.first[at], self.first[stop])
        out[np.repeat(np.arange(stop - at), np.diff(self.first[at : stop + 1])), self.slot[entries]] = self.log[entries]
        return out


def _fit(sample: DataFrame, languages: list[str]) -> Model:
    """The text model, from the trigrams of the sample; each slot counts a tenth more than it was seen."""
    index = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "__text"):
                slot, first = trigrams(*text_bytes(part.column("__text")))
                language = np.array([index[x] for x in part.column("declared").to_pylist()], np.int64)
                key, n = np.unique(np.repeat(language, np.diff(first)) * SLOTS + slot, return_counts=True)
                yield pa.record_batch({"line": pa.array(key // SLOTS, pa.int64()), "slot": pa.array(key % SLOTS, pa.int64()), "n": pa.array(n, pa.int64())})

    counted = sample.select("__text", "declared").mapInArrow(run, "line long, slot long, n long").groupBy("line", "slot").agg(F.sum("n").alias("n")).toPandas()
    line, slot, n = (counted[c].to_numpy(np.int64) for c in ("line", "slot", "n"))
    order = np.lexsort((slot, line))
    line, slot, n = line[order], slot[order], n[order]
    total = np.bincount(line, n, len(languages)) + 0.1 * SLOTS
    return Model(np.searchsorted(line, np.arange(len(languages) + 1)), slot.astype(np.uint16), np.log((n + 0.1) / total[line]).astype(np.float32), np.log(0.1 / total).astype(np.float32))


def _score(rows: DataFrame, model: Model) -> DataFrame:
    """For each row the log likelihood of its text in each language and at last in none (all slots alike), the number of
    trigrams, and the number of the likeliest language: the first of equal ones, null for none."""
    n_lines = len(model.unseen)

    def run(batches: Iterator[pa.RecordBatch]):
        held = (0, model.block(0))
        for batch in batches:
            for part in slices(batch, "__text", rows=max(1, min(2000, MOST_NUMBERS // (n_lines + 1)))):
                slot, first = trigrams(*text_bytes(part.column("__text")))
                n_grams = np.diff(first)
                total = np.zeros((part.num_rows, n_lines + 1))
                for at in range(0, n_lines, BLOCK_LANGUAGES):
                    held = held if held[0] == at else (at, model.block(at))
                    for line, table in enumerate(held[1], at):
                        summed = np.append(0.0, np.cumsum(table[slot], dtype=np.float64))
                        total[:, line] = summed[first[1:]] - summed[first[:-1]]
                total[:, -1] = -np.log(SLOTS) * n_grams
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * (n_lines + 1), pa.int32()), pa.array(total.reshape(-1)))
                best = total.argmax(1)
                kept = {c: part.column(c) for c in ("__id", "declared", "suffix", "host")}
                yield pa.record_batch({**kept, "likelihood": lists, "n_grams": pa.array(n_grams, pa.int64()), "line": pa.array(best, pa.int64(), mask=(n_grams == 0) | (best == n_lines))})

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, declared string, suffix string, host string, likelihood array<double>, n_grams long, line long")


def _counts(scored: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """Decisions of the text model per key: a list of the languages that occur with it, each with its number of texts."""
    counted = scored.filter("line IS NOT NULL").groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy(*keys).agg(F.collect_list(F.struct("line", "n")).alias(name)).withColumnsRenamed(keys)
    return stage(grouped, name)


def _small(counts: DataFrame, name: str) -> DataFrame:
    return hinted(counts, 50, counts.agg(F.sum(F.size(name) + 4)).head()[0] or 0)


def _fuse(joined: DataFrame, languages: list[str], total: np.ndarray) -> DataFrame:
    """For each row the likeliest language by all evidence, its posterior, and the language by text alone."""
    n_lines, names = len(languages), pa.array([*languages, None], pa.string())
    p_all = total / total.sum()

    def run(batches: Iterator[pa.RecordBatch]):
        step = max(1, MOST_NUMBERS // (n_lines + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)

                def dense(name: str, part: pa.RecordBatch = part) -> np.ndarray:
                    column, out = part.column(name), np.zeros((part.num_rows, n_lines))
                    flat = pc.list_flatten(column)
                    out[pc.list_parent_indices(column).to_numpy(), flat.field("line").to_numpy()] = flat.field("n").to_numpy()
                    return out

                smooth = lambda n, parent, strength: (n + strength * parent) / (n.sum(1, keepdims=True) + strength)
                prior = smooth(dense("by_host"), smooth(dense("by_suffix"), p_all, SUFFIX_STRENGTH), HOST_STRENGTH)
                said = dense("by_declared")
                n_said = said.sum(1, keepdims=True)
                rate = (said + DECLARED_STRENGTH * n_said / total.sum()) / (total + DECLARED_STRENGTH)
                fused = TEMPERATURE * pc.list_flatten(part.column("likelihood")).to_numpy().reshape(part.num_rows, n_lines + 1)
                fused[:, :-1] += np.log(prior) + np.log(np.where(n_said > 0, rate, 1.0))
                fused[:, -1] += np.log(NO_LANGUAGE)
                some = part.column("n_grams").to_numpy() > 0
                best = np.where(some, fused.argmax(1), n_lines)
                weight = 1 / np.exp(fused - fused.max(1, keepdims=True)).sum(1)
                yield pa.record_batch({
                    "__id": part.column("__id"), "language": names.take(pa.array(best)), "posterior": pa.array(np.where(some, weight, 0.0)),
                    "text_language": names.take(part.column("line").fill_null(n_lines)),
                })

    kind = joined.schema["__id"].dataType.simpleString()
    kept = joined.select("__id", "n_grams", "line", "likelihood", "by_host", "by_suffix", "by_declared")
    return kept.mapInArrow(run, f"__id {kind}, language string, posterior double, text_language string")


def identify(
    docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, id_column: str = "doc_id", text: Column | None = None,
    least_posterior: float = 0.5, sample: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``language``, ``posterior``, ``text_language``, ``accepted``.

    ``declared``, ``host`` and ``suffix`` are expressions over ``docs``; a null one says nothing. Every declared
    value is a language, however many there are. The text model is fitted on about ``sample`` distinct texts of each, everything
    else is counted over all rows. Texts that are null, empty or without letters have no language and are not accepted, and neither are
    texts likelier in no language or without a language of at least ``least_posterior``. Of equal languages the first in
    the alphabet wins. Repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    none = F.lit(None).cast("string")
    content = docs["text"] if text is None else text
    name = F.lower(F.trim(declared.cast("string")))
    rows = docs.select(
        docs[id_column].alias("__id"), F.coalesce(content, F.lit("")).alias("__text"), F.when(name != "", name).alias("declared"),
        (none if suffix is None else suffix.cast("string")).alias("suffix"), host.cast("string").alias("host"),
    )
    named = stage(rows.filter("declared IS NOT NULL").groupBy(F.col("declared").alias("said")).agg(F.count(F.lit(1)).alias("n_said")), "named")
    languages = sorted(r["said"] for r in named.select("said").collect())
    if not languages:
        return rows.select("__id", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(False).alias("accepted"))
    picked = F.pmod(F.xxhash64("__text"), F.lit(1 << 30)) < F.least(F.lit(1.0), sample / F.col("n_said")) * (1 << 30)
    chosen = rows.join(hinted(named, 200), F.col("declared") == F.col("said")).filter(picked)
    scored = stage(_score(rows, _fit(chosen.dropDuplicates(["declared", "__text"]), languages)), "scored")

    total = np.ones(len(languages))
    for r in scored.filter("line IS NOT NULL").groupBy("line").agg(F.count(F.lit(1)).alias("n")).collect():
        total[r["line"]] += r["n"]
    suffixes = _counts(scored.filter("suffix IS NOT NULL"), {"suffix": "s"}, "by_suffix")
    hosts = _counts(scored.filter("host IS NOT NULL"), {"host": "h", "suffix": "hs"}, "by_host")
    known = _counts(scored.filter("declared IS NOT NULL"), {"declared": "d"}, "by_declared")
    joined = scored.join(_small(hosts, "by_host"), (F.col("host") == F.col("h")) & F.col("suffix").eqNullSafe(F.col("hs")), "left")
    joined = joined.join(_small(suffixes, "by_suffix"), F.col("suffix") == F.col("s"), "left").join(_small(known, "by_declared"), F.col("declared") == F.col("d"), "left")
    return _fuse(joined, languages, total).withColumn("accepted", F.col("language").isNotNull() & (F.col("posterior") >= least_posterior))


def drop_rejected(docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose language is accepted, all columns unchanged; rows without an id stay."""
    found = identify(docs, declared, host, suffix, id_column)
    return without(docs, id_column, found.filter(~F.col("accepted")).select("__id"))


def visible_text(html: str) -> str:
    """Text of all elements of a page, the title too, without scripts, styles and comments; a blank where a line breaks."""
    return "".join(" " if piece is None else piece for _, piece in parse(html).pieces)


def page_evidence(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row for each page: id, ``text`` (visible), ``declared``, ``host`` and ``suffix``, null where a page lacks them.

    Declared is the language of the html element's lang attribute, without region or script. The suffix is the last part of
    the host, if it begins with a letter: an address of numbers has none.
    """
    host = F.lower(F.regexp_extract(url_column, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.regexp_extract(html_column, r"""(?i)<html(?:\s[^>]*?)?\slang\s*=\s*["']?\s*([a-z]+)""", 1)
    rows = pages.select(pages[id_column], F.coalesce(html_column, F.lit("")).alias("__html"), declared.alias("declared"), host.alias("host"))
    rows = rows.select(id_column, "__html", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("declared", "host")])
    suffix = F.regexp_extract("host", r"\.([a-z][^.]*)\.?$", 1)
    rows = rows.withColumn("suffix", F.when(suffix != "", suffix))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "__html"):
                text = pa.array([visible_text(x) for x in part.column("__html").to_pylist()], pa.string())
                yield pa.record_batch({id_column: part.column(id_column), "text": text, **{c: part.column(c) for c in ("declared", "host", "suffix")}})

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_column}` {kind}, text string, declared string, host string, suffix string")


def identify_pages(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """``identify`` for whole web pages, with the evidence of ``page_evidence``; pages are parsed once."""
    read = stage(page_evidence(pages, id_column), "evidence")
    return identify(read, read["declared"], read["host"], read["suffix"], id_column)
