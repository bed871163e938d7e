"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its runs of five words. A shingle's weight is (1 + ln tf) times an inverse document frequency,
whose frequencies are counted over all documents in hashed slots, as many as ``slots`` at every size. Consistent weighted
sampling draws the same sample from two weighted sets with a probability equal to their weighted Jaccard similarity;
samples are banded, and every link is verified on the full shingle sets.

A bucket of a band is not expanded into pairs. All members are held against its smallest and its largest member; linked
documents become components; only members that lie in another component than the bucket's smallest are then compared
with the bucket's other members, in blocks, by their sketches first and in full where those are close. So families of
thousands cost a few comparisons a member, and no link between components of a bucket is lost to a size limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, stage, texts, without
from shelfscope.llm.components import components
from shelfscope.llm.ragged import alphanumeric, as_signed, mix, rows_of, runs, slices, text_bytes, valid_starts, words

# Members of a block, and the share of equal samples from which two members are compared in full: a pair at the
# similarity asked for falls below it about once in ten thousand.
BLOCK_MEMBERS = 512
SKETCH_SHARE = 0.6
_VARIATES = 1 << 16


@dataclass(frozen=True)
class Settings:
    """``gain`` is the weight of the rarest shingle over that of one in every document, less one.

    A plain logarithm would give a word changed in one of thousands of near copies several times the weight of the text
    they share, and tear the family apart; so the logarithm is scaled to lie between 0 and ``gain`` and added to one.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 14
    rows: int = 4
    slots: int = 1 << 18
    gain: float = 0.25


def shingles(part: pa.RecordBatch, settings: Settings, column: str = "__text"):
    """Distinct shingles of each text, sorted: hash, number of occurrences, first shingle of each text, words of each text.

    A text with fewer words than a shingle has one shingle, all its words.
    """
    if part.num_rows >= 1 << 12:
        raise ValueError("a part must have less than 4096 rows")
    found = words(*text_bytes(part.column(column)), alphanumeric())
    k, lengths = settings.words, np.diff(found.offsets)
    hashes = runs(found.hash, k)
    valid = valid_starts(found.offsets, k, len(hashes))
    row = rows_of(found.offsets)
    value, owner = hashes[valid], row[: len(hashes)][valid]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        own = []
        for r in short:
            own.append(xxhash.xxh3_64_intdigest(found.hash[found.offsets[r] : found.offsets[r + 1]].tobytes()))
        value, owner = np.concatenate([value, np.array(own, np.uint64)]), np.concatenate([owner, short])
    # 52 bits of hash below 12 bits of row: parts have fewer rows than that.
    keys = np.sort(owner.astype(np.uint64) << np.uint64(52) | value >> np.uint64(12))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    offsets = np.searchsorted(keys, np.arange(part.num_rows + 1, dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), counts, offsets, lengths


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def document_frequencies(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """Documents with a shingle in each slot, over all documents, and the number of documents. As large as ``slots``."""

    def run(batches: Iterator[pa.RecordBatch]):
        total, n = np.zeros(settings.slots, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in slices(batch, "__text"):
                hashes, _, offsets, _ = shingles(part, settings)
                pairs = np.unique(rows_of(offsets) * settings.slots + _slot(hashes, settings.slots))
                total += np.bincount(pairs % settings.slots, minlength=settings.slots)
        at = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], n), pa.int64())})

    counted = rows.select("__text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out, n = np.zeros(settings.slots, np.int64), 0
    inside = counted["slot"].to_numpy() >= 0
    out[counted["slot"].to_numpy()[inside]] = counted["n"].to_numpy()[inside]
    n = int(counted["n"].to_numpy()[~inside].sum())
    return out, n


def slot_weights(frequencies: np.ndarray, n: int, gain: float) -> np.ndarray:
    """Inverse document frequency of each slot, between 1 and 1 + gain."""
    return (1 + gain * np.log((1 + n) / (1 + frequencies)) / max(np.log(1 + n), 1e-9)).astype(np.float32)


def _weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    tf = np.ones(len(counts), np.float32)
    several = counts > 1
    tf[several] += np.log(counts[several]).astype(np.float32)
    return tf * idf[_slot(hashes, len(idf))]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variates of the sampling scheme, drawn once with a fixed seed: r, 1 / r and ln c, both Gamma(2, 1)."""
    rng = np.random.default_rng(20240501)
    r = rng.gamma(2.0, 1.0, _VARIATES).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(rng.gamma(2.0, 1.0, _VARIATES)).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """``n`` consistent weighted samples of each row that has shingles, one line per such row."""
    filled = np.flatnonzero(np.diff(offsets))
    starts, spans = offsets[filled], np.diff(offsets)[filled]
    out = np.zeros((len(filled), n), np.uint64)
    if not len(filled):
        return out
    r_of, inverse_of, c_of = _tables()
    log_weight, low = np.log(weights), np.uint64(0xFFFF)
    line = np.repeat(np.arange(len(filled)), spans)
    for k in range(n):
        seed = mix(np.array([k + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03))
        x = (hashes ^ seed[0]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        r_at = (x >> np.uint64(48)).astype(np.int32)
        c_at = (x >> np.uint64(32) & low).astype(np.int32)
        beta = (x >> np.uint64(16) & low).astype(np.float32) * np.float32(1 / _VARIATES)
        r = r_of[r_at]
        t = np.floor(log_weight * inverse_of[r_at] + beta)
        a = c_of[c_at] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[line])
        at = at[np.searchsorted(at, starts)]
        out[:, k] = mix(hashes[at] ^ (t[at].astype(np.int64).view(np.uint64) << np.uint64(52)) ^ seed[0])
    return out


def signatures(rows: DataFrame, idf: np.ndarray, settings: Settings) -> DataFrame:
    """One row per document: id, digest of the text, a hash for each band (null without words) and a sketch, one byte a sample."""
    n = settings.bands * settings.rows

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "__text"):
                hashes, counts, offsets, _ = shingles(part, settings)
                drawn = samples(hashes, _weights(hashes, counts, idf), offsets, n)
                joined = np.zeros((len(drawn), settings.bands), np.uint64)
                for j in range(settings.rows):
                    joined = mix(joined ^ drawn[:, j :: settings.rows][:, : settings.bands] + np.uint64(j + 1))
                has = np.diff(offsets) > 0
                bands = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(has)) * settings.bands, pa.int32()), pa.array(as_signed(joined.reshape(-1)), pa.int64())
                )
                sketch = iter((drawn & np.uint64(255)).astype(np.uint8))
                digests = [xxhash.xxh3_128_digest(t.as_py() or "") for t in part.column("__text")]
                yield pa.record_batch({
                    "__id": part.column("__id"), "digest": pa.array(digests, pa.binary()), "bands": bands,
                    "sketch": pa.array([next(sketch).tobytes() if h else None for h in has.tolist()], pa.binary()),
                })

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.select("__id", "__text").mapInArrow(run, f"__id {kind}, digest binary, bands array<long>, sketch binary")


def verified(pairs: DataFrame, vectors: DataFrame, idf: np.ndarray, settings: Settings) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose weighted Jaccard similarity reaches the threshold, on whole texts."""
    left = vectors.select(F.col("__id").alias("a"), F.col("__text").alias("text_a"))
    right = vectors.select(F.col("__id").alias("b"), F.col("__text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text_b", 1 << 20):
                # Neighbouring rows often share the text on the left: take its shingles once.
                first, back = np.unique(np.array(part.column("a").to_pylist()), return_index=True, return_inverse=True)[1:]
                hubs = part.take(pa.array(first))
                ha, ca, oa, _ = shingles(hubs, settings, "text_a")
                hb, cb, ob, _ = shingles(part, settings, "text_b")
                wa, wb = _weights(ha, ca, idf).astype(np.float64), _weights(hb, cb, idf).astype(np.float64)
                total_a, total_b = _sums(wa, oa), _sums(wb, ob)
                common = np.zeros(part.num_rows)
                for i in range(part.num_rows):
                    h = back[i]
                    own, other = slice(oa[h], oa[h + 1]), slice(ob[i], ob[i + 1])
                    _, x, y = np.intersect1d(ha[own], hb[other], assume_unique=True, return_indices=True)
                    common[i] = np.minimum(wa[own][x], wb[other][y]).sum()
                union = total_a[back] + total_b - common
                close = common >= settings.similarity * union - 1e-9
                yield part.filter(pa.array(close & (union > 0))).select(["a", "b"])

    kind = vectors.schema["__id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[offsets[1:]] - total[offsets[:-1]]


def _cross_links(idf: np.ndarray, settings: Settings):
    """Links of a block between members of different components: close by sketch, then verified on whole texts."""
    least = int(SKETCH_SHARE * settings.bands * settings.rows)

    def run(block: pa.Table) -> pa.Table:
        ids, comp = np.array(block.column("rep").to_pylist()), np.array(block.column("component").to_pylist())
        probe = np.array(block.column("probe").to_pylist(), bool)
        sketch = np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in block.column("sketch").to_pylist()]).T)
        first, second, vectors = [], [], None
        for i in np.flatnonzero(probe).tolist():
            alike = np.add.reduce((sketch == sketch[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint8)
            hits = np.flatnonzero((alike >= least) & (comp != comp[i]) & (~probe | (ids > ids[i])))
            if not len(hits):
                continue
            if vectors is None:
                part = pa.record_batch({"__text": block.column("__text").combine_chunks()})
                hashes, counts, offsets, _ = shingles(part, settings)
                number = np.unique(hashes, return_inverse=True)[1]
                weight = _weights(hashes, counts, idf).astype(np.float64)
                vectors, total, held = number, _sums(weight, offsets), np.zeros(len(hashes) + 1)
            own = slice(offsets[i], offsets[i + 1])
            held[vectors[own]] = weight[own]
            for j in hits.tolist():
                other = slice(offsets[j], offsets[j + 1])
                common = np.minimum(held[vectors[other]], weight[other]).sum()
                if common >= settings.similarity * (total[i] + total[j] - common) - 1e-9:
                    first.append(ids[i]), second.append(ids[j])
            held[vectors[own]] = 0
        kind = block.schema.field("rep").type
        return pa.table({"a": pa.array(first, kind), "b": pa.array(second, kind)})

    return run


def _residual(members: DataFrame, names: DataFrame, vectors: DataFrame, idf: np.ndarray, settings: Settings) -> DataFrame:
    """Links of a bucket across its components, found in blocks of bounded size.

    Members outside the component of the bucket's smallest member are probes. A block holds up to about ``BLOCK_MEMBERS``
    probes and as many others, with their texts; each probe block meets each block of the bucket.
    """
    kind = members.schema["rep"].dataType.simpleString()
    known = members.join(names, members["rep"] == names["node"], "left").select("band", "value", "rep", "sketch", F.coalesce("component", "rep").alias("component"))
    known = stage(known, "known")
    of_bucket = known.groupBy("band", "value").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("component", "rep").alias("main"), F.count(F.lit(1)).alias("n"))
    mixed = stage(of_bucket.filter(F.col("least") != F.col("most")).drop("least", "most"), "mixed")
    inside = known.join(hinted(mixed, 64), ["band", "value"]).withColumn("probe", F.col("component") != F.col("main"))
    inside = stage(inside.select("band", "value", "rep", "sketch", "component", "probe"), "inside")
    sizes = inside.groupBy("band", "value").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("others"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_MEMBERS).cast("int")
    sizes = stage(sizes.select("band", "value", blocks("probes").alias("p"), F.greatest(blocks("others"), F.lit(1)).alias("o")), "sizes")
    placed = inside.join(hinted(sizes, 64), ["band", "value"]).withColumn("h", F.xxhash64("rep"))
    probes = placed.filter("probe").withColumn("mine", F.pmod("h", "p").cast("int"))
    # A probe meets all blocks of others once, and each block of probes from its own on.
    to_others = probes.select("*", F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias("other")).withColumn("kind", F.lit("o"))
    others = placed.filter(~F.col("probe")).withColumn("other", F.pmod("h", "o").cast("int")).withColumn("kind", F.lit("o"))
    others = others.select("*", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("mine"))
    first = probes.select("*", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("other")).withColumn("kind", F.lit("p"))
    first = first.select("*", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    keys = ["band", "value", "kind", "mine", "other"]
    columns = [*keys, "rep", "component", "sketch", "probe"]
    paired = first.drop("mine", "other").withColumnsRenamed({"x": "mine", "y": "other"})
    rows = to_others.select(columns).unionByName(others.select(columns)).unionByName(paired.select(columns))
    texts_of = vectors.select(F.col("__id").alias("rep"), "__text")
    found = rows.join(texts_of, "rep").groupBy(*keys).applyInArrow(_cross_links(idf, settings), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:  # noqa: B008
    """One row per document: ``__id``, ``class_id`` (smallest id with the same text), ``group_id`` (smallest id of all
    documents linked with it, directly or over others), ``n_links`` (links found between its text and other texts) and ``kept``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case for A-Z. Null and empty texts,
    and texts without words, are linked with nothing but equal texts. Rows that repeat id and text are returned each. The
    document that gives a group its name stays, and a row without an id always. An empty table gives no rows; other
    columns are not read.
    """
    rows = texts(docs, id_column, text_column)
    frequencies, n = document_frequencies(rows, settings)
    idf = slot_weights(frequencies, n, settings.gain)
    signed = stage(signatures(rows, idf, settings), "signatures")
    classes = signed.groupBy("digest").agg(F.min("__id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stage(classes, "classes")
    members = classes.filter(F.col("rep").isNotNull()).select("rep", "sketch", F.posexplode("bands").alias("band", "value"))
    buckets = members.groupBy("band", "value").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter(F.col("low") != F.col("high"))
    buckets = stage(buckets, "buckets")
    members = stage(members.join(hinted(buckets, 64), ["band", "value"]), "members")

    involved = stage(members.select(F.col("rep").alias("wanted")).distinct(), "involved")
    vectors = rows.join(hinted(involved, 32), F.col("__id") == F.col("wanted"), "left_semi").dropDuplicates(["__id"])
    vectors = stage(vectors, "vectors")
    stars = members.select(F.col("low").alias("a"), F.col("rep").alias("b")).unionByName(members.select(F.col("high").alias("a"), F.col("rep").alias("b")))
    links = stage(verified(stars.filter("a != b").distinct(), vectors, idf, settings), "links")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = components(links)
    more = stage(_residual(members.drop("low", "high"), names, vectors, idf, settings), "more")
    if not more.isEmpty():
        links = links.unionByName(more).distinct()
        names = components(links)

    ends = links.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("digest", "rep").join(names, F.col("rep") == F.col("node"), "left").join(ends, F.col("rep") == F.col("end"), "left")
    named = stage(named.select("digest", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    return signed.select("__id", "digest").join(named, "digest").select(
        "__id", "class_id", "group_id", "n_links", (F.col("__id").isNull() | (F.col("__id") == F.col("group_id"))).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:  # noqa: B008
    """Rows of ``docs`` with one document for each group, all columns unchanged. Rows without an id stay; of rows that
    repeat the id that stays one does."""
    found = near_duplicates(docs, settings, id_column, text_column)
    per_id = found.filter(F.col("__id").isNotNull()).groupBy("__id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    changed = stage(per_id.filter("n > 1 OR NOT stays"), "changed")
    left = without(docs, id_column, changed.select("__id"))
    again = changed.filter("stays").toDF(*[f"{id_column}__{c}" for c in ("again", "stays", "n")])
    if again.isEmpty():
        return left
    once = docs.join(hinted(again, 32), docs[id_column] == again[0], "left_semi").dropDuplicates([id_column])
    return left.unionByName(once)
