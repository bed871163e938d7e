"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``span`` consecutive words the smallest hash of a run of ``gram`` words is kept, on both sides. Two texts that
share ``span`` words share the kept hash of that stretch, so the join of the two fingerprint tables finds every document
with a shared stretch. Each hit is then extended: the windows around it are compared word by word with the benchmark's.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import hinted, let, stage, texts, without

WINDOW = 13
GRAM = 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _combined(values: Column, width: int, join) -> Column:
    """``join`` over each ``width`` consecutive values, by doubling the reach. The last width - 1 entries are partial."""
    shifted = lambda x, by: F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))
    plan, reach = [], 1
    while reach < width:
        step = min(reach, width - reach)
        plan.append(step)
        reach += step

    def apply(x: Column, steps: list[int]) -> Column:
        if not steps:
            return x
        return let(F.zip_with(x, shifted(x, steps[0]), join), lambda y: apply(y, steps[1:]))

    return apply(values, plan)


def gram_hashes(words: Column, gram: int) -> Column:
    """Hash of each run of ``gram`` words, one for each start."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    full = lambda x: F.slice(x, 1, F.greatest(F.size(x) - (gram - 1), F.lit(0)))
    return let(hashed, lambda h: let(_combined(h, gram, lambda a, b: F.xxhash64(a, b)), full))


def winnowed(words: Column, gram: int, span: int) -> Column:
    """Smallest gram hash of each stretch of ``span`` words, each value once."""
    width = span - gram + 1
    full = lambda x: F.slice(x, 1, F.greatest(F.size(x) - (width - 1), F.lit(0)))
    least = lambda g: let(_combined(g, width, lambda a, b: F.least(a, b)), full)
    return F.array_distinct(let(gram_hashes(words, gram), least))


def benchmark_windows(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """(item, words of the window joined by blanks, number of words); a shorter item is one window, one without words none."""
    items = texts(benchmark, id_column, text_column).select("__id", split_words(ascii_lower(F.col("__text"))).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    each = items.select("__id", "ws", F.explode(starts).alias("s")).select("__id", F.slice("ws", F.col("s"), F.lit(window)).alias("w"))
    return each.select(F.col("__id").alias("item"), F.array_join("w", " ").alias("words"), F.size("w").alias("m")).distinct()


def _windows_around(near: Column, lengths: list[int], gram: int, n_words: Column) -> Column:
    """(start, m) of the windows inside a text around runs of ``gram`` words that start at ``near``, each once.

    A window is a number until the repeated ones are gone: Spark finds distinct numbers by hash, distinct structs by
    comparing all with all.
    """
    wide = max(lengths) + 1

    def of_length(m: int) -> Column:
        return F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.greatest(p - (m - gram), F.lit(0)), p), lambda s: s * wide + m)))

    start, m = lambda x: F.floor(x / wide).cast("int"), lambda x: (x % wide).cast("int")
    each = F.array_distinct(F.concat(*[of_length(n) for n in lengths]))
    inside = F.filter(each, lambda x: start(x) + m(x) <= n_words)
    return F.transform(inside, lambda x: F.struct(start(x).alias("start"), m(x).alias("m")))


def _covered(places: Column) -> Column:
    """Number of words in the union of [start, start + m) over sorted (start, m)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def add(acc: Column, p: Column) -> Column:
        end = p["start"] + p["m"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], p["start"]), F.lit(0))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(places), zero, add)["n"]


def _prints(rows: DataFrame, gram: int, span: int) -> DataFrame:
    """Number of words and fingerprint of each document.

    Only A-Z are folded, as in the benchmark's windows: how other letters fold may depend on what stands beside them.
    """
    found = let(split_words(ascii_lower(F.col("__text"))), lambda ws: F.struct(F.size(ws).alias("n_words"), winnowed(ws, gram, span).alias("prints")))
    return rows.select("__id", "text_hash", found.alias("f")).select("__id", "text_hash", F.col("f.n_words").cast("long").alias("n_words"), F.col("f.prints").alias("prints"))


def _occurring(rows: DataFrame, prints: DataFrame, windows: DataFrame, lengths: list[int], gram: int, span: int) -> DataFrame:
    """(__id, text_hash, start, m, words) of every occurrence of a benchmark window in a document."""
    kept = windows.select(F.explode(winnowed(F.split("words", " "), gram, span)).alias("print")).distinct()
    kept = stage(kept, "benchmark")
    candidates = prints.select("__id", "text_hash", F.explode("prints").alias("print")).join(hinted(kept, 32), "print")
    candidates = candidates.groupBy("__id", "text_hash").agg(F.collect_set("print").alias("hits"))
    candidates = stage(candidates.select(F.col("__id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits"), "candidates")

    same = F.col("__id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    hit = rows.join(hinted(candidates, 400), same).select("__id", "text_hash", "__text", "hits")
    hit = hit.select("__id", "text_hash", "hits", split_words(ascii_lower(F.col("__text"))).alias("ws"))
    near = let(gram_hashes(F.col("ws"), gram), lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: F.array_contains(F.col("hits"), F.get(g, p))))
    hit = hit.select("__id", "text_hash", near.alias("near"), "ws")
    places = hit.select("__id", "text_hash", "ws", _windows_around(F.col("near"), lengths, gram, F.size("ws")).alias("places"))
    text = lambda ws: lambda x: F.struct(x["start"].alias("start"), x["m"].alias("m"), F.array_join(F.slice(ws, x["start"] + 1, x["m"]), " ").alias("words"))
    tried = places.select("__id", "text_hash", F.explode(let(F.col("ws"), lambda ws: F.transform("places", text(ws)))).alias("x")).select("__id", "text_hash", "x.*")
    distinct = stage(windows.select("words").distinct(), "texts")
    return tried.join(hinted(distinct, 160), "words").select("__id", "text_hash", "start", "m", "words").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: ``__id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Words are lower-cased for A-Z only. A document word is hit if an occurrence of a benchmark window covers it. Null and
    empty texts have no words and are clean; items without words are ignored; repeated items count once; repeated rows of
    ``docs`` are returned each with the same figures. Empty tables give no rows, or clean ones. Other columns are not read.
    The guaranteed span is the window; items shorter than a window are found by fingerprints of a shorter span.
    """
    windows = stage(benchmark_windows(benchmark, window, item_column, item_text_column), "windows")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most ``window`` numbers
    rows = texts(docs, id_column, text_column).select("__id", F.xxhash64("__text").alias("text_hash"), "__text")
    base = stage(_prints(rows, gram, window), "prints")
    tried = [_occurring(rows, base, windows.filter(F.col("m") == window), [window], gram, window)] if window in lengths else []
    short = [m for m in lengths if m < window]
    if short:
        # Items shorter than a window have a guaranteed span of their own, as long as the shortest of them.
        least = min(gram, short[0])
        tried.append(_occurring(rows, _prints(rows, least, short[0]), windows.filter(F.col("m") < window), short, least, short[0]))
    none = rows.select("__id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("m"), F.lit("").alias("words")).limit(0)
    occurring = stage(reduce(DataFrame.unionByName, tried, none), "occurring")

    hits = occurring.groupBy("__id", "text_hash").agg(_covered(F.collect_list(F.struct("start", "m"))).cast("long").alias("n_hit"))
    items = occurring.select("__id", "text_hash", "words").distinct().join(hinted(windows, 160), "words").select("__id", "text_hash", "item").distinct()
    listed = items.groupBy("__id", "text_hash").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("items"))
    figures = hits.withColumnsRenamed({"__id": "f_id", "text_hash": "f_hash"}).join(listed.withColumnsRenamed({"__id": "l_id", "text_hash": "l_hash"}), F.col("f_id").eqNullSafe(F.col("l_id")) & (F.col("f_hash") == F.col("l_hash")), "left")
    figures = stage(figures.select("f_id", "f_hash", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256")), "figures")
    joined = base.select("__id", "text_hash", "n_words").join(hinted(figures, 160), F.col("__id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "__id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns unchanged; rows without an id stay."""
    found = contamination(docs, benchmark, id_column=id_column, text_column=text_column)
    return without(docs, id_column, found.filter("contaminated").select("__id"))
