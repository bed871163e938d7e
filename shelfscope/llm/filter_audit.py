"""Interaction of quality filters: what each filter removes in every order of application.

Every document is reduced to a mask of the filters it fails, and documents to counts of (part, mask) cells. A cell is
folded across the array of all orders: ``transform`` over orders, ``aggregate`` over the steps of one. That gives a
struct of weighted counts for each step of each order, and structs of the cells of a part are summed place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.common import stage

LETTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few different words, many capitals, table signs."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by ``part`` and ``mask``: documents, documents of quality 1, toxic documents.

    The first document of a text is found by a minimum over digests, which tasks take before the shuffle, and keeps the
    rows it stands for with it; whatever else has the text fails filter E. So nothing is joined on a text, however many
    documents share it.
    """
    text = F.coalesce("text", F.lit(""))
    digested = stage(
        docs.select(
            F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")
        ),
        "digests",
    )
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(one("quality"), one("toxic"))
    marked = digested.filter("id IS NOT NULL").join(marks, "id", "left").fillna(0, ["quality", "toxic"])
    # Both groupings keep the join's distribution by id.
    rows = marked.groupBy("id", "digest", "part", "mask", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    by_document = rows.groupBy("id", "digest").agg(F.collect_list(F.struct("part", "mask", "quality", "toxic", "n")).alias("rows"))
    by_document = stage(by_document, "audited")
    firsts = by_document.groupBy("digest").agg(F.min_by("rows", "id").alias("rows"))
    nameless = digested.filter("id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})

    def counted(source: DataFrame) -> DataFrame:
        each = source.select(F.explode("rows").alias("r")).select("r.*")
        return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))

    signed = lambda df, mask, sign: df.select("part", mask.alias("mask"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
    plain, last = F.col("mask"), F.col("mask") + (1 << LETTERS.index("E"))
    every, first = counted(by_document), stage(counted(firsts), "firsts")
    cells = signed(every, last, 1).unionByName(signed(first, last, -1)).unionByName(signed(first, plain, 1)).unionByName(signed(nameless, plain, 1))
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).filter("n > 0")


def folded(mask: Column, n: Column, good: Column, toxic: Column, orders: Column) -> Column:
    """For each order an array of one struct of counts for each step, for documents that all fail the filters of ``mask``."""

    def step(order: Column):
        def apply(state: Column, place: Column) -> Column:
            letter = F.substring(order, place, 1)
            bit = F.pow(F.lit(2), F.ascii(letter) - ord("A")).cast("int")
            fails, left = mask.bitwiseAND(bit) != 0, state["left"]
            stays = left & ~fails
            weigh = lambda condition, value: F.when(condition, value).otherwise(F.lit(0).cast("long"))
            counts = (weigh(stays, n), weigh(left & fails, n), weigh(~left & fails, n), weigh(mask == bit, n), weigh(left & fails, good), weigh(left & fails, toxic))
            row = F.struct(order.alias("filter_order"), place.alias("step"), *[c.alias(name) for c, name in zip(counts, COUNTS, strict=True)])
            return F.struct(stays.alias("left"), F.concat(state["rows"], F.array(row)).alias("rows"))

        return apply

    kind = "array<struct<filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("left"), F.array().cast(kind).alias("rows"))
    places = F.sequence(F.lit(1), F.lit(len(LETTERS)))
    return F.transform(orders, lambda order: F.aggregate(places, start, step(order), lambda state: state["rows"]))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; see the module for the counts.

    ``part`` is the value of ``lang``; null and empty are one part. Null texts are empty texts and fail filter A. Filter E
    fails every document whose text a smaller id has too; rows that repeat the first id of a text all pass it, and so
    do rows without an id, which no label reaches either. An id labelled more than once is good or toxic if any of its
    labels says so. Repeated rows count as often as they stand there. An empty table gives no rows; columns other than
    doc_id, text and lang, and doc_id, quality and toxic, are not read.
    """
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(LETTERS))), ",")
    cells = mask_cells(docs, labels)
    each = cells.select("part", F.explode(F.flatten(folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), orders))).alias("r")).select("part", "r.*")
    summed = each.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    same_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return summed.withColumn("shapley", F.sum("removed").over(same_filter))
