"""Connected components of a graph given as pairs, with the smallest member as name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (columns ``a`` and ``b``, ids that can be ordered).

    Each round a node takes the smallest name around it, then the name of its name; every round is a written table, and
    the rounds grow with the logarithm of the longest chain for chains that shrink by both steps. No node's links are gathered anywhere: both
    steps are joins and minima, which combine before they are shuffled.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    names = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "names")
    while True:
        around = both.join(names, both["b"] == names["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = names.join(around, names["node"] == around["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        lower = stage(lower, "lower")
        heads = lower.select(F.col("node").alias("head"), F.col("component").alias("of_head"))
        jumped = lower.join(heads, lower["component"] == heads["head"]).select("node", F.least("component", "of_head").alias("component"), "before")
        jumped = stage(jumped, "names")
        names = jumped.select("node", "component")
        if jumped.filter(F.col("component") != F.col("before")).isEmpty():
            return names
