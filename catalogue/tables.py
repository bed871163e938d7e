"""The test tables, and views on them that stand for the logical tables of the library."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions.columns import MICROS_PER_DOLLAR, pad_code
from shelfscope.operators.ordered import deal, rank_rows_by


class Tables:
    """Reads ``<folder>/<name>.parquet`` on attribute access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        # Reached only for names not set yet, so each table is opened once.
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    @cached_property
    def listing(self) -> DataFrame:
        """One row per order and part: an order is a result page, a part a listed product."""
        lines = deal(self.lineitem, ["l_orderkey", "l_partkey"])
        return lines.groupBy(F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("sku")).agg(
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("click"),
            F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("monetized"),
            F.min("l_linenumber").alias("pos"),
            F.max("l_extendedprice").alias("score"),
            F.min("l_quantity").alias("qty"),
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Listings of which those with quantity 1 lack a score."""
        return self.listing.withColumn("score", F.when(F.col("qty") != 1, F.col("score"))).withColumn(
            "monetized", F.col("monetized") == 1
        )

    champion = property(lambda self: [F.col("pos").asc(), F.col("sku").asc()])
    challenger = property(lambda self: [F.col("score").desc(), F.col("sku").desc()])

    @cached_property
    def ranked(self) -> DataFrame:
        """Listings with the ranks of both models."""
        return rank_rows_by(self.listing, ["rid"], {"champ": self.champion, "chal": self.challenger})

    @cached_property
    def views(self) -> DataFrame:
        """Product views: returned lines, possibly several per listing."""
        return self.lineitem.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("sku")
        )

    @cached_property
    def household(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("household_id"),
            F.md5(F.col("c_custkey").cast("string")).alias("hashed_id"),
            F.concat_ws("-", F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.col("c_custkey").cast("string")).alias(
                "div_store"
            ),
        )

    @cached_property
    def store(self) -> DataFrame:
        nation = self.nation.select("n_nationkey", F.col("n_name").alias("state"))
        stores = self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return stores.select(
            F.concat(F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit("-")).alias("division"),
            F.col("c_custkey").cast("string").alias("store"),
            "state",
        )

    @cached_property
    def product(self) -> DataFrame:
        """Products whose taxonomy text has two paths."""
        first = F.concat(F.lit("47 "), "p_type", F.lit(" 306 "), "p_brand", F.lit(" 50118 "), "p_name")
        second = F.concat(F.lit(",52 "), "p_type", F.lit(" 319 "), "p_name", F.lit(" 50127 "), "p_brand")
        return self.part.select(
            F.col("p_partkey").alias("sku"),
            pad_code(F.col("p_partkey").cast("string")).alias("upc"),
            F.col("p_name").alias("description"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category"),
            F.concat(first, second).alias("taxonomy"),
        )

    @cached_property
    def slot(self) -> DataFrame:
        kind = F.when(F.col("s_nationkey") < 13, "Search PLA ").otherwise("Home TOA ")
        return self.supplier.select(F.col("s_suppkey").alias("id"), F.concat(kind, F.col("s_name")).alias("name"))

    @cached_property
    def billed(self) -> DataFrame:
        """Lines as billed ad events: product, slot, price in micro-dollars and two targeting values."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("rid"),
            F.col("l_partkey").alias("sku"),
            F.col("l_suppkey").alias("slot_id"),
            F.col("l_returnflag").alias("flag"),
            F.round(F.col("l_extendedprice") * MICROS_PER_DOLLAR).cast("bigint").alias("clearing_price"),
            F.array("l_partkey", "l_suppkey").alias("matching_target_values"),
        )

    @cached_property
    def billed_at_store(self) -> DataFrame:
        """Billed events with the store of the household that placed the order."""
        orders = self.orders.select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("household_id"))
        return self.billed.join(orders, "rid").join(self.household.select("household_id", "div_store"), "household_id")

    @cached_property
    def event_log(self) -> DataFrame:
        """Events as an ad log with a price in micro-dollars and the number carried in the properties."""
        return self.events.select(
            "event_id",
            "ts",
            "event_type",
            F.to_date("ts").alias("dt"),
            F.col("user_id").alias("household_id"),
            F.round(F.col("value") * MICROS_PER_DOLLAR).cast("bigint").alias("clearing_price"),
            F.get_json_object("props", "$.k").cast("int").alias("places"),
        )

    @cached_property
    def search(self) -> DataFrame:
        """Every blank-separated piece of every document as one typed search."""
        pieces = F.split("text", "[ \\t\\n\\r]+")
        typed = self.documents.select(F.explode(pieces).alias("keyword"))
        return typed.filter(F.col("keyword") != "")


# Common table expressions with the same content for the SQL side.
LISTING = """listing AS (
  SELECT l_orderkey AS rid, l_partkey AS sku,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS click,
    max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS monetized,
    min(l_linenumber) AS pos, max(l_extendedprice) AS score, min(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""
RANKED = f"""{LISTING}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos, sku) AS champ,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, sku DESC) AS chal,
    count(*) OVER (PARTITION BY rid) AS n
  FROM listing)"""
SCORED = f"""{LISTING}, scored AS (
  SELECT rid, sku, click, monetized = 1 AS monetized, pos, CASE WHEN qty <> 1 THEN score END AS score, qty
  FROM listing),
complete AS (SELECT * FROM scored WHERE rid NOT IN (SELECT rid FROM scored WHERE score IS NULL)),
shown AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY pos, sku) AS shown_rank FROM complete),
relevant AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, shown_rank) AS relevance_rank FROM shown),
displaced AS (SELECT *, relevance_rank - shown_rank AS rank_diff FROM relevant WHERE monetized)"""
VIEWS = """views AS (SELECT l_orderkey AS rid, l_partkey AS sku FROM lineitem WHERE l_returnflag = 'R')"""
HOUSEHOLD = """household AS (
  SELECT c_custkey AS household_id, md5(CAST(c_custkey AS VARCHAR)) AS hashed_id,
    lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || CAST(c_custkey AS VARCHAR) AS div_store FROM customer)"""
STORE = """store AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || CAST(c_custkey AS VARCHAR) AS div_store, n_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
PRODUCT = """product AS (
  SELECT p_partkey AS sku, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS upc, p_name AS description, p_brand AS brand,
    p_type AS category, '47 ' || p_type || ' 306 ' || p_brand || ' 50118 ' || p_name || ',52 ' || p_type || ' 319 '
      || p_name || ' 50127 ' || p_brand AS taxonomy FROM part)"""
SLOT = """slot AS (
  SELECT s_suppkey AS id, CASE WHEN s_nationkey < 13 THEN 'Search PLA ' ELSE 'Home TOA ' END || s_name AS name
  FROM supplier)"""
BILLED = """billed AS (
  SELECT l_orderkey AS rid, l_partkey AS sku, l_suppkey AS slot_id, l_returnflag AS flag,
    CAST(round(l_extendedprice * 1000000) AS BIGINT) AS clearing_price, [l_partkey, l_suppkey] AS matching_target_values
  FROM lineitem)"""
EVENT_LOG = """event_log AS (
  SELECT event_id, ts, event_type, CAST(ts AS DATE) AS dt, user_id AS household_id,
    CAST(round(value * 1000000) AS BIGINT) AS clearing_price,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS places FROM events)"""
SEARCH = """search AS (
  SELECT keyword FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r]+')) AS keyword FROM documents)
  WHERE keyword <> '')"""
