"""Attribution, exposed revenue and impact bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import bind
from catalogue.tables import BILLED, EVENT_LOG, HOUSEHOLD, PRODUCT, SLOT, STORE
from shelfscope.functions import taxonomy as T
from shelfscope.operators.ordered import pick_one_per_key
from shelfscope.plans import attribution as A
from shelfscope.plans import exposure as E
from shelfscope.plans import impact as I
from shelfscope.session import scratch_path
from shelfscope.sources.readers import scan_csv
from shelfscope.sources.workspace import Log, Workspace

c = F.col

# --- attribution


@bind(
    "attribution_backfill",
    f"""WITH {HOUSEHOLD} SELECT lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS upc, l_extendedprice AS loyalty_amount,
    CAST(l_quantity AS BIGINT) AS units, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS trn_dt, hashed_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN household ON o_custkey = household_id
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""",
)
def attribution_backfill(t):
    allowed = A.padded_allow_list(t.part.filter(c("p_type") == "PROMO"), "p_partkey")
    return A.attribution_backfill(_dated_transactions(t), t.household, allowed)


def _dated_transactions(t):
    joined = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return joined.select(
        c("o_custkey").alias("household_id"),
        F.lpad(c("l_partkey").cast("string"), 13, "0").alias("upc"),
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("net_spend"),
        c("l_extendedprice").alias("loyalty_amount"),
        c("l_extendedprice").alias("retail_amount"),
        c("l_quantity").cast("bigint").alias("units"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("trn_dt"),
    )


@bind(
    "attribution_export",
    f"""WITH {HOUSEHOLD} SELECT lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS upc, l_extendedprice AS loyalty_amount,
    CAST(l_quantity AS BIGINT) AS units, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS trn_dt, hashed_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN household ON o_custkey = household_id
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') AND l_quantity > 5
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-27' AND DATE '1996-06-14'""",
)
def attribution_export(t):
    """From a campaign's period to the file that is delivered, and back."""
    logs = Workspace(logs={"transactions": Log(_dated_transactions(t), "trn_dt")})
    allowed = A.padded_allow_list(t.part.filter(c("p_type") == "PROMO"), "p_partkey")
    path = scratch_path(t.spark, "attribution")
    exported = A.attribution_export(
        logs, "1996-03-01", "1996-05-31", t.household, allowed, path, rules={"bulk": c("units") > 5}
    )
    return scan_csv(t.spark, path, exported.schema, header=False, sep="|")


# --- exposed revenue

_CENTS = "CAST(round(CAST(sum(clearing_price) AS DECIMAL(20,0)) * 0.000001, 2) AS DOUBLE)"
_SENSITIVE = "sensitive AS (SELECT DISTINCT upc, sku, category, brand FROM product WHERE category IN ('PROMO', 'SMALL'))"
_CLICKS = f"""{BILLED}, {PRODUCT}, {SLOT}, {_SENSITIVE},
  clicks AS (SELECT * FROM billed WHERE flag = 'R' AND slot_id IN (SELECT id FROM slot WHERE name LIKE '%PLA%'))"""
_AT_STORE = f"""{HOUSEHOLD}, {STORE},
  located AS (SELECT o_orderkey AS rid, state FROM orders JOIN household ON o_custkey = household_id JOIN store USING (div_store)
    WHERE state IN ('NATION_3', 'NATION_7'))"""
_STATES = ["NATION_3", "NATION_7"]


def sensitive(t):
    listed = t.part.filter(c("p_type").isin("PROMO", "SMALL")).select(c("p_type").alias("listed")).distinct()
    return E.sensitive_products(t.product, listed, ["upc", "sku", "category", "brand"], "category", "listed")


@bind(
    "sensitive_products",
    f"WITH {PRODUCT} SELECT DISTINCT upc, category FROM product WHERE category IN ('PROMO', 'SMALL') AND sku IN "
    "(SELECT l_partkey FROM lineitem)",
)
def sensitive_products(t):
    sold = t.lineitem.select(c("l_partkey").alias("sku")).distinct().join(t.product, "sku")
    listed = t.part.filter(c("p_type").isin("PROMO", "SMALL")).select(c("p_type").alias("listed")).distinct()
    return E.sensitive_products(sold, listed, ["upc", "category"], "category", "listed")


def _revenue(t, by, stores=None):
    log = t.billed if stores is None else t.billed_at_store
    clicks = log.filter(c("flag") == "R")
    products = sensitive(t).withColumnRenamed("sku", "product_sku")
    return E.revenue_by_category(clicks, products, E.slots_like(t.slot, "%PLA%"), by, stores, upc="product_sku")


@bind(
    "revenue_by_category",
    f"WITH {_CLICKS} SELECT category, {_CENTS} AS dollars_paid_clicks FROM clicks JOIN sensitive USING (sku) GROUP BY 1",
)
def revenue_by_category(t):
    return _revenue(t, ["category"])


@bind(
    "revenue_by_category_upc",
    f"WITH {_CLICKS} SELECT category, upc, {_CENTS} AS dollars_paid_clicks FROM clicks JOIN sensitive USING (sku) GROUP BY 1, 2",
)
def revenue_by_category_upc(t):
    return _revenue(t, ["category", "upc"])


@bind(
    "revenue_by_category_state",
    f"""WITH {_CLICKS}, {_AT_STORE} SELECT state, category, {_CENTS} AS dollars_paid_clicks
    FROM clicks JOIN sensitive USING (sku) JOIN located USING (rid) GROUP BY 1, 2""",
)
def revenue_by_category_state(t):
    return _revenue(t, ["state", "category"], E.stores_in(t.store, _STATES))


_TARGETED = f"""{BILLED}, {PRODUCT}, {SLOT},
  labels AS (SELECT DISTINCT upper(regexp_extract(path, '[0-9]{{5,}}\\s+(.*)$', 1)) AS label FROM (
    SELECT unnest(string_split(taxonomy, ',')) AS path FROM product WHERE category IN ('PROMO', 'SMALL'))),
  target AS (SELECT p_partkey AS target_id, upper(p_name) AS label FROM part),
  shown AS (SELECT rid, clearing_price, unnest(matching_target_values) AS target_id FROM billed
    WHERE flag = 'N' AND slot_id IN (SELECT id FROM slot WHERE name LIKE '%TOA%')),
  hits AS (SELECT * FROM shown JOIN target USING (target_id) WHERE label IN (SELECT label FROM labels))"""


def _targeted(t, stores=None):
    log = t.billed if stores is None else t.billed_at_store
    listed = t.product.filter(c("category").isin("PROMO", "SMALL"))
    labels = T.explode_sub_categories(listed, "taxonomy").select(c("sub_category").alias("label"))
    targets = t.part.select(c("p_partkey").alias("id"), F.upper("p_name").alias("label"))
    impressions = log.filter(c("flag") == "N")
    return E.revenue_by_label(impressions, targets, E.slots_like(t.slot, "%TOA%"), labels, stores)


@bind(
    "targeted_revenue_by_label",
    f"WITH {_TARGETED} SELECT label, {_CENTS} AS dollars_paid_impressions FROM hits GROUP BY 1",
)
def targeted_revenue_by_label(t):
    return _targeted(t)


@bind(
    "targeted_revenue_by_label_state",
    f"""WITH {_TARGETED}, {_AT_STORE} SELECT state, label, {_CENTS} AS dollars_paid_impressions
    FROM hits JOIN located USING (rid) GROUP BY 1, 2""",
)
def targeted_revenue_by_label_state(t):
    return _targeted(t, E.stores_in(t.store, _STATES))


@bind(
    "targeted_revenue_with_paths",
    f"""WITH {_TARGETED}, spend AS (SELECT label, {_CENTS} AS dollars_paid_impressions FROM hits GROUP BY 1),
    named AS (SELECT DISTINCT path, category, upper(regexp_extract(path, '[0-9]{{5,}}\\s+(.*)$', 1)) AS sub_category FROM (
      SELECT category, unnest(string_split(taxonomy, ',')) AS path FROM product WHERE category IN ('PROMO', 'SMALL')))
    SELECT label, dollars_paid_impressions, path, category FROM spend JOIN named ON label = sub_category""",
)
def targeted_revenue_with_paths(t):
    listed = t.product.filter(c("category").isin("PROMO", "SMALL"))
    named = T.explode_sub_categories(listed, "taxonomy").select("sub_category", "path", "category").distinct()
    spend = _targeted(t)
    joined = spend.join(named, spend["label"] == named["sub_category"])
    return joined.select("label", "dollars_paid_impressions", "path", "category")


@bind(
    "spend_by_region",
    f"""WITH {EVENT_LOG}, {HOUSEHOLD}, {STORE}, located AS (SELECT event_type, clearing_price, state FROM event_log
      JOIN household USING (household_id) JOIN store USING (div_store) WHERE state IN ('NATION_3', 'NATION_7', 'NATION_12')),
    a AS (SELECT state, CAST(sum(clearing_price) AS DOUBLE) / 1000000 AS click_spend FROM located
      WHERE event_type = 'click' GROUP BY 1),
    b AS (SELECT state, CAST(sum(clearing_price) AS DOUBLE) / 1000000 AS impression_spend FROM located
      WHERE event_type = 'view' GROUP BY 1)
    SELECT state, click_spend, impression_spend, click_spend + impression_spend AS total_spend FROM a JOIN b USING (state)""",
)
def spend_by_region(t):
    unit = F.when(c("event_type") == "click", "CPC").when(c("event_type") == "view", "CPM")
    log = t.event_log.withColumn("unit_type", unit).join(t.household, "household_id")
    stores = E.stores_in(t.store, ["NATION_3", "NATION_7", "NATION_12"])
    return E.spend_by_state(log, log, stores)


# --- impact bounds

_NAMED = """named AS (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS name, p_type, p_size FROM part),
  catalogue AS (SELECT DISTINCT name FROM named WHERE p_type IN ('LARGE', 'MEDIUM')),
  listed AS (SELECT DISTINCT name FROM named WHERE p_type = 'SMALL'),
  prints AS (SELECT name, CAST(sum(p_size) AS DOUBLE) AS prints FROM named
    WHERE p_type IN ('PROMO', 'ECONOMY', 'STANDARD') GROUP BY name)"""
_UNCLEAR = ["Brand#1/10", "Brand#2/20", "Brand#3/30", "Brand#4/40", "Brand#5/5", "Brand#6/6", "Brand#7/7"]
_GRADED = f"""{_NAMED}, joined AS (SELECT p.name, prints, c.name IS NOT NULL AS known, l.name IS NOT NULL AS sens
    FROM prints p LEFT JOIN catalogue c ON p.name = c.name LEFT JOIN listed l ON p.name = l.name),
  graded AS (SELECT name, prints, CASE WHEN known AND NOT sens THEN '0'
    WHEN NOT known AND name NOT IN ({", ".join(f"'{u}'" for u in _UNCLEAR)}) THEN '0'
    WHEN name IN ({", ".join(f"'{u}'" for u in _UNCLEAR)}) THEN 'UNKNOWN' ELSE '1' END AS sensitive FROM joined),
  bounds AS (SELECT *, CASE WHEN sensitive = '1' THEN prints ELSE 0.0 END::DOUBLE AS min_impact,
    CASE WHEN sensitive = '0' THEN 0.0 ELSE prints END::DOUBLE AS max_impact FROM graded)"""


def _named(t):
    name = F.concat("p_brand", F.lit("/"), c("p_size").cast("string"))
    named = t.part.select(name.alias("name"), "p_type", "p_size")
    of = lambda *types: named.filter(c("p_type").isin(*types))
    prints = of("PROMO", "ECONOMY", "STANDARD").groupBy("name").agg(F.sum("p_size").cast("double").alias("prints"))
    return prints, of("LARGE", "MEDIUM"), of("SMALL").select("name").distinct()


def _graded(t):
    prints, catalogue, listed = _named(t)
    return I.classify_impact(prints, catalogue, listed, _UNCLEAR, "name", "prints")


@bind("classify_min_max_impact", f"WITH {_GRADED} SELECT * FROM bounds")
def classify_min_max_impact(t):
    return _graded(t)


@bind(
    "impact_summary",
    f"""WITH {_GRADED}, s AS (SELECT sum(prints) AS total_amount, sum(min_impact) AS min_impact,
      sum(max_impact) AS max_impact FROM bounds)
    SELECT *, min_impact / total_amount AS min_impact_share, max_impact / total_amount AS max_impact_share FROM s""",
)
def impact_summary(t):
    return I.impact_summary(_graded(t), "prints")


@bind(
    "reconcile_full_outer",
    f"""WITH {_NAMED}, j AS (SELECT coalesce(c.name, p.name) AS name, prints, c.name IS NOT NULL AS l,
      p.name IS NOT NULL AS r FROM catalogue c FULL JOIN prints p ON c.name = p.name),
    g AS (SELECT j.*, CASE WHEN l AND x.name IS NULL THEN 0 WHEN x.name IS NOT NULL THEN 1 END AS sensitive
      FROM j LEFT JOIN listed x ON j.name = x.name)
    SELECT name, prints, sensitive, CASE WHEN l AND r THEN 'MATCHED' WHEN r THEN 'UNKNOWN - missing left'
      ELSE 'UNKNOWN - missing right' END AS status,
    CASE WHEN l AND r AND sensitive = 0 THEN 0.0 WHEN l AND r THEN prints END::DOUBLE AS impact
    FROM g WHERE sensitive = 1 OR sensitive IS NULL OR prints > 0""",
)
def reconcile_full_outer(t):
    prints, catalogue, listed = _named(t)
    return I.reconcile(catalogue, prints, listed, "name", "prints")


# --- taxonomy

_PATHS = f"WITH {PRODUCT}, paths AS (SELECT sku, unnest(string_split(taxonomy, ',')) AS path FROM product)"


@bind("taxonomy_explode", f"{_PATHS} SELECT sku, path FROM paths")
def taxonomy_explode(t):
    return t.product.select("sku", F.explode(T.paths(c("taxonomy"))).alias("path"))


@bind(
    "taxonomy_subcategory",
    f"{_PATHS} SELECT sku, path, upper(regexp_extract(path, '[0-9]{{5,}}\\s+(.*)$', 1)) AS sub_category FROM paths",
)
def taxonomy_subcategory(t):
    return T.explode_sub_categories(t.product, "taxonomy").select("sku", "path", "sub_category")


_LABELLED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(taxonomy, '^[0-9]{2}\s+', 'DEPT: '),
  ',[0-9]{2}\s+', ' ||DEPT: ', 'g'), '\s+[0-9]{3}\s+', ' |COMMODITY: ', 'g'), '\s+[0-9]{5}\s+', ' |SUB_COMMODITY: ', 'g')"""
_LEVELS = f"""WITH {PRODUCT}, l AS (SELECT sku, string_split({_LABELLED}, '||') AS parts FROM product),
  p AS (SELECT sku, unnest(range(0, len(parts))) AS no, parts FROM l),
  q AS (SELECT sku, CAST(no AS INTEGER) AS path_no, trim(parts[no + 1]) AS path FROM p),
  levels AS (SELECT sku, path_no, path, trim(regexp_extract(path, '^DEPT:\\s*([^|]*)', 1)) AS department,
    trim(regexp_extract(path, '[|]COMMODITY:\\s*([^|]*)', 1)) AS commodity,
    trim(regexp_extract(path, '[|]SUB_COMMODITY:\\s*(.*)$', 1)) AS sub_commodity FROM q)"""
_LEVEL_COLUMNS = ["sku", "path_no", "path", "department", "commodity", "sub_commodity"]


@bind("taxonomy_parse", f"{_LEVELS} SELECT * FROM levels")
def taxonomy_parse(t):
    return T.parse_levels(t.product, "taxonomy").select(*_LEVEL_COLUMNS)


@bind("taxonomy_one_per_item", f"{_LEVELS} SELECT sku, department, commodity, sub_commodity FROM levels WHERE path_no = 0")
def taxonomy_one_per_item(t):
    first = pick_one_per_key(T.parse_levels(t.product, "taxonomy"), ["sku"], [c("path_no").asc()])
    return first.select("sku", "department", "commodity", "sub_commodity")


@bind(
    "taxonomy_piped",
    rf"""WITH {PRODUCT} SELECT sku, upper(regexp_replace(regexp_replace(taxonomy, '\s*([0-9]+)\s*', '|', 'g'),
    '^([^|]*)[|]', '\1')) AS names FROM product""",
)
def taxonomy_piped(t):
    return t.product.select("sku", T.piped(c("taxonomy")).alias("names"))
