import pytest
from pyspark.sql import functions as F

from shelfscope.operators.digests import split_by_difference
from shelfscope.plans import attribution as A
from shelfscope.plans import exposure as E
from shelfscope.plans import impact as I
from shelfscope.plans import inventory as N
from shelfscope.sources.workspace import Log, Workspace


def test_backfill_pads_dedupes_and_fans_out(spark, rows):
    transactions = spark.createDataFrame(
        [("h1", "0000000000042", 1.0, 2.0, 3.0), ("h1", "0000000000043", 1.0, 2.5, 3.0), ("h2", "0000000000042", 1.0, 4.0, 3.0), ("h9", "0000000000042", 1.0, 9.0, 3.0)],
        "household_id string, upc string, net_spend double, loyalty_amount double, retail_amount double",
    )
    households = spark.createDataFrame([("h1", "x"), ("h1", "y"), ("h2", "z")], "household_id string, hashed_id string")
    codes = spark.createDataFrame([("42",), ("42",), ("0000000000042",), (None,)], "upc string")
    allowed = A.padded_allow_list(codes, "upc")
    assert rows(allowed) == [("0000000000042",)]
    out = A.attribution_backfill(transactions, households, allowed)
    assert out.columns == ["upc", "loyalty_amount", "hashed_id"]
    assert rows(out, "loyalty_amount", "hashed_id") == [(2.0, "x"), (2.0, "y"), (4.0, "z")]


def test_product_list_and_drill_down(spark, rows):
    products = spark.createDataFrame([("007", "soap", "b1"), ("008", "nuts", "b2"), (None, "x", "b1")], "upc string, description string, brand string")
    assert rows(A.product_list_by_brand(products, ["b1"])) == [("'007", "soap", "b1"), (None, "x", "b1")]
    assert rows(A.drill_down(products, "upc", ["008"]), "description") == [("nuts",)]


def test_campaign_impressions(spark, rows):
    log = spark.createDataFrame(
        [("c1", "2024-01-01", "IMP"), ("c1", "2024-01-02", "CLICK"), ("c2", "2024-01-02", "IMP"), ("c1", "2024-02-01", "IMP")],
        "campaign_id string, dt string, kind string",
    )
    space = Workspace({"ads": Log(log, "dt", "kind", {"IMPRESSION": "IMP"})})
    campaigns = spark.createDataFrame([("c1", "summer")], "campaign_id string, name string")
    found = A.campaign_impressions(space, "2024-01-01", "2024-01-31", campaigns, "ads", "IMPRESSION")
    assert rows(found, "dt", "name") == [("2024-01-01", "summer")]


@pytest.fixture(scope="module")
def ads(spark):
    clicks = spark.createDataFrame(
        [("u1", 1, "014-1", 1_000_000, ["t1"]), ("u1", 1, "014-1", 5_000, ["t1", "t2"]), ("u2", 1, "014-2", 2_000_000, []),
         ("u1", 2, "014-2", 7_000_000, None), ("u9", 1, "014-1", 9_000_000, ["t2", "t2"])],
        "sku string, slot_id int, div_store string, clearing_price bigint, matching_target_values array<string>",
    )
    slots = spark.createDataFrame([(1, "Search PLA"), (2, "search pla"), (3, "Home TOA")], "id int, name string")
    stores = spark.createDataFrame([("014-", "1", "WA"), ("014-", "2", "NV"), ("014-", "3", "OR")], "division string, store string, state string")
    return clicks, slots, stores


def test_category_revenue(spark, ads, rows):
    clicks, slots, stores = ads
    products = spark.createDataFrame([("u1", "ACNE"), ("u2", "SINUS"), ("u2", "SINUS")], "upc string, category string")
    pla = E.slots_like(slots, "%PLA%")
    assert rows(E.revenue_by_category(clicks, products.distinct(), pla, ["category"])) == [("ACNE", 1.01), ("SINUS", 2.0)]
    # a product that is listed twice counts twice
    assert rows(E.revenue_by_category(clicks, products, pla, ["category"])) == [("ACNE", 1.01), ("SINUS", 4.0)]
    by_state = E.revenue_by_category(clicks, products.distinct(), pla, ["state", "category"], E.stores_in(stores, ["WA"]))
    assert rows(by_state) == [("WA", "ACNE", 1.01)]


def test_label_revenue(spark, ads, rows):
    log, slots, stores = ads
    targets = spark.createDataFrame([("t1", "ACNE"), ("t2", "SINUS"), ("t3", "OTHER")], "id string, label string")
    labels = spark.createDataFrame([("ACNE",), ("SINUS",), ("SINUS",), (None,)], "label string")
    pla = E.slots_like(slots, "%PLA%")
    assert rows(E.revenue_by_label(log, targets, pla, labels)) == [("ACNE", 1.01), ("SINUS", 18.01)]
    by_state = E.revenue_by_label(log, targets, pla, labels, E.stores_in(stores, ["WA", "NV"]))
    assert rows(by_state) == [("WA", "ACNE", 1.01), ("WA", "SINUS", 18.01)]


def test_spend_by_state_needs_both_kinds(spark, rows):
    log = spark.createDataFrame(
        [("CPC", "1", 1_500_000), ("CPC", "2", 1_000_000), ("CPM", "1", 500_000), ("CPM", "3", 9), ("X", "1", 7)],
        "unit_type string, div_store string, clearing_price bigint",
    )
    stores = spark.createDataFrame([("1", "WA"), ("2", "NV"), ("3", "OR")], "div_store string, state string")
    assert rows(E.spend_by_state(log, log, stores)) == [("WA", 1.5, 0.5, 2.0)]


def test_sensitive_products_and_households(spark, rows):
    sold = spark.createDataFrame([("u1", "01", "a"), ("u1", "01", "a"), ("u2", None, "b"), ("u3", "02", "c")], "upc string, code string, text string")
    listed = spark.createDataFrame([("01",), ("01",), (None,)], "SUBC string")
    assert rows(E.sensitive_products(sold, listed, ["upc", "code"], "code", "SUBC")) == [("u1", "01")]
    people = spark.createDataFrame([("WA", "g1", "h1"), ("WA", "g2", "h1"), ("WA", "g3", None), ("NV", "g4", "h2")], "state string, guid string, household_id string")
    assert rows(E.households_by_state(people, "state", "household_id", "guid")) == [("NV", 1, 1), ("WA", 3, 2)]


def test_impact_rules(spark, rows):
    amounts = spark.createDataFrame(
        [("known", 1.0), ("known listed", 2.0), ("unknown unclear", 4.0), ("unknown", 8.0), ("known unclear", 16.0), ("unknown listed", 32.0), ("known listed unclear", 64.0)],
        "name string, prints double",
    )
    catalogue = spark.createDataFrame([("known",), ("known",), ("known listed",), ("known unclear",), ("known listed unclear",)], "name string")
    listed = spark.createDataFrame([("known listed",), ("unknown listed",), ("known listed unclear",)], "name string")
    graded = I.classify_impact(amounts, catalogue, listed, ["unknown unclear", "known unclear", "known listed unclear"], "name", "prints")
    assert rows(graded, "name", "sensitive", "min_impact", "max_impact") == [
        ("known", "0", 0.0, 0.0), ("known listed", "1", 2.0, 2.0), ("known listed unclear", "UNKNOWN", 0.0, 64.0),
        ("known unclear", "0", 0.0, 0.0), ("unknown", "0", 0.0, 0.0), ("unknown listed", "0", 0.0, 0.0),
        ("unknown unclear", "UNKNOWN", 0.0, 4.0),
    ]
    assert graded.filter(F.col("min_impact") > F.col("max_impact")).count() == 0
    assert tuple(I.impact_summary(graded, "prints").first()) == (127.0, 2.0, 70.0, 2 / 127, 70 / 127)


def test_impact_keeps_fan_out_of_a_repeated_listing(spark):
    one = lambda name: spark.createDataFrame([(name,)], "name string")
    amounts = spark.createDataFrame([("a", 3.0)], "name string, prints double")
    graded = I.classify_impact(amounts, one("a"), one("a").union(one("a")), [], "name", "prints")
    assert graded.count() == 2


def test_reconciliation(spark, rows):
    ours = spark.createDataFrame([("left",), ("both",), ("both listed",), ("both zero",), ("left listed",), ("both",)], "name string")
    theirs = spark.createDataFrame([("right", 5.0), ("both", 2.0), ("both listed", 3.0), ("both zero", 0.0)], "name string, prints double")
    listed = spark.createDataFrame([("both listed",), ("left listed",)], "name string")
    assert rows(I.reconcile(ours, theirs, listed, "name", "prints")) == [
        ("both", 2.0, 0, I.MATCHED, 0.0), ("both listed", 3.0, 1, I.MATCHED, 3.0),
        ("left listed", None, 1, I.MISSING_RIGHT, None), ("right", 5.0, None, I.MISSING_LEFT, None),
    ]


def test_reconciliation_of_many_names(spark, rows):
    ours = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("name"))
    theirs = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 3).cast("double").alias("prints"))
    lost, added = F.col("name").isin("n7", "n19999"), spark.createDataFrame([("new", 4.0), (None, 1.0), ("n5", 8.0)], "name string, prints double")
    changed = theirs.filter(~lost).unionByName(added)
    ours = ours.unionByName(spark.createDataFrame([(None,), ("n5",)], "name string"))
    listed = spark.createDataFrame([("n9",), ("n7",), ("new",)], "name string")
    want = [(f"n{i}", float(i % 3), int(i == 9), I.MATCHED, float(i % 3) if i == 9 else 0.0) for i in range(20_000) if i not in (7, 19_999) and (i == 9 or i % 3)]
    want += [("n7", None, 1, I.MISSING_RIGHT, None), ("new", 4.0, 1, I.MISSING_LEFT, None), ("n5", 8.0, 0, I.MATCHED, 0.0), (None, 1.0, None, I.MISSING_LEFT, None)]
    got = rows(I.reconcile(ours, changed, listed, "name", "prints"))
    assert got == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_equal_catalogues_are_not_joined(spark):
    names = spark.range(50_000).select(F.concat(F.lit("n"), "id").alias("name"))
    backwards = names.orderBy(F.desc("name")).repartition(3)
    ours, theirs, unchanged = split_by_difference(names, backwards, "name")
    assert (ours.count(), theirs.count(), unchanged.count()) == (0, 0, 50_000)
    # The names stay where they were read: what is exchanged are the digests of buckets and leaves.
    plan = split_by_difference(names, names, "name")[2]._jdf.queryExecution().executedPlan().toString()
    assert all("__bucket" in line or "__leaf" in line for line in plan.splitlines() if "Exchange hash" in line)
    one_less = names.filter("name != 'n77'")
    ours, theirs, unchanged = split_by_difference(names, one_less, "name")
    leaf = ours.count()
    assert 1 <= leaf < 20 and theirs.count() == leaf - 1 and unchanged.count() == 50_000 - leaf


def test_totals(spark, rows):
    campaigns = spark.createDataFrame(
        [("a", 5.0, "LIVE"), ("b", 1.0, "LIVE"), ("c", 9.0, "DRAFT"), ("d", None, "LIVE"), ("e", 2.0, "DONE")], "id string, budget double, status string"
    )
    assert rows(N.live_campaigns(campaigns), "id") == [("a",), ("e",)]
    other = spark.createDataFrame([("a",), ("x",), ("y",)], "id string")
    live = N.live_campaigns(campaigns)
    assert tuple(N.cross_platform_total(live, other, live, "id", earlier=100).first()) == (2, 2, 1, 104)
    assert tuple(N.cross_platform_total(live, other).first()) == (2, 3, 0, 5)
    units = spark.createDataFrame([("a", 2.0), ("a", -2.0), ("b", 1.0)], "id string, units double")
    assert rows(N.active_entities(units, ["id"], "units")) == [("b", 1.0)]
    log = spark.createDataFrame([("d1", 2), ("d1", 3), ("d2", None)], "dt string, slots int")
    assert rows(N.inventory_by(log, ["dt"], "slots")) == [("d1", 2, 5), ("d2", 1, None)]
