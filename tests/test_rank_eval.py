"""Rank evaluation against direct loops over small lists."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from catalogue import QUERIES
from shelfscope.plans import rank_eval as E



def top_lists(df, click=None):
    return E.top_lists(df, "request_id", "sku", [F.col("champ").asc()], [F.col("chal").asc()], click)


def requests(seed, n_requests, longest=9):
    """(request, sku, champion rank, challenger rank, click) of random lists."""
    rng = random.Random(seed)
    rows = []
    for request in range(n_requests):
        n = rng.randint(1, longest)
        order = rng.sample(range(1, n + 1), n)
        rows += [(request, f"s{i}", i, order[i - 1], int(rng.random() < 0.4)) for i in range(1, n + 1)]
    return rows


def expected_classes(rows, n=4):
    """The class table, read one clicked item at a time."""
    out = []
    for request, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        champ = [r[1] for r in sorted(group, key=lambda r: r[2])][:n]
        chal = [r[1] for r in sorted(group, key=lambda r: r[3])][:n]
        clicked = {r[1] for r in group if r[4]}
        new = set(chal) - set(champ)
        for x in [x for x in champ if x in clicked]:
            if x not in chal:
                kind = E.DELETION
            elif chal.index(x) == champ.index(x):
                kind = E.SAME_RANK
            elif chal.index(x) < champ.index(x):
                kind = E.BETTER_RANK
            elif not new:
                kind = E.SUBSTITUTION
            else:
                above = chal[: chal.index(x)]
                if all(y in clicked for y in above):
                    kind = E.CORRECT_SUBSTITUTION
                elif any(y in new for y in above):
                    kind = E.INSERTION_1
                else:
                    kind = E.INSERTION_2
            out.append((request, kind, x))
        out += [(request, E.INSERTED, x) for x in new & clicked]
    return sorted(out, key=str)


SCHEMA = "request_id int, sku string, champ int, chal int, click int"


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_a_direct_loop(spark, seed):
    data = requests(seed, 250)
    df = spark.createDataFrame(data, SCHEMA)
    top = top_lists(df, "click")
    found = E.classify_errors(top, "request_id")
    assert found.columns == ["request_id", "result_type", "item"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_classes(data)


CASES = {
    # champion order is a..f; the challenger order and the clicked items give the class of the first clicked item
    E.SAME_RANK: ("abcd", "a"),
    E.BETTER_RANK: ("bacd", "b"),
    E.SUBSTITUTION: ("bacd", "a"),
    E.DELETION: ("bcdea", "a"),
    E.CORRECT_SUBSTITUTION: ("eabcdf", "ae"),
    E.INSERTION_1: ("ebacdf", "a"),
    E.INSERTION_2: ("bacedf", "a"),
    E.INSERTED: ("ebcdaf", "e"),
}


@pytest.mark.parametrize("kind", CASES)
def test_each_class(spark, kind):
    order, clicked = CASES[kind]
    data = [(1, sku, i + 1, order.index(sku) + 1, int(sku in clicked)) for i, sku in enumerate(sorted(order))]
    top = top_lists(spark.createDataFrame(data, SCHEMA), "click")
    found = {r.item: r.result_type for r in E.classify_errors(top, "request_id").collect()}
    assert found[clicked[0]] == kind


def test_click_below_the_top_is_ignored(spark):
    data = [(1, s, i, i, int(s == "e")) for i, s in enumerate("abcde", 1)]
    top = top_lists(spark.createDataFrame(data, SCHEMA), "click")
    assert E.classify_errors(top, "request_id").count() == 0


def test_breakdown(spark, rows):
    errors = spark.createDataFrame(
        [(1, E.DELETION, "a"), (1, E.DELETION, "b"), (1, E.SAME_RANK, "c"), (2, E.SAME_RANK, "a")],
        "request_id int, result_type string, item string",
    )
    assert rows(E.error_breakdown(errors, "request_id")) == [(E.SAME_RANK, 2, 100.0), (E.DELETION, 1, 50.0)]
    items = spark.createDataFrame([("a", "x")], "sku string, brand string")
    assert rows(E.enrich_errors(errors, items, "sku", ["brand"]), "request_id", "item", "brand") == [
        (1, "a", "x"), (1, "b", None), (1, "c", None), (2, "a", "x"),
    ]


def overlap(champ, chal, k=4, p=0.78):
    return sum((1 - p) * p ** (d - 1) * len(set(champ[:d]) & set(chal[:d])) / d for d in range(1, min(k, len(champ)) + 1))


def test_overlap_equals_the_sum(spark):
    data = requests(7, 120)
    got = E.rbo_top_k(top_lists(spark.createDataFrame(data, SCHEMA)), "request_id")
    got = {r.request_id: r.rbo for r in got.collect()}
    for request, group in itertools.groupby(data, key=lambda r: r[0]):
        group = list(group)
        lists = [[r[1] for r in sorted(group, key=lambda r: r[i])] for i in (2, 3)]
        assert math.isclose(got[request], overlap(*lists), abs_tol=1e-12)
        assert 0 <= got[request] <= 0.62984944 + 1e-12


@pytest.mark.parametrize(("order", "score"), [("abcde", 0.62984944), ("efghabcd", 0.0), ("a", 0.22)])
def test_known_overlaps(spark, order, score):
    data = [(1, s, i, order.index(s) + 1, 0) for i, s in enumerate(sorted(order), 1)]
    top = top_lists(spark.createDataFrame(data, SCHEMA))
    assert math.isclose(E.rbo_top_k(top, "request_id").first().rbo, score, abs_tol=1e-12)


def direct_tau(pairs):
    """n, pairs out of order and tau-b from all pairs."""
    n, agree, out, tied_x, tied_y = len(pairs), 0, 0, 0, 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        agree += (a - c) * (b - d) > 0
        out += (a - c) * (b - d) < 0
        tied_x += a == c
        tied_y += b == d
    every = n * (n - 1) // 2
    scale = math.sqrt((every - tied_x) * (every - tied_y))
    return n, out, (agree - out) / scale if scale else None


@pytest.fixture(scope="module")
def tau_data():
    rng = random.Random(3)
    rows = [("reversed", i, -i) for i in range(6)] + [("one", 1, 1)] + [("constant", 1, i) for i in range(4)]
    for name, n, values in (("ties", 30, 8), ("few ties", 35, 200), ("short", 12, 10**6), ("long", 40, 10**6)):
        rows += [(name, rng.randint(1, values), rng.randint(1, values)) for _ in range(n)]
    return rows


@pytest.mark.parametrize(("block", "hot_rows"), [(256, None), (4, None), (8, 20)])
def test_tau_counts_every_pair(spark, tau_data, block, hot_rows):
    df = spark.createDataFrame(tau_data, "request_id string, x int, y int")
    got = {r.request_id: r for r in E.kendall_tau(df, "request_id", "x", "y", block=block, hot_rows=hot_rows).collect()}
    assert set(got) == {r[0] for r in tau_data}
    for name, row in got.items():
        n, out, tau = direct_tau([(x, y) for r, x, y in tau_data if r == name])
        assert (row.n, row.discordant) == (n, out)
        assert (tau is None and row.tau is None and row.p_value is None) or math.isclose(row.tau, tau, abs_tol=1e-12)


def test_exact_p_value_counts_permutations(spark):
    for n in (2, 3, 5, 6):
        out_of = lambda order: sum(a > b for a, b in itertools.combinations(order, 2))
        orders = list(itertools.permutations(range(n)))
        counts = [out_of(o) for o in orders]
        data = [(i, x, y) for i, o in enumerate(orders[:120]) for x, y in enumerate(o)]
        df = spark.createDataFrame(data, "request_id int, x int, y int")
        total = n * (n - 1) // 2
        for r in E.kendall_tau(df, "request_id", "x", "y", tie_free=True).collect():
            fewer = min(r.discordant, total - r.discordant)
            exact = min(1.0, 2 * sum(c <= fewer for c in counts) / len(counts))
            assert math.isclose(r.p_value, 1.0 if 2 * fewer == total else exact, abs_tol=1e-12)


def test_normal_p_value_with_ties(spark):
    """The variance with tie corrections, worked out for one small list."""
    pairs = [(1, 1), (1, 2), (2, 2), (3, 4), (4, 3)]
    df = spark.createDataFrame([("r", x, y) for x, y in pairs], "request_id string, x int, y int")
    row = E.kendall_tau(df, "request_id", "x", "y").first()
    n, one_pair = 5, 2 * 1 * (2 * 2 + 5)
    m = n * (n - 1)
    variance = (m * (2 * n + 5) - one_pair - one_pair) / 18 + 2 * 1 * 1 / m
    balance = (n * (n - 1) // 2) - 1 - 1 + 0 - 2 * row.discordant
    assert math.isclose(row.p_value, math.erfc(abs(balance) / math.sqrt(variance) / math.sqrt(2)), abs_tol=1e-12)


def test_challenger_order_and_missing_scores(spark, rows):
    retrieval = spark.createDataFrame(
        [("r1", [(0.5, "a"), (0.9, "b"), (0.5, "c"), (None, "d")]), ("r2", None), ("r3", [])],
        "request_id string, results array<struct<score: double, sku: string>>",
    )
    ranked = E.challenger_items(retrieval, "request_id", "results")
    assert rows(ranked, "sku", "chal_rank") == [("a", 3), ("b", 1), ("c", 2), ("d", None)]


def test_completeness(spark, rows):
    shown = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "request_id string")
    retrieved = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("d",)], "request_id string")
    complete = E.complete_requests(shown, retrieved, "request_id")
    assert rows(complete, "request_id", "n_items") == [("a", 2)]
    assert tuple(E.completeness_report(complete).first()) == (1, 2, 2.0)


def test_long_lists_continue_in_segments(spark, rows):
    df = spark.createDataFrame([("r", i, f"s{i}" if i != 2 else None) for i in range(1, 8)], "request_id string, place int, sku string")
    lists = E.ranked_lists(df, "request_id", "place", ["sku"], segment_rows=3)
    assert sorted((r.segment, r.place, r.sku) for r in lists.collect()) == [
        (0, [1, 2, 3], ["s1", None, "s3"]), (1, [4, 5, 6], ["s4", "s5", "s6"]), (2, [7], ["s7"]),
    ]


def test_clicked_requests(spark, rows):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "a", 0)], "request_id int, sku string, click int")
    assert rows(E.clicked_requests(df, "request_id", "click"), "request_id", "sku") == [(1, "a"), (1, "b")]


def test_both_rankings_side_by_side(spark):
    data = [("r", "a", 1, 3, "x"), ("r", "b", 2, 1, None), ("r", "c", 3, 2, "z")]
    df = spark.createDataFrame(data, "request_id string, sku string, champ int, chal int, brand string")
    row = E.evaluation_lists(df, "request_id", "champ", "chal", ["sku", "brand"]).first()
    assert (row.champ_sku, row.corresp_chal_rank, row.champ_brand) == (["a", "b", "c"], [3, 1, 2], ["x", None, "z"])
    assert (row.chal_sku, row.chal_rank, row.chal_brand) == (["b", "c", "a"], [1, 2, 3], [None, "z", "x"])
    assert E.evaluation_lists(df, "request_id", "champ", "chal", ["sku"], segment_rows=2).count() == 2


def test_lists_of_unequal_length_lose_no_item(spark):
    items = [("a", i, i, {1: 1, 4: 2}.get(i)) for i in range(1, 6)] + [("b", 9, 1, None), (None, 7, 1, 1)]
    df = spark.createDataFrame(items, "rid string, sku int, champ int, chal int")
    lists = {(r.rid, r.segment): r for r in E.evaluation_lists(df, "rid", "champ", "chal", ["sku"], 2).collect()}
    assert {k: r.champ_sku for k, r in lists.items()} == {("a", 0): [1, 2], ("a", 1): [3, 4], ("a", 2): [5], ("b", 0): [9], (None, 0): [7]}
    assert lists["a", 0].chal_sku == [1, 4] and lists["a", 1].chal_sku is None and lists[None, 0].chal_sku == [7]
    segments = {(r.rid, r.sku): r.segment for r in E.item_segments(df, "rid", "sku", ["champ", "chal"], 2).collect()}
    assert segments["a", 5] == 2 and segments["b", 9] == 0


def test_normal_p_values_on_request(spark):
    order = [2, 1, 4, 3, 6, 5, 7]
    df = spark.createDataFrame([("a", i, y) for i, y in enumerate(order, 1)], "rid string, x int, y int")
    row = E.kendall_tau(df, "rid", "x", "y", p_method="normal").first()
    n, out = len(order), 3
    spread = n * (n - 1) * (2 * n + 5) / 18
    assert row.discordant == out and abs(row.p_value - math.erfc((n * (n - 1) / 2 - 2 * out) / math.sqrt(spread) / math.sqrt(2))) < 1e-12
    assert E.kendall_tau(df, "rid", "x", "y").first().p_value != row.p_value
    with pytest.raises(ValueError):
        E.kendall_tau(df, "rid", "x", "y", p_method="other")


@pytest.mark.parametrize("name", ["pler_enriched", "pler_enriched_segments"])
def test_enriched_errors_build_the_ranked_listings_once(spark, rows, tmp_path, name):
    line = "id DIV 6 AS l_orderkey, id % 5 AS l_partkey, int(id % 6) AS l_linenumber, double(id * 7 % 10) AS l_extendedprice, double(id % 3 + 1) AS l_quantity"
    flags = "IF(id % 4 = 0, 'R', 'N') AS l_returnflag, IF(id % 2 = 0, 'O', 'F') AS l_linestatus"
    spark.sql(f"SELECT {line}, {flags} FROM range(120)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, concat('n', id) AS p_name, concat('b', id) AS p_brand, concat('t', id) AS p_type FROM range(4)").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert not any("lineitem" in file for file in found.inputFiles())
    staged = QUERIES[name.replace("enriched", "enriched_staged")](spark, str(tmp_path))
    assert rows(found.select(*sorted(found.columns))) == rows(staged.select(*sorted(found.columns))) != []
