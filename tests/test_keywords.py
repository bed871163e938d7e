import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.operators import ordered as O
from shelfscope.operators import nearest
from shelfscope.operators.nearest import similar_topk
from shelfscope.plans import keywords as K
from shelfscope.plans import language as L


def test_cleaning_and_frequency(spark, rows):
    typed = ["milk", "Milk", "oat milk", "a" * 14, "a" * 15, "B4S" * 5 + "x", "a" * 15 + " b", None, "MILK"]
    log = spark.createDataFrame([(t,) for t in typed], "keyword string")
    frequency = K.keyword_frequency(log, "keyword")
    assert dict(rows(frequency)) == {"milk": 3, "oat milk": 1, "a" * 14: 1, "a" * 15 + " b": 1}
    assert K.most_frequent(frequency, 2).collect() == [("milk", 3), ("a" * 14, 1)]


@pytest.mark.parametrize("n", [1, 7, 20, 50])
def test_long_cut_equals_the_short_one(spark, monkeypatch, n):
    frequency = spark.createDataFrame([(f"k{i}", i % 4) for i in range(20)], "keyword string, n_requests int")
    short = K.most_frequent(frequency, n).collect()
    monkeypatch.setattr(O, "GROUP_LIMIT", 0)
    assert K.most_frequent(frequency, n).collect() == short


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_coverage(spark, hot_rows):
    frequency = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 1)], "keyword string, n_requests bigint")
    covered = {r.keyword: (r.n_covered, r.coverage) for r in K.keyword_coverage(frequency, hot_rows=hot_rows).collect()}
    assert covered == {"a": (5, 0.5), "b": (8, 0.8), "c": (9, 0.9), "d": (10, 1.0)}


def sequential_map(order, matches):
    """Keyword by keyword, as the definition reads."""
    covered, heads = set(), {}
    for keyword in order:
        if keyword not in covered:
            covered.update(matches.get(keyword, []))
            if matches.get(keyword):
                heads[keyword] = matches[keyword]
    return heads


def concept_map(spark, order, matches):
    keywords = spark.createDataFrame([(k, i) for i, k in enumerate(order)], "keyword string, at int")
    listed = [(k, m, p) for k, ms in matches.items() for p, m in enumerate(ms)]
    pairs = spark.createDataFrame(listed, "keyword string, match string, place int")
    return {r.keyword: r.matches for r in K.concept_map(keywords, pairs, ["at"]).collect()}


@pytest.mark.parametrize(
    "matches",
    [
        {"a": ["b"], "b": ["c"], "c": ["z"]},  # a chain keeps a and c
        {"a": ["b"], "b": ["a"]},  # a mutual pair keeps the first
        {"c": ["a"], "b": ["zz"]},  # an earlier keyword is never dropped by a later one
    ],
)
def test_concept_map_cases(spark, matches):
    assert concept_map(spark, "abc", matches) == sequential_map("abc", matches)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_concept_map_equals_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"k{i}" for i in range(40)]
    matches = {n: rng.sample([*names, "other", "more"], rng.randint(0, 5)) for n in names}
    order = rng.sample(names, 40)
    assert concept_map(spark, order, matches) == sequential_map(order, matches)


def test_map_from_a_log(spark):
    """Two groups of near-equal keys; the most frequent key of each heads it, digits never match."""
    typed = ["Apple"] * 5 + ["apples"] * 3 + ["milk"] * 4 + ["mlk"] * 2 + ["b" * 20] * 9 + ["nothing"] * 8
    log = spark.createDataFrame([(t,) for t in typed], "q string")
    vectors = {"apple": (1, 0), "apples": (1, 0.1), "appel": (1, 0.2), "milk": (0, 1), "mlk": (0.1, 1), "12": (0, 1.0)}
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "w string, v array<double>")
    heads = {r.keyword: r.matches for r in K.keyword_map(log, "q", table, "w", "v", n=5, k=2).collect()}
    assert heads == {"apple": ["apples", "appel"], "milk": ["mlk"]}


def test_digit_matches_are_dropped(spark, rows):
    df = spark.createDataFrame([("a", "12"), ("a", "12x"), ("a", "x")], "keyword string, match string")
    assert rows(K.drop_digit_matches(df), "match") == [("12x",), ("x",)]


def brute_force(keys, vectors, k, asked):
    unit = np.asarray(vectors, dtype=float)
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    out = set()
    for i in asked:
        others = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-scores[i, j], keys[j]))[:k]
        out |= {(keys[i], keys[j], place) for place, j in enumerate(others, 1)}
    return out


@pytest.mark.parametrize(
    ("pivots", "block_rows", "scan_bytes"), [(1, 2048, 0), (1, 10, 0), (12, 5, 0), (None, 2048, 0), (None, 2048, 1 << 20)]
)
def test_neighbours_equal_a_full_comparison(spark, pivots, block_rows, scan_bytes):
    """Clustered vectors, a third of them copies of one vector, and one without direction."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 8))
    vectors = [centres[i % 4] + 0.1 * rng.normal(size=8) for i in range(80)] + [centres[0]] * 40
    keys = list(range(len(vectors)))
    data = [(k, [float(x) for x in v], k % 3 == 0) for k, v in zip(keys, vectors)] + [(999, [0.0] * 8, True)]
    df = spark.createDataFrame(data, "id bigint, v array<double>, asked boolean").repartition(3)
    found = similar_topk(df, "id", "v", 5, is_query="asked", pivots=pivots, block_rows=block_rows, scan_bytes=scan_bytes)
    got = {(r.key, r.match, r.place) for r in found.collect()}
    assert got == brute_force(keys, vectors, 5, [k for k in keys if k % 3 == 0])


def test_neighbours_with_fewer_keys_than_k_and_text_keys(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0])], "w string, v array<double>")
    found = {(r.key, r.place): r.match for r in similar_topk(df, "w", "v", 5).collect()}
    assert found == {("a", 1): "b", ("a", 2): "c", ("b", 1): "a", ("b", 2): "c", ("c", 1): "b", ("c", 2): "a"}
    assert similar_topk(df.filter(F.lit(False)), "w", "v", 5).count() == 0


def test_language_counts(spark, rows):
    taught = spark.createDataFrame(
        [("the milk and the bread", "en-GB"), ("le lait et le pain", "FR"), ("xyz xyz", "zz"), ("abc", None), (None, "en"), ("", "fr")],
        "t string, lang string",
    )
    profiles = L.language_profiles(taught, "t", "lang", ["en", "fr"])
    grams = {r["part"]: (r["en"], r["fr"]) for r in profiles.collect() if not r["whole"]}
    whole = {r["part"]: (r["en"], r["fr"]) for r in profiles.collect() if r["whole"]}
    assert set(whole) == {"the", "milk", "and", "bread", "le", "lait", "et", "pain"}
    assert whole["lait"] == tuple(sum(grams.get(g, (0, 0))[i] for g in (" la", "lai", "ait", "it ")) for i in (0, 1))
    # "the" stands twice among 18 trigrams of English words.
    assert grams["the"] == (round(1000 * math.log(2 * 100_000 / 18)), 0) and "xyz" not in grams and "abc" not in grams
    clicks = spark.createDataFrame(
        [("c1", "the milk", "x"), ("c1", "the milk", "x"), ("c2", "the milk", "x"), ("c3", None, "x"), ("c4", "Le lait", "x"), ("c5", "7 qqq", "x"), ("c6", "", "x")],
        "click_id string, text string, banner string",
    )
    columns = ["click_id", "text", "banner"]
    searches = L.search_texts(clicks, columns, "text")
    assert rows(L.language_frequency(clicks, columns, "text", profiles)) == [("en", 2), ("fr", 1), ("und", 2)]
    assert rows(L.language_text_frequency(searches, "text", profiles)) == [("en", "the milk", 2), ("fr", "Le lait", 1), ("und", "", 1), ("und", "7 qqq", 1)]
    assert rows(L.language_frequency(clicks, columns, "text", profiles.filter("not whole"))) == [("en", 2), ("fr", 1), ("und", 2)]
    assert rows(L.language_frequency(clicks, columns, "text", profiles.filter(F.lit(False)))) == [("und", 5)]
    assert rows(L.language_frequency(clicks.limit(0), columns, "text", profiles)) == []


def test_language_scores_shuffle_no_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = spark.createDataFrame([("the", False, 5, 0), ("the", True, 9, 0)], "part string, whole boolean, en bigint, fr bigint")
    plan = L.spoken_languages(docs, "text", profiles)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "text_digest" in exchanges[0] and "SortMergeJoin" not in plan


@pytest.mark.parametrize(("n_words", "least"), [(None, 0.98), (5, 0.9)])
def test_language_of_texts_that_were_not_taught(spark, n_words, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    profiles = L.language_profiles(docs.filter(rest != 0), "text", "lang", ["de", "en", "es", "fr"])
    asked = docs.filter(rest == 0)
    if n_words:
        asked = asked.withColumn("text", F.array_join(F.slice(F.split("text", " "), 1, n_words), " "))
    found = L.language_agreement(asked, "text", "lang", profiles).collect()
    right = sum(r["n_texts"] for r in found if r["declared"] == r["language"]) / sum(r["n_texts"] for r in found)
    print("accuracy", n_words, right)
    assert right >= least


def test_few_queries_move_no_vector(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, v array<double>")
    plan = similar_topk(df, "id", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert not any("vector" in line for line in plan.splitlines() if "Exchange" in line)


def near_pairs(spark, vectors, **settings):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<double>").repartition(3)
    return similar_topk(df, "id", "v", 5, scan_bytes=0, **settings)


@pytest.mark.parametrize("hot", [0, 300])
def test_groups_of_leaves_and_leaves_over_groups(spark, monkeypatch, hot):
    """Groups of two blocks: small leaves share one, a leaf of copies takes many."""
    monkeypatch.setattr(nearest, "GROUP_BYTES", 8 * 4 * 20)
    monkeypatch.setattr(nearest, "QUERY_BYTES", 8 * 4 * 30)
    rng = np.random.default_rng(8)
    vectors = [*rng.normal(size=(260, 4)), *np.tile(rng.normal(size=4), (hot, 1))]
    got = {(r.key, r.match, r.place) for r in near_pairs(spark, vectors, block_rows=10).collect()}
    assert got == brute_force(list(range(len(vectors))), vectors, 5, range(len(vectors)))


def test_queries_travel_once_to_a_group(spark, monkeypatch):
    """Vectors of queries leave their block once for each visited group, however many blocks of keys it holds."""
    sent = []
    cut = nearest.cut_lineage
    monkeypatch.setattr(nearest, "cut_lineage", lambda df: sent.append(cut(df)) or sent[-1])
    monkeypatch.setattr(nearest, "GROUP_BYTES", 8 * 4 * 100)
    rng = np.random.default_rng(9)
    found = near_pairs(spark, rng.normal(size=(400, 4)), block_rows=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan
    _, blocks, routed = sent
    groups = blocks.select("group").distinct().count()
    assert blocks.count() > groups > 8
    assert routed.count() <= blocks.count() * groups
    copies = routed.select(F.explode("q_keys").alias("k"), "group").groupBy("k", "group").count().agg(F.max("count")).first()[0]
    assert copies == 1


def test_two_levels_of_pivots():
    rng = np.random.default_rng(10)
    units = rng.normal(size=(500, 6))
    units /= np.linalg.norm(units, axis=1)[:, None]
    tree = nearest._Tree.of(units[:100])
    head, head_gap, leaf, gap = tree.locate(units)
    assert len(tree.heads) == 10 and len(tree.pivots) == 100 and (np.diff(tree.first) > 0).all()
    assert ((leaf >= tree.first[head]) & (leaf < tree.first[head + 1])).all()
    assert np.allclose(gap, np.linalg.norm(units - tree.pivots[leaf], axis=1), atol=1e-6)
    assert np.allclose(head_gap, np.linalg.norm(units - tree.heads[head], axis=1), atol=1e-6)


def test_a_task_holds_a_few_megabytes_of_vectors():
    # Four workers of an executor hold several copies of both and the best matches so far.
    assert nearest.GROUP_BYTES + nearest.QUERY_BYTES <= 32 << 20
