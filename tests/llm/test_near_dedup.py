import math
import random
from collections import Counter

import numpy as np
from conftest import words

from shelfscope.llm.components import components
from shelfscope.llm.near_dedup import Settings, drop_near_duplicates, near_duplicates, samples


def counted(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b, idf):
    weigh = lambda c: {k: (1 + math.log(v)) * idf(k) for k, v in c.items()}
    x, y = weigh(a), weigh(b)
    common = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
    return common / (sum(x.values()) + sum(y.values()) - common) if x or y else 0.0


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_groups_match_all_pairs(corpus_session, odd_documents, prose):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for family in range(6):
        base = prose(100 + family, 200)
        rows += [(1000 + 100 * family + k, edited(base, k, k % (2 + family))) for k in range(30)]
    docs = corpus_session.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component int").repartition(4)
    got = near_duplicates(docs).collect()
    sets = {t or "": counted(t) for _, t in rows}
    df, n, gain = Counter(k for _, t in rows for k in sets[t or ""]), len(rows), Settings().gain
    idf = lambda k: 1 + gain * math.log((1 + n) / (1 + df[k])) / math.log(1 + n)
    group = {r["__id"]: r["group_id"] for r in got}
    text = {i: t or "" for i, t in rows if i is not None}
    ids = sorted(text)
    links = {(i, j): similarity(sets[text[i]], sets[text[j]], idf) for i in ids for j in ids if i < j and sets[text[i]].keys() & sets[text[j]].keys()}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), s in links.items():
        if s >= 0.8 and not (text[i] == text[j]):
            assert group[i] == group[j], (i, j, s)
        if s >= 0.8 - 1e-3:
            parent[root(i)] = root(j)
    first = {}
    for i in ids:
        parent[root(i)] = root(first.setdefault(text[i], i))
    for i in ids:
        assert root(i) == root(group[i])
        for j in ids:
            if text[i] == text[j]:
                assert group[i] == group[j]
    assert all(r["kept"] == (r["__id"] is None or r["__id"] == r["group_id"]) for r in got) and len(got) == len(rows)
    kept = drop_near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r["__id"]) for r in got if r["kept"])


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 52, 300).astype(np.uint64))
    a, b = np.arange(0, 250), np.arange(50, 300)
    weight = rng.uniform(1, 3, 300).astype(np.float32)
    other = (weight * rng.uniform(0.8, 1.2, 300)).astype(np.float32)
    drawn = samples(np.concatenate([hashes[a], hashes[b]]), np.concatenate([weight[a], other[b]]), np.array([0, 250, 500]), 4000)
    common = np.minimum(weight[50:250], other[50:250]).sum()
    want = common / (weight[a].sum() + other[b].sum() - common)
    assert abs((drawn[0] == drawn[1]).mean() - want) < 0.03


def test_components(corpus_session):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    pairs = corpus_session.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["component"] for r in components(pairs).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}


def test_empty_table(odd_documents):
    assert near_duplicates(odd_documents.limit(0)).collect() == []


def test_of_repeated_rows_one_stays(corpus_session, prose):
    base = prose(21, 80)
    docs = corpus_session.createDataFrame([(1, base), (1, base), (2, base + " x"), (3, prose(22, 80)), (3, prose(22, 80)), (None, base), (None, base)], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(docs).collect()) == ["1", "3", "None", "None"]
