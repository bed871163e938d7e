import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import hard_negatives as module
from shelfscope.llm.hard_negatives import hard_negatives, highest, packed_scores

SCHEMA = "id long, label int, vector array<float>, row string, key long"


def brute(rows):
    """Every anchor against every row, as the contract says it."""
    rows = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in {(a, label, tuple(v)) for a, label, v in rows if a % 50 == 0}:
        scored = sorted((-score(v, w), c, other) for c, other, w in rows if c != a)
        for p, c, _ in [x for x in scored if x[2] == label][:5]:
            bad = [(s, n) for s, n, other in scored if other != label and -50 * p <= -100 * s <= -95 * p][:3]
            out += [(a, c, k, n, -p, -s) for k, (s, n) in enumerate(bad, 1)]
    return sorted(out)


def made(seed, n, width, scale=0.3, labels=4):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [round(rng.gauss(0, scale), 3) for _ in range(width)]) for i in range(n)]


def run(session, rows, **limits):
    df = session.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives(df, F.col("id") % 50 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize(("n", "width", "scale"), [(700, 6, 0.3), (300, 1, 2.0), (260, 40, 1000.0)])
def test_against_brute_force(corpus_session, n, width, scale):
    rows = made(n, n, width, scale)
    assert run(corpus_session, rows) == brute(rows) != []


def test_many_cells(corpus_session, monkeypatch):
    monkeypatch.setattr(module, "CANDIDATE_BYTES", 2000)
    monkeypatch.setattr(module, "ANCHOR_BYTES", 200)
    rows = made(4, 600, 5)
    assert run(corpus_session, rows) == brute(rows)


def test_odd_rows(corpus_session):
    nan, inf = float("nan"), float("inf")
    rows = made(5, 120, 3, labels=2)
    rows += [(200, None, [1.0, 0.0, 0.0]), (None, 1, [1.0, 1.0, 1.0]), (250, 1, None), (300, 1, [nan, 0.0, 1.0]), (350, 1, [1.0, inf, 0.0]), (400, 0, [1.0, None, 0.0])]
    rows += [(450, 1, []), (451, 0, [0.5]), (0, rows[0][1], rows[0][2]), (7, rows[7][1], rows[7][2]), (500, 9, [0.1, 0.2, 0.3])]
    rows += [(600 + i, i % 2, [0.25, 0.25, 0.25]) for i in range(12)] + [(650, 1, [0.25, 0.25, 0.25])]
    assert run(corpus_session, rows) == brute(rows)
    assert run(corpus_session, rows[:0]) == []


@pytest.mark.parametrize("scale", [1, 300, 10**5, 10**9, 10**15])
def test_packed_scores_are_exact(scale):
    rng = np.random.default_rng(scale)
    for n, width in ((1, 1), (5, 7), (100, 64)):
        c, a = (rng.integers(-scale, scale + 1, (m, width)) for m in (n, 9))
        want = a.astype(object) @ c.astype(object).T
        want = np.clip(want, -(2**63), 2**63 - 1).astype(np.int64)
        got = np.concatenate([rows for _, rows in packed_scores(c, a)])
        assert (got == want).all()


def test_highest_keeps_the_order_of_ties():
    assert highest(np.array([3, 5, 5, 1, 5, 3]), 4).tolist() == [1, 2, 4, 0]
    assert highest(np.zeros(0, np.int64), 4).tolist() == []


def test_no_cross_join(corpus_session):
    df = corpus_session.createDataFrame([(*r, "x", 1) for r in made(1, 100, 4)], SCHEMA)
    plan = hard_negatives(df, F.col("id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
