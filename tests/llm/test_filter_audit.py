import re
from collections import Counter
from itertools import permutations

import pytest

from shelfscope.llm.filter_audit import COUNTS, filter_interactions


def brute(docs, labels):
    """Counts of every part, order and step by walking the rows."""
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    failed = []
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        f["E"] = r.doc_id is not None and first[text] < r.doc_id
        failed.append((r.lang or "", {k for k, v in f.items() if v}, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                n = Counter()
                for p, f, g, t in failed:
                    if p == part:
                        before, fails = f & set(order[: step - 1]), letter in f
                        gone = fails and not before
                        for name, true in zip(COUNTS, (not before and not fails, gone, fails and before, f == {letter}, gone and g, gone and t), strict=True):
                            n[name] += bool(true)
                shapley[letter] += n["removed"]
                out[part, order, step] = tuple(n[c] for c in COUNTS)
        for (p, order, step), values in list(out.items()):
            if p == part:
                out[p, order, step] = (*values, shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def some_labels(corpus_session):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (8, None, 1), (10, 1, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1), (4, 0, 0)]
    return corpus_session.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_against_a_walk_over_the_rows(corpus_session, odd_documents, some_labels, prose):
    more = [(20, prose(5, 300), "de"), (21, prose(5, 300), "en"), (22, "WORD " * 200, "de"), (23, " ".join(f"w{i}" for i in range(150)), ""), (24, "a | b", None), (20, prose(5, 300), "fr")]
    docs = odd_documents.select("doc_id", "text", "lang", "source").unionByName(corpus_session.createDataFrame([(*r, "s") for r in more], "doc_id long, text string, lang string, source string"))
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*COUNTS, "shapley")) for r in filter_interactions(docs, some_labels).collect()}
    assert got == brute(docs.collect(), some_labels.collect())


def test_empty_and_unlabelled(odd_documents, some_labels):
    assert filter_interactions(odd_documents.limit(0), some_labels).collect() == []
    rows = filter_interactions(odd_documents, some_labels.limit(0)).collect()
    assert len(rows) == 600 * len({r.lang or "" for r in odd_documents.collect()}) and not any(r.good_lost or r.toxic_lost for r in rows)


def test_nothing_is_joined_on_a_text(odd_documents, some_labels):
    plan = filter_interactions(odd_documents, some_labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Cartesian", "NestedLoop", "Python"))
