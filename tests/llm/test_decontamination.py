import hashlib

import pytest
from conftest import words

from shelfscope.llm.decontamination import contamination, drop_contaminated


def brute_force(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 12, 1)) if w else []:
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, gone, found = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                hit = windows.get(tuple(w[s : s + m]))
                if hit:
                    gone |= set(range(s, s + m))
                    found |= hit
        listed = ",".join(sorted(found))
        out.append((i, len(w), len(gone), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(gone) and 20 * len(gone) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("short", [False, True])
def test_matches_brute_force(corpus_session, odd_documents, prose, short):
    passage = prose(40, 30)
    items = [(1, passage), (2, prose(41, 13)), (3, None), (4, "..."), (10, passage), (11, "a a " * 20), (12, prose(2, 500)[:400])]
    items += [(20, "One two"), (21, "tail"), (22, "ünï")] if short else []
    benchmark = corpus_session.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int")
    more = [
        (201, passage.upper()), (202, passage.replace("é", "É")), (203, prose(42, 400) + ", " + " - ".join(passage.split()[3:16])), (204, " ".join(passage.split()[:12])),
        (205, "a " * 100), (206, prose(41, 13) + " " + prose(41, 13)), (207, "ünï tail"), (208, prose(43, 20) + " " + passage),
    ]
    docs = odd_documents.select("doc_id", "text", "rep").unionByName(corpus_session.createDataFrame([(*r, None) for r in more], "doc_id long, text string, rep string"))
    got = sorted((tuple(r) for r in contamination(docs, benchmark).collect()), key=str)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.collect()], items)
    kept = {r.doc_id for r in drop_contaminated(docs, benchmark).collect()}
    assert kept == {g[0] for g in got if not g[5]} | {None}


def test_empty_tables(corpus_session, odd_documents):
    benchmark = corpus_session.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in contamination(odd_documents, benchmark).collect())
    assert contamination(odd_documents.limit(0), benchmark).collect() == []


def test_letters_that_fold_by_their_neighbours(corpus_session):
    items = [(i, " ".join(f"ΛΟΓΟΣ{c}" if k % 2 else f"{c}ΑΛΦΑΣ" for k, c in enumerate(f"{i:02}" * 7))[:-1]) for i in range(20)]
    docs = [(i, text.replace(" ", ".")) for i, text in items] + [(100 + i, text.replace(" ", "'")) for i, text in items]
    got = contamination(corpus_session.createDataFrame(docs, "doc_id long, text string"), corpus_session.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(docs, items)
