import numpy as np
import pyarrow as pa
from conftest import words

from shelfscope.llm.license_scan import BASE_PHRASES, TEMPLATES, Index, license_labels, vocabulary
from shelfscope.llm.ragged import alphanumeric, text_bytes
from shelfscope.llm.ragged import words as ragged_words


def base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        found = [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def phrases(text):
    spaced = " " + " ".join(words(text)) + " "
    return {t.label for t in TEMPLATES if f" {t.phrase} " in spaced}


def test_matches_plain_search(corpus_session, odd_documents, prose):
    more = [(300 + i, f"{prose(i, 20)}\n{t.text.title()}. {prose(i + 50, 20)}") for i, t in enumerate(TEMPLATES)]
    more += [
        (400, "CC-BY cc by, CC BY-NC 4.0"), (401, "all rights"), (402, "reserved all rights reserved all rights reserved"), (403, "general public"), (404, "license general public license"),
        (405, "GENERAL\nPUBLIC\tLICENSE"), (406, "mit"), (407, "the MIT license"), (408, "Gnu General Public License, version 3 Apache License 2.0"), (409, "cc byé cc by"), (410, "by cc"), (411, "cc"), (412, "by"),
    ]
    docs = odd_documents.select("doc_id", "text", "rep").unionByName(corpus_session.createDataFrame([(*r, None) for r in more], "doc_id long, text string, rep string")).coalesce(2)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    got = license_labels(docs).collect()
    assert len(got) == docs.count()
    want = {(i, *base(t), ",".join(sorted(phrases(t) | set(filter(None, base(t)[-1].split(","))))) ) for i, t in rows}
    assert {tuple(r)[:-1] for r in got} == want
    score = {r["__id"]: r["score"] for r in got}
    assert all(abs(score[300 + i] - 1) < 1e-9 for i in range(len(TEMPLATES))) and 0 < score[407] < 1 and score[401] == 0
    assert license_labels(docs.limit(0)).collect() == []


def test_base_phrases_are_found_by_their_rarest_words():
    common = {"all": 900, "general": 800, "license": 700, "cc": 500, "reserved": 20, "rights": 30, "public": 40, "by": 600}
    index = Index({w: common.get(w, 1) for w in vocabulary()}, 1000)
    name = index.known.names
    got = {label: [(name[w], at) for w, at in anchors] for _, anchors, label in index.base}
    assert got == {"cc-by": [("cc", 0), ("by", 1)], "gpl": [("public", 1), ("license", 2)], "reserved": [("reserved", 2), ("rights", 1)]}
    data, offsets = text_bytes(pa.array(["all " * 50 + "rights all reserved", "reserved all rights reserved", "public license", "x general public license cc by"]))
    starts, base, _, _ = index.scan(np.array(data), ragged_words(data, offsets, alphanumeric()))
    assert starts == [[], [1], [], [4, 1]] and base == [set(), {"reserved"}, set(), {"cc-by", "gpl"}]
