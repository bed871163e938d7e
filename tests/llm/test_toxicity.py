import random
import zlib

import pytest

from shelfscope.llm.toxicity import ABUSE, NEGATED, PATTERNS, REPORTED, TARGETED, THREAT, Lexicon, Model, fixed_classes, grammar, matches, prior_odds, ratio, toxicity

FOLDER = "/root/testdata/sf0.1"
ODDS = {"idiot": 3.0, "kill": 0.5}
WORDS = Lexicon(fixed_classes(), ODDS)


@pytest.mark.parametrize(
    ("text", "marks"),
    [
        ("What an idiot.", 0),
        ("You are an idiot.", TARGETED),
        ("idiot that you are", TARGETED),
        ("idiot one two three four you", TARGETED),
        ("idiot one two three four five you", 0),
        ("you one two three four idiot", TARGETED),
        ("you one two three four five idiot", 0),
        ("You are not an idiot", NEGATED | TARGETED),
        ("not one two three idiot", 0),
        ("never an idiot", NEGATED),
        ("the man said idiot", REPORTED),
        ("they wrote that he is no idiot", REPORTED | NEGATED | TARGETED),
        ("said so. idiot", 0),
        ("not so, an IDIOT", NEGATED),
    ],
)
def test_marks_of_a_clause(text, marks):
    assert list(matches(text, WORDS)) == [("idiot", ABUSE * 8 + marks)]


def test_matches_follow_their_words():
    got = list(matches("kill the idiot for you; I kill idiot idiot", WORDS))
    assert got == [("kill", THREAT * 8), ("idiot", ABUSE * 8 + TARGETED), ("kill", THREAT * 8), ("idiot", ABUSE * 8), ("idiot", ABUSE * 8)]


def plain(words):
    """The marks of each abuse or threat by looking around it."""
    kinds = fixed_classes()
    of = [kinds.get(w, 0) for w in words]
    out = []
    for i, kind in enumerate(of):
        if kind in (ABUSE, THREAT):
            marks = NEGATED if 4 in of[max(0, i - 3) : i] else 0
            marks |= REPORTED if 5 in of[:i] else 0
            before = i - 1 - max((j for j in range(i) if of[j] == 3), default=-99)
            near = before <= 4
            for j in range(i + 1, min(len(of), i + 6)):
                if of[j] == 3:
                    near = True
                if of[j] in (ABUSE, THREAT, 3):
                    break
            out.append((words[i], kind * 8 + marks + TARGETED * near))
    return out


def test_machine_equals_looking_around():
    lexicon = Lexicon(fixed_classes(), {w: 1.0 for w, k in fixed_classes().items() if k in (ABUSE, THREAT)})
    rng = random.Random(3)
    for _ in range(3000):
        words = rng.choices(["idiot", "kill", "you", "not", "said", "x", "y"], weights=[3, 1, 2, 2, 1, 8, 8], k=rng.randrange(25))
        assert list(matches(" ".join(words), lexicon)) == plain(words), words
    assert len(grammar().ending) < 2000


def test_scores_add_up_evidence():
    model = Model(WORDS, {p: prior_odds(p) - prior_odds(ABUSE * 8) for p in PATTERNS}, 0.01)
    score = model.score
    assert score("") == pytest.approx(0.01)
    assert score("you are an idiot") > score("an idiot") > score("he said idiot") > score("not an idiot") > score("kind words")
    assert score("an idiot. an idiot") > score("an idiot")
    assert score("kill the process") < 0.5 < score("idiot")


def test_ratio():
    assert ratio(6, 6, 1000, 10_000) > 25 > ratio(5, 5, 1000, 10_000) and ratio(1, 10, 10, 100) == pytest.approx(0)


def test_held_out_labels(corpus_session):
    docs, labels = (corpus_session.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r["__id"]).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, toxic[r["__id"]]) for r in rows if r.held_out and r["__id"] in toxic]
    assert sum(p == t for p, t in judged) > 0.97 * len(judged)
    assert sum(p for p, t in judged if t) > 0.9 * sum(t for _, t in judged)


def test_held_out_labels_and_other_columns_do_not_matter(corpus_session, odd_documents):
    labels = [(i, 1, int(i % 3 == 0)) for i in range(1, 15)]
    changed = [(i, None, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labels]
    one, two = (sorted((str(r) for r in toxicity(odd_documents, corpus_session.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, changed))
    assert one == two


def test_odd_documents(corpus_session, odd_documents):
    labels = corpus_session.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    rows = toxicity(odd_documents, labels).collect()
    assert sorted((r["__id"] is None, r["__id"] or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd_documents.collect())
    assert not any(r.held_out for r in rows if r["__id"] is None)
    assert toxicity(odd_documents.limit(0), labels).collect() == []
    assert len(toxicity(odd_documents, labels.limit(0)).collect()) == len(rows)
