import random
import re

import pytest

from shelfscope.llm.common import begin

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    """Words as the corpus operators take them: A-Z lowered, runs of ASCII letters and digits and of other characters."""
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="session")
def corpus_session(spark):
    begin(spark)
    return spark


@pytest.fixture(scope="session")
def prose():
    """Seeded prose: a function from a seed and a number of words to a text."""

    def make(seed, n):
        rng = random.Random(seed)
        vocabulary = ["".join(random.Random(i).choices("abcdeéßtnors", k=1 + i % 7)) for i in range(400)]
        return " ".join(rng.choices(vocabulary, k=n))

    return make


@pytest.fixture(scope="session")
def odd_documents(corpus_session, prose):
    """Documents with nulls in every column, empty and long texts, repeated rows, and extra columns with awkward names."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One two"), (8, base + " tail"), (9, "Ünï\x00cödé ✓ 😀"),
        (10, prose(2, 60_000)), (11, prose(2, 60_000)), (12, "same same " * 300), (13, "!!! ??? ..."), (14, "x" * 40_000), (None, base), (None, prose(3, 50)),
    ]
    rows = [(i, t, None if i == 3 else "en", None if i in (None, 4) else f"host{i % 3}", 7, "z", None) for i, t in rows]
    return corpus_session.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, __lost long, keep_id string, rep string"
    ).repartition(3)
