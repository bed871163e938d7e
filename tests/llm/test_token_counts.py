import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfscope.llm.common import Memory
from shelfscope.llm.token_counts import count_tokens, piece_table, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts):
    assert count_tokens(texts, piece_table(PATH), Memory(50, {})) == [len(LIBRARY.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_text(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "ab", " ", "  ", "\n", "▁", "é", "中", "😀", "<s>", "<0x0A>", "the", "ing", "==", "--", "\t", "\x00"]), max_size=80))
def test_merging_patterns(parts):
    check(["".join(parts)])


def test_repeats_and_long_words():
    rng = random.Random(3)
    check(["a" * 5001, "ab" * 3000, "=-" * 999, "".join(rng.choices("abcdefgh", k=20_000)), " " * 500, "中" * 2000])


def test_rows(odd_documents):
    got = [tuple(r) for r in token_counts(odd_documents, PATH, limit=100).collect()]
    rows = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    want = [(i, len(t.encode()), len(LIBRARY.encode(t)), len(LIBRARY.encode(t)) > 100) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(odd_documents.limit(0), PATH).collect() == []
