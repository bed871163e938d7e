import random
import subprocess
import sys
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfscope.llm import packing
from shelfscope.llm.packing import Encoder, Places, fill, make_plan, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])) | st.lists(st.sampled_from(["A", "É", "µ", "İ", "Σ", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "é", " ", "\n", "\t", "\r", "1", ".", ",", "²", "_", "\u0301", "ª", "ÿ", "Ā", "ñandú", "größe"])).map("".join), max_size=6))
def test_ids_are_the_librarys(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(PATH).ids(texts)] == [library_ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7))
def test_fill_is_as_full_as_can_be(capacity, counts):
    reach = {0}
    for length, n in counts.items():
        reach = {r + length * k for r in reach for k in range(n + 1) if r + length * k <= capacity}
    used = fill(capacity, counts)
    assert sum(k * v for k, v in used.items()) == max(reach)
    assert all(0 < v <= counts[k] for k, v in used.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=12), st.integers(0, 3))
def test_plan_places_every_token_once(counts, slack):
    places = Places(make_plan(counts, 64, slack))
    sequences = defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            parts = places.of(length, rank)
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == length
            for _, size, number, offset in parts:
                sequences[number].append((offset, size))
    for spans in sequences.values():
        spans.sort()
        ends = np.cumsum([s for _, s in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1]]
        assert ends[-1] <= 64 and (ends[-1] & (ends[-1] - 1) == 0 or ends[-1] >= 64 - slack)


@pytest.mark.parametrize("window", [64, 4096])
def test_pieces(odd_documents, window):
    pieces = pack(odd_documents, PATH, separator=2, window=window).collect()
    texts = odd_documents.collect()
    ids = defaultdict(list)
    for r in texts:
        ids[r.doc_id].append(library_ids(r.text) + [2])
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    sequences = defaultdict(list)
    for p in pieces:
        crcs = [zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for x in ids[p["__id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in crcs
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    empty = 0
    for spans in sequences.values():
        spans.sort()
        ends = np.cumsum([s for _, s in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1]] and ends[-1] <= window
        empty += 0 if ends[-1] & (ends[-1] - 1) == 0 else window - ends[-1]
    assert empty <= 0.02 * sum(p["length"] for p in pieces) + window
    assert pack(odd_documents.limit(0), PATH, separator=2).collect() == []


class Counted:
    """A tokenizer that counts the texts and words it is asked for."""

    def __init__(self, inner):
        self.inner, self.model, self.asked = inner, self, 0

    def tokenize(self, word):
        self.asked += 1
        return self.inner.model.tokenize(word)

    def encode_batch_fast(self, column, **options):
        self.asked += len(column)
        return self.inner.encode_batch_fast(column, **options)


def test_words_not_remembered_share_calls(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    text = " ".join("".join(c) + end for c, end in zip(product("bdgklmnoétu", repeat=4), ["", ".", "", "!!", "'s", ""] * 1000))
    encoder = Encoder(PATH)
    counted = {k: Counted(v) for k, v in vars(encoder).items() if isinstance(v, Tokenizer)}
    vars(encoder).update(counted)
    assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == library_ids(text)
    assert sum(c.asked for c in counted.values()) < 6000 / 100


def test_ids_with_a_full_memory_are_the_librarys(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    draw, encoder = random.Random(7), Encoder(PATH)
    parts = ["the", "ing", "É", "größe", "st", "'s", "''", "'RE", "-", "42", "«", "?»", "°", "×", "²", "\t", "<|", "<|endoftext|>", "”", "слово", "ΣΑΣ", "e\u0301", " ", "\n", "  "]
    for _ in range(40):
        texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(20)]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == [library_ids(t) for t in texts]
    assert len(encoder.words) == 50 and encoder.ids([]) == []


KEPT = """
import random, re, sys
from shelfscope.llm.packing import Encoder
draw, encoder = random.Random(7), Encoder(sys.argv[1])
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
words = ["".join(draw.choices("bdgklmnoetu", k=7)) for _ in range(30_000)]
texts = [" ".join(draw.choices(words, k=500)) for _ in range(1000)]
before = held()
for _ in range(4):
    encoder.ids(texts)
print(held() - before)
"""


def test_an_encoder_keeps_little_between_calls():
    """Workers outlive a query, so what they keep adds to what an executor holds in all later ones."""
    done = subprocess.run([sys.executable, "-c", KEPT, PATH], env={"PYTHONPATH": ":".join(sys.path)}, capture_output=True, text=True, check=True)
    assert int(done.stdout) < 25


def test_pack_makes_no_table_of_rows_on_the_driver(spark, monkeypatch):
    """Such a table is read through Python workers of its own, which executors then hold besides the encoding ones."""
    docs = spark.createDataFrame([(i, "bird " * (i % 7)) for i in range(50)], "doc_id long, text string")

    def refused(*_, **__):
        raise AssertionError("rows sent from the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    pieces = pack(docs, PATH, separator=2, window=64).collect()
    assert sorted((p["__id"], p["length"]) for p in pieces if p["start"] == 0) and sum(p["length"] for p in pieces) == sum(i % 7 + 1 for i in range(50))


def test_cut_pieces_of_many_documents(spark):
    """Documents of one length, no two of which share a window, are strung together and cut at most window ends."""
    rows = [(i, " ".join(["bird", "stone", "river", "cloud"][(i >> 2 * k) % 4] for k in range(39))) for i in range(200)]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, separator=2, window=64).collect()
    ids, covered = {i: library_ids(t) + [2] for i, t in rows}, defaultdict(list)
    for p in pieces:
        part = ids[p["__id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["__id"]])
        covered[p["__id"]].append((p["start"], p["length"]))
    assert len(pieces) > 250 and covered.keys() == ids.keys()
    for i, spans in covered.items():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] == len(ids[i])
