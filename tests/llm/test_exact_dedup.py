import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfscope.llm.exact_dedup import cut_points, drop_duplicates, exact_duplicates
from shelfscope.llm.queries import QUERIES, SQL
from shelfscope.llm.ragged import text_bytes


def expected(rows):
    """One row for each row, as a multiset; of the rows that may stay for a text one does."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for place, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out[i, keep, len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hash_bits", [64, 3, 1])
def test_matches_brute_force_also_when_chunk_hashes_clash(odd_documents, hash_bits):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert Counter(tuple(r) for r in exact_duplicates(odd_documents, hash_bits=hash_bits).collect()) == expected(rows)


def test_agrees_with_its_sql_on_repeated_rows_and_null_ids(corpus_session, odd_documents, tmp_path):
    odd_documents.unionByName(odd_documents.filter("doc_id IN (2, 6, 10) OR doc_id IS NULL")).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = connection.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({SQL['op1_exact_dedup']})").fetchall()
    ours = QUERIES["op1_exact_dedup"](corpus_session, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, ours)) == Counter(theirs) and len(ours) == len(theirs)


def test_drop_keeps_one_row_for_each_text(odd_documents):
    kept = drop_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in odd_documents.collect()})
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(2) == 1 and 1 not in ids and 3 not in ids and {4, 11} <= set(ids)


def test_texts_that_all_lack_an_id(corpus_session):
    docs = corpus_session.createDataFrame([(None, "a", 1), (None, "a", 2), (None, None, 3), (5, "b", 4), (5, "b", 5), (5, "c", 6)], "doc_id long, text string, __changed_9 int")
    assert sorted(str((r.doc_id, r.text)) for r in drop_duplicates(docs).collect()) == ["(5, 'b')", "(5, 'c')", "(None, 'a')", "(None, None)"]


def test_empty_table(odd_documents):
    assert exact_duplicates(odd_documents.limit(0)).collect() == []


def test_cuts_depend_on_content_only(prose):
    long = prose(5, 20_000)
    column = pa.array(["", long, long[5000:], "", "short"])
    data, offsets = text_bytes(column)
    ends = cut_points(data, offsets)
    sets = [{int(e - offsets[i]) for e in ends if offsets[i] < e <= offsets[i + 1]} for i in range(5)]
    shift = len(long[:5000].encode())
    late = {e - shift for e in sets[1] if e > shift + 100}
    assert len(late) > 10 and late == {e for e in sets[2] if e > 100}
    assert sets[4] == {5} and not sets[0] and set(offsets[1:].tolist()) - {0} <= set(ends.tolist())
    assert np.diff(ends).max() <= 1 << 15
