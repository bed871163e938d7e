"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import pytest
from conftest import words

import compare
import corpus_pipeline
from shelfscope.llm.near_dedup import near_duplicates
from shelfscope.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(corpus_session, name):
    assert compare.differences(corpus_session, compare.duck(FOLDER), name, FOLDER)[1] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_a_row_for_each_input(corpus_session, name):
    table = "pages" if name.startswith("op2") else "documents"
    key = "page_id" if name.startswith("op2") else "doc_id"
    got = QUERIES[name](corpus_session, FOLDER).select(key).distinct().count()
    assert got == corpus_session.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_chat_format"])
def test_native_plans_run_no_python(corpus_session, name):
    plan = QUERIES[name](corpus_session, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline(corpus_session, odd_documents):
    docs = odd_documents.select("doc_id", "text", "lang", "source")
    stages = {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(apply(corpus_session, docs, FOLDER), name)
        assert after.columns == docs.columns
        stages[name] = (docs.collect(), after.collect())
        docs = after
    before, after = stages["language_id"]
    assert all(any(c.isalpha() for w in words(r.text) for c in w) for r in after if r.doc_id is not None)
    before, after = stages["exact_dedup"]
    assert sorted(r.text for r in after) == sorted({r.text for r in before})
    before, after = stages["near_dedup"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {8}
    pieces = corpus_pipeline.STAGES[-1][1](corpus_session, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    # Row 2 was delivered twice and is packed once.
    assert sum(p.length for p in pieces if p.doc_id == 2) == max(p.doc_tokens for p in pieces if p.doc_id == 2)
    assert near_duplicates(docs).filter("group_id != class_id").isEmpty()


def test_run(corpus_session):
    pieces = corpus_pipeline.run(corpus_session, FOLDER)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and pieces.count() > 0
