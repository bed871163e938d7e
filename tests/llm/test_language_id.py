import random

from pyspark.sql import functions as F

import __spark_entry__ as contract
from shelfscope.llm.language_id import drop_rejected, identify, identify_pages, page_evidence

FOLDER = "/root/testdata/sf0.01"


def test_wrong_declarations_are_overruled_by_text(corpus_session):
    docs = corpus_session.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    docs = docs.withColumn("said", F.when(wrong, F.lit("en")).otherwise(F.col("lang")))
    found = identify(docs, docs["said"], docs["source"]).join(docs.withColumnRenamed("doc_id", "__id"), "__id")
    right, all_, accepted = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count(F.lit(1)), F.count_if("accepted")).head()
    assert right >= 0.97 * all_ and accepted == all_


def test_pages_by_markup_suffix_and_host(corpus_session):
    pages = corpus_session.read.parquet(f"{FOLDER}/pages.parquet")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>", " "), "<[^>]*>", " ")
    declared = F.regexp_extract("html", r'(?i)<html[^>]*\blang="?([a-z]+)', 1)
    host = F.parse_url("url", F.lit("HOST"))
    found = identify(pages, declared, host, F.regexp_extract(host, r"\.([a-z]+)$", 1), id_column="page_id", text=visible)
    path = F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1)
    right, all_ = found.join(pages, found["__id"] == pages["page_id"]).agg(F.count_if(F.col("language") == path), F.count(F.lit(1))).head()
    assert right >= 0.97 * all_


def test_hosts_settle_what_texts_leave_open(corpus_session):
    train = [(i, text, lang, host) for lang, text, host in (("aa", "baba dada gaga", "h1"), ("bb", "bobo dodo gogo", "h2")) for i in range(30)]
    rows = [(i, f"{t} {i}", lang, h) for i, (_, t, lang, h) in enumerate(train)] + [(900, "mmm mmm", None, "h1"), (901, "mmm mmm", None, "h2"), (902, "bobo dodo gogo", "aa", "h1")]
    docs = corpus_session.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["__id"]: r for r in identify(docs, docs["lang"], docs["source"]).collect()}
    assert got[902]["language"] == "bb"
    assert all(got[i]["language"] == lang for i, _, lang, _ in rows[:60])


def test_odd_documents(odd_documents):
    got = [r for r in identify(odd_documents, odd_documents["lang"], odd_documents["source"]).collect()]
    assert len(got) == odd_documents.count()
    verdict = {r["__id"]: r["accepted"] for r in got}
    assert not verdict[3] and not verdict[4] and not verdict[5] and not verdict[13] and verdict[1] and verdict[10]
    kept = drop_rejected(odd_documents, odd_documents["lang"], odd_documents["source"])
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 10, None}
    assert identify(odd_documents.limit(0), odd_documents["lang"], odd_documents["source"]).collect() == []
    silent = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert not any(r["accepted"] for r in identify(silent, silent["lang"], silent["source"]).collect())


def test_every_declared_language_is_scored(corpus_session):
    words = {f"l{i:03}": ["".join(random.Random(100 * i + k).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(8)] for i in range(150)}
    truth = [name for i, name in enumerate(words) for _ in range(4 if i < 70 else 3)]
    rows = [(k, " ".join(random.Random(k).choices(words[name], k=40)), None if k % 3 == 2 else name, "h") for k, name in enumerate(truth)]
    docs = corpus_session.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["__id"]: r for r in identify(docs, docs["lang"], docs["source"]).collect()}
    assert [got[k]["language"] for k in range(len(truth))] == truth == [got[k]["text_language"] for k in range(len(truth))]
    assert drop_rejected(docs, docs["lang"], docs["source"]).count() == len(truth)


def test_registered_query_scores_all_pages(corpus_session):
    pages = corpus_session.read.parquet(f"{FOLDER}/pages.parquet")
    found = contract.queries()["op9_language_id_pages"](corpus_session, FOLDER)
    path = F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1)
    right, all_, ids = found.join(pages, "page_id").agg(F.count_if(F.col("language") == path), F.count(F.lit(1)), F.count_distinct("page_id")).head()
    assert right >= 0.97 * all_ and ids == all_ == pages.count()


def test_suffix_settles_what_text_and_host_leave_open(corpus_session):
    rows = [(i, f"http://{suffix}{i % 3}.example.{suffix}/p", f'<html lang="{lang}"><p>{text} {i}</p></html>') for lang, text, suffix in (("aa", "baba dada gaga", "ax"), ("bb", "bobo dodo gogo", "bx")) for i in range(60)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + [(900, "http://new.ax", "<p>mmm mmm</p>"), (901, "http://new.bx:80/?q", "<p>mmm mmm</p>"), (902, None, None)]
    pages = corpus_session.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["__id"]: r for r in identify_pages(pages).collect()}
    assert len(got) == len(rows) and got[900]["language"] == "aa" and got[901]["language"] == "bb" and got[902]["language"] is None
    assert got[900]["posterior"] > 0.6 and got[901]["posterior"] > 0.6


def test_evidence_of_pages(corpus_session):
    rows = [
        (1, "https://u:p@Www.Example.CO.uk:8080/x?y#z", "<!DOCTYPE html><HTML class=\"a\" LANG='pt-BR'><title>T</title><script>no</script><p>a&eacute;<b>b</b></p><!-- no -->c"),
        (2, "http://10.0.0.1/", '<html xml:lang="de"><body data-lang="fr">x'), (3, None, None), (4, "not an address |", ""),
    ]
    pages = corpus_session.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (" ".join(r["text"].split()), r["declared"], r["host"], r["suffix"]) for r in page_evidence(pages).collect()}
    assert got == {1: ("T aéb c", "pt", "www.example.co.uk", "uk"), 2: ("x", None, "10.0.0.1", None), 3: ("", None, None, None), 4: ("", None, None, None)}
