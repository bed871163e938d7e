import hashlib
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfscope.llm import common
from shelfscope.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, window):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 10])
def test_matches_brute_force(corpus_session, odd_documents, prose, window):
    shared = prose(9, 60)
    more = [
        (101, prose(20, 50) + " " + shared + " " + prose(21, 30)), (102, shared[10:] + "\n" + prose(22, 80)), (103, prose(23, 34)), (104, prose(23, 35)),
        (105, prose(24, 35)), (106, "z " + prose(24, 35)), (107, prose(25, 20) + " " + prose(26, 40) + " q " + prose(26, 40)), (108, "a b " * 40), (109, "a b " * 17 + "c"),
        (110, " ".join(prose(27, 40).split()[:36])), (111, "Z Z " * 36),
    ]
    docs = odd_documents.select("doc_id", "text", "rep").unionByName(corpus_session.createDataFrame([(*r, None) for r in more], "doc_id long, text string, rep string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in remove_repeats(docs, window).collect()), key=str)
    assert got == brute_force(rows, window)


def test_texts_and_empty_table(odd_documents):
    kept = {r["__id"]: r["kept"] for r in remove_repeats(odd_documents.filter("doc_id IN (6, 7)"), with_text=True).collect()}
    assert kept == {6: "one", 7: "One two"}
    assert remove_repeats(odd_documents.limit(0)).collect() == []


def test_a_written_stage_leaves_no_shuffle_files(corpus_session):
    spark = corpus_session
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    setting = spark.conf.get(common.DROP_SHUFFLES, "false")
    known = shuffled()
    staged = common.stage(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "counts")
    for _ in range(50):
        if not shuffled() - known:
            break
        time.sleep(0.2)
    assert not shuffled() - known
    assert staged.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(common.DROP_SHUFFLES, "false") == setting
