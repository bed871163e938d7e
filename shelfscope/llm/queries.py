"""The corpus operators bound to the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    filter_audit,
    hard_negatives,
    html_extract,
    language_id,
    license_scan,
    near_dedup,
    packing,
    substring_dedup,
    token_counts,
    toxicity,
)
from shelfscope.llm.common import begin, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Operators of documents that run on web pages too: their rows have a page_id.
PAGE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def bind(name: str, sql: str | None = None, into: dict[str, Callable[[SparkSession, str], DataFrame]] = QUERIES):  # noqa: B006
    """Register a function of (session, opener of tables) under a name, with its SQL counterpart."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            begin(spark)
            return build(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        into[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@bind(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(table):
    found = exact_dedup.exact_duplicates(table("documents"))
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@bind("op2_html_extraction")
def op2(table):
    return html_extract.main_text(table("pages")).withColumnRenamed("__id", "page_id")


@bind("op3_token_counts")
def op3(table):
    counted = token_counts.token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("__id", "doc_id")


@bind("op7_packing")
def op7(table):
    packed = packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"), separator=2)
    return packed.withColumnRenamed("__id", "doc_id")


@bind(
    "op4_decontamination",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    iw AS (SELECT item_id, least(len(ws), 13) AS m, unnest(range(0, greatest(len(ws) - 12, 1))) AS s, ws FROM i WHERE len(ws) > 0),
    windows AS (SELECT DISTINCT item_id, m, array_to_string(ws[s + 1 : s + m], ' ') AS t FROM iw),
    dw AS (SELECT doc_id, m, unnest(range(0, len(ws) - m + 1)) AS s, ws FROM w, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m),
    hit AS (SELECT doc_id, s, d.m, item_id FROM (SELECT doc_id, m, s, array_to_string(ws[s + 1 : s + m], ' ') AS t FROM dw) d
            JOIN windows ON d.m = windows.m AND d.t = windows.t),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
           coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
    FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
    """,
)
def op4(table):
    return decontamination.contamination(table("documents"), table("benchmark")).withColumnRenamed("__id", "doc_id")


# Messages, and the recursive form of the chats over them.
_CHATS = r"""
    WITH RECURSIVE quoted AS (%s), raw AS (SELECT row_number() OVER () AS m, conv_id, turn, coalesce(trim(role), 'unknown') AS role,
                        string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM quoted),
    lines AS (SELECT m, conv_id, turn, role, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM raw),
    marked AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level,
                      regexp_replace(line, '^[ \t]*((?:>[ \t]?)*)', '') AS body FROM lines),
    ahead AS (SELECT *, regexp_matches(line, '^.*\bwrote:[ \t]*$')
                        AND coalesce(lead(level) OVER (PARTITION BY m ORDER BY i), 0) > level AS says FROM marked),
    kept AS (SELECT m, conv_id, turn, role, i, level, body FROM ahead WHERE NOT says),
    passages AS (SELECT DISTINCT conv_id, turn, level, whole, trim(regexp_replace(lower(body), '[ \t\n\r\f\x{00a0}]+', ' ', 'g')) AS p FROM (
        SELECT conv_id, turn, level, 0 AS whole, body FROM kept
        UNION ALL SELECT conv_id, turn, level, 1, string_agg(body, chr(10) ORDER BY i) FROM kept GROUP BY m, conv_id, turn, level)),
    replies AS (SELECT conv_id, turn, arg_max(source, ROW(-level, whole, source)) AS parent_turn FROM (
        SELECT q.conv_id, q.turn, q.level, q.whole, o.turn AS source FROM passages q JOIN passages o
        ON q.conv_id = o.conv_id AND q.p = o.p AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 AND q.p <> '') GROUP BY conv_id, turn),
    up AS (SELECT conv_id, turn, parent_turn AS thread_turn, 1 AS depth FROM replies
           UNION ALL SELECT up.conv_id, up.turn, r.parent_turn, depth + 1 FROM up JOIN replies r ON r.conv_id = up.conv_id AND r.turn = up.thread_turn),
    top AS (SELECT conv_id, turn, min(thread_turn) AS thread_turn, max(depth) AS depth FROM up GROUP BY ALL),
    content AS (SELECT m, conv_id, turn, role, count(*) FILTER (level > 0) AS n_quoted, regexp_replace(trim(regexp_replace(
        coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '\n{3,}', chr(10) || chr(10), 'g')), '^\s+|\s+$', '', 'g') AS content
        FROM kept GROUP BY ALL),
    placed AS (SELECT c.conv_id, c.turn, c.role, r.parent_turn, coalesce(t.thread_turn, c.turn) AS thread_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
                      c.n_quoted, c.content FROM content c LEFT JOIN replies r USING (conv_id, turn) LEFT JOIN top t USING (conv_id, turn))
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role, content, n_quoted) AS position,
           '<|' || role || '|>' || chr(10) || content || chr(10) || '<|end|>' AS formatted FROM placed
    """


@bind("op5_chat_format", _CHATS % "SELECT * FROM conversations")
def op5(table):
    return chat_format.format_chats(table("conversations"))


# The test table has no quotes: here every message quotes, as mail programs do, the one it answers and what that one quoted.
_ANSWERED = "turn - 1 - turn % 2"
_QUOTE = """coalesce(p_role, 'someone') || ' wrote:' || chr(10)
    || coalesce('> ' || coalesce(g_role, 'someone') || ' wrote:' || chr(10) || '> > ' || replace(g_text, chr(10), chr(10) || '> > ') || chr(10), '')
    || '> ' || replace(p_text, chr(10), chr(10) || '> ') || chr(10)"""
_QUOTED = f"""WITH one AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
    SELECT c.conv_id, c.turn, c.role, coalesce({_QUOTE}, '') || coalesce(c.text, '') AS text FROM conversations c
    LEFT JOIN (SELECT conv_id, turn AS p_turn, role AS p_role, text AS p_text FROM one) p ON c.conv_id = p.conv_id AND {_ANSWERED.replace("turn", "c.turn")} = p_turn
    LEFT JOIN (SELECT conv_id, turn AS g_turn, role AS g_role, text AS g_text FROM one) g ON c.conv_id = g.conv_id AND {_ANSWERED.replace("turn", "p_turn")} = g_turn"""


def quoting(messages: DataFrame) -> DataFrame:
    """Messages with the quotes above: a message of turn t answers turn t - 1 - t % 2, if there is one."""
    one = messages.filter("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))

    def answered(prefix: str) -> DataFrame:
        return one.select("conv_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("turn", "role", "text")])

    asked = messages.select("conv_id", "turn", "role", "text", F.expr(_ANSWERED).alias("p_turn")).join(answered("p"), ["conv_id", "p_turn"], "left")
    before = F.when(F.col("p_text").isNotNull(), F.expr(_ANSWERED.replace("turn", "p_turn")))
    asked = asked.withColumn("g_turn", before).join(answered("g"), ["conv_id", "g_turn"], "left")
    return asked.select("conv_id", "turn", "role", F.concat(F.coalesce(F.expr(_QUOTE), F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


@bind("op5_chat_format_quoted", _CHATS % _QUOTED)
def op5_quoted(table):
    return chat_format.format_chats(stage(quoting(table("conversations")), "quoted"))


@bind("op6_near_dedup")
def op6(table):
    return near_dedup.near_duplicates(table("documents")).withColumnRenamed("__id", "doc_id")


@bind(
    "op8_substring_dedup",
    r"""
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    starts AS (SELECT doc_id, unnest(range(0, len(ws) - 34)) AS s, ws FROM split WHERE len(ws) >= 35),
    windows AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 35], ' ') AS w FROM starts),
    hit AS (SELECT doc_id, s FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
    covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM hit),
    placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM split),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
             FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)
    """,
)
def op8(table):
    cleaned = substring_dedup.remove_repeats(table("documents"), window=35)
    return cleaned.withColumnsRenamed({"__id": "doc_id", "kept": "kept_sha256"})


@bind("op9_language_id")
def op9(table):
    docs = table("documents")
    return language_id.identify(docs, declared=docs["lang"], host=docs["source"]).withColumnRenamed("__id", "doc_id")


@bind("op9_language_id_pages", into=PAGE_QUERIES)
def op9_pages(table):
    return language_id.identify_pages(table("pages")).withColumnRenamed("__id", "page_id")


@bind("op10_license_scan")
def op10(table):
    return license_scan.license_labels(table("documents")).withColumnRenamed("__id", "doc_id")


@bind("op11_toxicity")
def op11(table):
    return toxicity.toxicity(table("documents"), table("labels")).withColumnRenamed("__id", "doc_id")


@bind(
    "op12_filter_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
    l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
          FROM w LEFT JOIN l USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    steps AS (SELECT filter_order, step, substring(filter_order, step, 1) AS letter, 1 << (ascii(substring(filter_order, step, 1)) - 65) AS bit,
                     CAST(list_sum([1 << (ascii(z) - 65) for z in string_split(filter_order[1:step - 1], '') if z <> '']) AS INTEGER) AS before
              FROM orders, (SELECT unnest(range(1, 6)) AS step)),
    summed AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
                      sum(CASE WHEN mask & (bit | coalesce(before, 0)) = 0 THEN n ELSE 0 END) AS kept,
                      sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN mask & coalesce(before, 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
                      sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
               FROM cells, steps GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
    """,
)
def op12(table):
    return filter_audit.filter_interactions(table("documents"), table("labels"))


@bind(
    "op13_hard_negatives",
    """
    WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                      [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding]) IS NOT false),
    s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
          FROM (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0) a JOIN e c ON a.vec_id <> c.vec_id),
    p AS (SELECT a, c AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5)
    SELECT a AS anchor_id, p AS positive_id, CAST(row_number() OVER (PARTITION BY a, p ORDER BY score DESC, c) AS INTEGER) AS rank, c AS negative_id,
           ps AS positive_score, score AS negative_score
    FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
    QUALIFY row_number() OVER (PARTITION BY a, p ORDER BY score DESC, c) <= 3
    """,
)
def op13(table):
    rows, label = table("embeddings"), F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(
        rows.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0
    )
