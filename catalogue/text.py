"""Keywords, similar keys and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import bind
from catalogue.tables import SEARCH
from shelfscope.operators.nearest import similar_topk as nearest
from shelfscope.plans import keywords as K
from shelfscope.plans import language as L
from shelfscope.session import cut_lineage

c = F.col

# --- keywords

_FREQUENCY = f"""{SEARCH}, frequency AS (SELECT lower(keyword) AS keyword, count(*) AS n_requests FROM search
  WHERE NOT regexp_matches(keyword, '^[a-zA-Z0-9]{{15,}}$') GROUP BY 1)"""


@bind("keyword_frequency", f"WITH {_FREQUENCY} SELECT * FROM frequency")
def keyword_frequency(t):
    return K.keyword_frequency(t.search, "keyword")


@bind("keyword_top", f"WITH {_FREQUENCY} SELECT * FROM frequency ORDER BY n_requests DESC, keyword LIMIT 100000")
def keyword_top(t):
    return K.most_frequent(K.keyword_frequency(t.search, "keyword"), 100_000)


@bind(
    "keyword_coverage",
    f"""WITH {_FREQUENCY}, r AS (SELECT *, CAST(sum(n_requests) OVER (ORDER BY n_requests DESC, keyword
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_covered FROM frequency)
    SELECT *, CAST(n_covered AS DOUBLE) / CAST((SELECT sum(n_requests) FROM frequency) AS DOUBLE) AS coverage FROM r""",
)
def keyword_coverage(t):
    return K.keyword_coverage(K.keyword_frequency(t.search, "keyword"))


_NEAR = """near AS (SELECT a.vec_id AS key, b.vec_id AS match, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
    CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, match) AS place FROM near)"""


@bind("similar_topk", f"WITH {_NEAR} SELECT * FROM top WHERE place <= 5")
def similar_topk(t):
    return nearest(t.embeddings, "vec_id", "embedding", k=5)


@bind("similar_topk_routed", f"WITH {_NEAR} SELECT * FROM top WHERE place <= 5")
def similar_topk_routed(t):
    """As for more queries than a task should hold: routed over the tree of pivots, with small blocks."""
    return nearest(t.embeddings, "vec_id", "embedding", k=5, block_rows=256, scan_bytes=0)


# Keys of label 9 are plain numbers, as digit-only searches are; the others are words.
_CONCEPT = f"""WITH RECURSIVE {_NEAR},
  named AS (SELECT vec_id, label, CASE WHEN label = 9 THEN '' ELSE 'word' END || CAST(vec_id AS VARCHAR) AS keyword,
    row_number() OVER (ORDER BY label, vec_id) AS turn FROM embeddings),
  lists AS (SELECT a.turn, a.keyword, list(b.keyword ORDER BY place) FILTER (b.label <> 9) AS matches
    FROM top JOIN named a ON key = a.vec_id JOIN named b ON match = b.vec_id WHERE place <= 5 GROUP BY 1, 2),
  walk(turn, seen, head) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
    UNION ALL
    SELECT l.turn, CASE WHEN list_contains(seen, l.keyword) THEN seen ELSE list_concat(seen, coalesce(l.matches, [])) END,
      NOT list_contains(seen, l.keyword) FROM walk w JOIN lists l ON l.turn = w.turn + 1)
  SELECT keyword, array_to_string(matches, ',') AS matches FROM walk JOIN lists USING (turn)
  WHERE head AND len(matches) > 0"""


@bind("keyword_concept_map", _CONCEPT)
def keyword_concept_map(t):
    name = lambda key, label: F.concat(F.when(label == 9, "").otherwise("word"), key.cast("string"))
    keys = t.embeddings.select("vec_id", "label", name(c("vec_id"), c("label")).alias("keyword"))
    near = nearest(t.embeddings, "vec_id", "embedding", k=5)
    named = near.join(keys.select(c("vec_id").alias("key"), "keyword"), "key").join(
        keys.select(c("vec_id").alias("match"), c("keyword").alias("match_word")), "match"
    )
    matches = cut_lineage(K.drop_digit_matches(named.select("keyword", c("match_word").alias("match"), "place")))
    heads = K.concept_map(keys, matches, ["label", "vec_id"])
    return heads.select("keyword", F.array_join("matches", ",").alias("matches"))


_TYPED = f"""WITH RECURSIVE {_NEAR},
  typed AS (SELECT 'word' || json_extract_string(props, '$.k') AS keyword, count(*) AS n FROM events GROUP BY 1),
  queue AS (SELECT keyword, row_number() OVER (ORDER BY n DESC, keyword) AS turn FROM typed),
  lists AS (SELECT turn, q.keyword, list('word' || CAST(match AS VARCHAR) ORDER BY place) FILTER (place <= 5) AS matches
    FROM queue q LEFT JOIN top ON q.keyword = 'word' || CAST(key AS VARCHAR) GROUP BY 1, 2),
  walk(turn, seen, head) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false
    UNION ALL
    SELECT l.turn, CASE WHEN list_contains(seen, l.keyword) THEN seen ELSE list_concat(seen, coalesce(l.matches, [])) END,
      NOT list_contains(seen, l.keyword) FROM walk w JOIN lists l ON l.turn = w.turn + 1)
  SELECT keyword, array_to_string(matches, ',') AS matches FROM walk JOIN lists USING (turn)
  WHERE head AND len(matches) > 0"""


@bind("keyword_map", _TYPED)
def keyword_map(t):
    typed = t.events.select(F.concat(F.lit("Word"), F.get_json_object("props", "$.k")).alias("typed"))
    vectors = t.embeddings.select(F.concat(F.lit("word"), c("vec_id").cast("string")).alias("key"), "embedding")
    heads = K.keyword_map(typed, "typed", vectors, "key", "embedding")
    return heads.select("keyword", F.array_join("matches", ",").alias("matches"))


# --- languages

_TAGS = ["de", "en", "es", "fr"]
# The gain of a trigram is 0 where a profile lacks it; the earlier tag wins on equal scores.
_LANGUAGE = r"""words AS (SELECT doc_id, lower(regexp_extract(lang, '^[^-_]*')) AS tag,
    unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS word FROM documents),
  grams AS (SELECT doc_id, tag, unnest(list_transform(range(1, length(word) + 1),
    lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM words),
  counted AS (SELECT tag, gram, count(*) AS n FROM grams WHERE tag IN ('de', 'en', 'es', 'fr') GROUP BY 1, 2),
  placed AS (SELECT *, sum(n) OVER (PARTITION BY tag)::BIGINT AS total FROM counted),
  gains AS (SELECT tag AS language, gram, round(ln(n * 1e5 / total) * 1000)::BIGINT AS gain FROM placed
    WHERE n * 100000 >= total),
  scores AS (SELECT doc_id, language, sum(gain) AS score FROM grams JOIN gains USING (gram) GROUP BY 1, 2),
  best AS (SELECT doc_id, language FROM scores WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) = 1),
  spoken AS (SELECT doc_id, text, source, lang AS declared, coalesce(language, 'und') AS language
    FROM documents LEFT JOIN best USING (doc_id))"""


def _profiles(t):
    return L.language_profiles(t.documents, "text", "lang", _TAGS)


_SEARCH_COLUMNS = ["doc_id", "text", "source"]


@bind("language_frequency", f"WITH {_LANGUAGE} SELECT language, count(*) AS n_searches FROM spoken GROUP BY 1")
def language_frequency(t):
    return L.language_frequency(t.documents, _SEARCH_COLUMNS, "text", _profiles(t))


@bind(
    "language_text_frequency",
    f"WITH {_LANGUAGE} SELECT language, text, count(*) AS n_searches FROM spoken GROUP BY 1, 2",
)
def language_text_frequency(t):
    return L.language_text_frequency(L.search_texts(t.documents, _SEARCH_COLUMNS, "text"), "text", _profiles(t))


@bind(
    "language_agreement",
    f"WITH {_LANGUAGE} SELECT declared, language, count(*) AS n_texts FROM spoken GROUP BY 1, 2",
)
def language_agreement(t):
    return L.language_agreement(t.documents, "text", "lang", _profiles(t))
