"""Share of search languages, by trigram profiles that are learned from texts of declared language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.language import NOT_A_LETTER, UNKNOWN, primary_tag, trigrams

# A trigram or word belongs to a profile from this share of its language on: one in so many. There are no more of them than that.
RAREST = 100_000
# Profiles of up to this many languages are broadcast: RAREST rows a language at most, of a few dozen bytes, for words and for trigrams.
BROADCAST_LANGUAGES = 8
# Gains are whole thousandths of a natural logarithm, so that their sums do not depend on the order of addition.
GAIN_UNIT = 1000


def _digest(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def _words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each word with the key of its text.

    The key is computed before the explode: behind it a digest would be taken once per word. The outer form keeps the
    optimizer from a filter on the number of words that would split each text twice.
    """
    split = texts.select(key, F.split(F.lower(F.col(text)), NOT_A_LETTER).alias("__words"))
    return split.select(key, F.explode_outer("__words").alias("word"))


def _frequent(counted: DataFrame, part: str) -> DataFrame:
    """Counts per language and ``part`` of those that make up enough of it, with the ``__total`` of the language."""
    # One sum per language, added up from counts that are one row per part already.
    totals = counted.groupBy("__tag").agg(F.sum("__n").alias("__total"))
    return counted.join(totals, "__tag").filter(F.col("__n") * RAREST >= F.col("__total")).select("__tag", part, "__n", "__total")


def language_profiles(texts: DataFrame, text: str, declared: str, languages: Sequence[str]) -> DataFrame:
    """What one sighting of a ``part`` says for each of ``languages``, a column each.

    Parts are trigrams, and frequent words (``whole``) with the sum over their trigrams, which saves most look-ups. The gain
    of a trigram is the logarithm of its share in the language over the least share a profile holds; one without a place in
    a profile gains nothing there, so rare and common languages start alike. Declared tags count by their primary part;
    texts of other or no language, null and empty texts teach nothing. Words are counted before they are cut into
    trigrams. Of a large corpus write the result as a stage: it has at most ``RAREST`` trigrams and words a language.
    """
    known = texts.select(primary_tag(F.col(declared)).alias("__tag"), text).filter(F.col("__tag").isin(*languages))
    words = _words(known, "__tag", text).filter(F.col("word") != "").groupBy("__tag", "word").agg(F.count(F.lit(1)).alias("__n"))
    cut = words.select("__tag", "__n", trigrams(F.col("word")).alias("__grams")).select("__tag", "__n", F.explode_outer("__grams").alias("part"))
    placed = _frequent(cut.groupBy("__tag", "part").agg(F.sum("__n").alias("__n")), "part")
    share = F.col("__n") * F.lit(float(RAREST)) / F.col("__total")
    gains = placed.select("__tag", "part", F.round(F.log(share) * GAIN_UNIT).cast("bigint").alias("__gain"))
    columns = [F.coalesce(F.max(F.when(F.col("__tag") == tag, F.col("__gain"))), F.lit(0)).alias(tag) for tag in languages]
    grams = gains.groupBy("part").agg(*columns)
    common = _frequent(words, "word").select("word").distinct().select("word", trigrams(F.col("word")).alias("__grams"))
    common = common.select("word", F.explode_outer("__grams").alias("part")).join(grams, "part", "left")
    whole = common.groupBy(F.col("word").alias("part")).agg(*[F.coalesce(F.sum(tag), F.lit(0)).alias(tag) for tag in languages])
    return grams.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)))


def spoken_languages(texts: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    """``text_digest`` (SHA-256) and ``language`` of each different text that shares a trigram with a profile.

    Rows with the same text add to one score, which multiplies that of every language alike. So no text has to be made
    unique first, and none is shuffled: tasks add up the gains of a text before one row per text leaves them. A word is
    looked up whole, and only where it is not known by its trigrams, with the same sum. On equal scores the earlier tag
    wins; texts in which no language gains anything are left out.
    """
    languages = sorted(c for c in profiles.columns if c not in ("part", "whole"))
    whole = profiles.filter("whole").select(F.col("part").alias("word"), *[F.col(tag).alias(f"__whole_{tag}") for tag in languages])
    grams = profiles.filter("not whole").select("part", *languages)
    if len(languages) <= BROADCAST_LANGUAGES:
        # Without the hint all words would be shuffled before the size of a profile is known.
        whole, grams = F.broadcast(whole), F.broadcast(grams)
    words = _words(texts.select(_digest(text).alias("text_digest"), text), "text_digest", text).join(whole, "word", "left")
    sums = [f"__whole_{tag}" for tag in languages]
    none = F.array(F.lit(None).cast("string"))
    parts = words.select("text_digest", *sums, F.when(F.col(sums[0]).isNull(), trigrams(F.col("word"))).otherwise(none).alias("__grams"))
    parts = parts.select("text_digest", *sums, F.explode_outer("__grams").alias("part")).join(grams, "part", "left")
    gained = [F.sum(F.coalesce(f"__whole_{tag}", tag, F.lit(0))).alias(tag) for tag in languages]
    scores = parts.groupBy("text_digest").agg(*gained)
    best = F.greatest(*[F.col(tag) for tag in languages]) if len(languages) > 1 else F.col(languages[0])
    named = F.coalesce(*[F.when(F.col(tag) == best, F.lit(tag)) for tag in languages])
    return scores.filter(best > 0).select("text_digest", named.alias("language"))


def _with_language(counted: DataFrame, texts: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    spoken = spoken_languages(texts, text, profiles)
    return counted.join(spoken, "text_digest", "left").withColumn("language", F.coalesce("language", F.lit(UNKNOWN)))


def search_texts(clicks: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """One row per search: records have one row per product, so they repeat. Searches without text drop out."""
    return clicks.filter(F.col(text).isNotNull()).select(*columns).distinct()


def language_text_frequency(searches: DataFrame, text: str, profiles: DataFrame) -> DataFrame:
    """Searches per language and text; null texts are one text of unknown language."""
    counted = searches.groupBy(text).agg(F.count(F.lit(1)).alias("n_searches")).withColumn("text_digest", _digest(text))
    return _with_language(counted, searches, text, profiles).select("language", text, "n_searches")


def language_frequency(clicks: DataFrame, columns: Sequence[str], text: str, profiles: DataFrame) -> DataFrame:
    """Searches per language, straight from the records; ``columns`` other than the text identify a search.

    Long texts do not travel: a SHA-256 of the text stands in for it when repeated records are removed.
    """
    others = [c for c in columns if c != text]
    known = clicks.filter(F.col(text).isNotNull())
    searches = known.select(*others, _digest(text).alias("text_digest")).distinct()
    counted = searches.groupBy("text_digest").agg(F.count(F.lit(1)).alias("n"))
    spoken = _with_language(counted, known, text, profiles)
    return spoken.groupBy("language").agg(F.sum("n").alias("n_searches"))


def language_agreement(texts: DataFrame, text: str, declared: str, profiles: DataFrame) -> DataFrame:
    """Texts per declared and found language."""
    counted = texts.groupBy(F.col(declared).alias("declared"), _digest(text).alias("text_digest")).agg(F.count(F.lit(1)).alias("n"))
    spoken = _with_language(counted, texts, text, profiles)
    return spoken.groupBy("declared", "language").agg(F.sum("n").alias("n_texts"))
