"""Letter trigrams of a text and the tag of a declared language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "und"

NOT_A_LETTER = r"[^\p{L}]+"
# Three characters around a letter, found at every place: blanks stand for both ends of a word, none spans two words.
AROUND_A_LETTER = r"(?=(.\p{L}.))"


def trigrams(text: Column) -> Column:
    """All letter trigrams of the lower-cased words of a whole text, with a blank at both ends of a word."""
    spaced = F.regexp_replace(F.lower(text), NOT_A_LETTER, " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(AROUND_A_LETTER), F.lit(1))


def primary_tag(declared: Column) -> Column:
    """The first part of a language tag in small letters: ``en`` of ``en-US`` and ``EN_gb``."""
    return F.lower(F.regexp_extract(declared, "^[^-_]*", 0))
