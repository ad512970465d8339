"""Name and text normalisation, rule labels and similarity."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# The word lists, patterns and abbreviations that decide the results.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
GENERIC_WORDS = (
    "university", "college", "state", "of", "and", "community", "junior", "cc", "jc", "hs",
    "high", "school", "saint", "north", "south", "east", "west", "northern", "southern",
    "eastern", "western", "central", "christian", "baptist", "tech", "a", "m", "campus",
)
LEVELS = ("4YR", "JC", "HS")
SERVICE_ACADEMY = r"(?<!Military )(?<!Naval )(?<!Air Force )(?<!Coast Guard )Academy"
NAME_RULES = (
    (
        rf"\bHS\b|High School|{SERVICE_ACADEMY}|\bPrep\b|Secondary|\bSS\b|Colegio|\bSchool\b(?! of)",
        "HS",
    ),
    (r"\bCC\b|\bJC\b|Community College|Junior College|Comm Col", "JC"),
    (r"University|\bUniv\b|\bU\b|Institute of Technology", "4YR"),
)
TEXT_RULES = (
    (rf"High School|\bHS\b|{SERVICE_ACADEMY}", "HS"),
    (r"Community College|Junior College|\bCC\b|\bJC\b", "JC"),
    (r"University", "4YR"),
)
STATE_TAG = r"\s*\(([A-Z]{2})\)\s*$"
LOCATION = r"\s*\([^()]*,\s*([A-Z]{2})\)\s*$"
KEY_WORDS = (
    (r"\bstate university of new york\b|\bsuny\b", " "),
    (r"\bunc\b", "north carolina"),
    (r"\b(at|the)\b", " "),
    (r"\s+", " "),
    (r"\b(mount|mt) st\b", "$1 saint"),
    (r"^ ?st\b", "saint"),
    (r"\bst\b", "state"),
    (r"\b(u|univ)\b", "university"),
    (r"\bcol\b", "college"),
    (r"\bmt\b", "mount"),
)
KEY_AFFIXES = ("^university of ", "^college of ", " university$", " college$")


@pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    def fold(v):
        return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))

    return s.map(fold, na_action="ignore")


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark SQL has no such function.

    ASCII text, whose bytes are its characters, is its own folding and does not go to Python.
    """
    other = F.octet_length(c) > F.char_length(c)
    return F.when(other, _folded(F.when(other, c))).otherwise(c)


@pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Short text with all character references decoded, named and numbered."""
    return s.map(lambda v: html.unescape(v) if "&" in v else v, na_action="ignore")


def acronyms(key: Column) -> Column:
    """How a key may be abbreviated: the initials of its words but 'of' and 'and', and these without
    the first 's'."""
    lettered = F.filter(F.split(key, " "), lambda t: ~t.isin("of", "and", ""))
    letters = F.array_join(F.transform(lettered, lambda t: F.substring(t, 1, 1)), "")
    return F.array_distinct(F.array(letters, F.regexp_replace(letters, "^([^s]*)s", "$1")))


def distinctive_words(key: Column) -> Column:
    """Words of a key that are not generic."""
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    return F.filter(F.array_except(F.split(key, " "), generic), lambda w: w != "")


def first_match(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern found in the text."""
    out = F
    for pattern, label in rules:
        out = out.when(c.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def clean_cell(c: Column) -> Column:
    """Table-cell text without [footnotes], non-breaking spaces or outer blanks."""
    no_notes = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", "")
    return F.trim(F.translate(no_notes, "\u00a0", " "))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_location(c: Column) -> Column:
    """Text without a closing '(place, XX)': 'Harbor Works (Dock Town, ZZ)' -> 'Harbor Works'."""
    return F.trim(F.regexp_replace(c, LOCATION, ""))


def location_state(c: Column) -> Column:
    state = F.regexp_extract(c, LOCATION, 1)
    return F.when(state != "", state)


def strip_state_tag(c: Column) -> Column:
    return F.regexp_replace(c, STATE_TAG, "")


def state_tag(c: Column) -> Column:
    tag = F.regexp_extract(c, STATE_TAG, 1)
    return F.when(tag != "", tag)


def person_key(c: Column) -> Column:
    """Name without accents, case, punctuation or generation suffixes; '' when missing."""
    s = F.translate(F.lower(fold_accents(F.coalesce(c, F.lit("")))), ".'’", "")
    words = F.split(F.regexp_replace(s, r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_SUFFIXES)), " ")


def entity_key(c: Column) -> Column:
    """Loose key of an institution name: folded, with common abbreviations written out."""
    s = F.lower(fold_accents(c))
    s = F.replace(F.regexp_replace(s, r"\[[^\]]*\]", " "), F.lit("&"), F.lit(" and "))
    s = F.regexp_replace(s, r"[.'’ʻ]", "")
    s = F.regexp_replace(s, r"[^a-z0-9]+", " ")
    for pattern, replacement in KEY_WORDS:
        s = F.regexp_replace(s, pattern, replacement)
    return squeeze(s)


def key_variants(key: Column) -> Column:
    """The key itself and without its affixes, as a distinct array free of empty keys."""
    forms = [key] + [F.trim(F.regexp_replace(key, affix, "")) for affix in KEY_AFFIXES]
    return F.filter(F.array_distinct(F.array(*forms)), lambda k: k != "")


def pool_key(raw: Column) -> Column:
    """Spelling variants share a pool; a trailing state tag keeps namesakes apart."""
    return F.concat_ws("|", entity_key(strip_state_tag(raw)), F.coalesce(state_tag(raw), F.lit("")))


def names_consistent(key: Column, other_key: Column) -> Column:
    """Could two institution keys name the same place?

    They share a distinctive word, or the first is the other's acronym, which may leave out
    the first 's' ('lsu', 'tcu').
    """
    shared = F.size(F.array_intersect(distinctive_words(key), F.split(other_key, " "))) > 0
    is_acronym = (F.length(key) >= 2) & ~key.contains(" ") & F.array_contains(acronyms(other_key), key)
    return F.coalesce((shared & (key != "") & (other_key != "")) | is_acronym, F.lit(False))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


@pandas_udf(DoubleType())
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-100: twice the common subsequence over the total length; null for an empty side."""
    return pd.Series(
        [
            200.0 * _common_subsequence(x, y) / (len(x) + len(y)) if x and y else None
            for x, y in zip(a, b, strict=True)
        ],
        dtype="float64",
    )


def sorted_tokens(key: Column) -> Column:
    return F.array_join(F.sort_array(F.split(key, " ")), " ")


def token_sort_score(key: Column, other_key: Column) -> Column:
    """Similarity of two normalised names regardless of word order."""
    score = subsequence_ratio(sorted_tokens(key), sorted_tokens(other_key))
    return F.when(~F.isnan(score), score)


def same_last_initial(key: Column, other_key: Column) -> Column:
    """Last word and first letter agree."""
    last, other_last = F.substring_index(key, " ", -1), F.substring_index(other_key, " ", -1)
    same = (last == other_last) & (F.substring(key, 1, 1) == F.substring(other_key, 1, 1))
    return F.coalesce((key != "") & (other_key != "") & same, F.lit(False))
