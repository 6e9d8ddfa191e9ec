"""Text functions as native column expressions; Arrow functions only for entities, stems and sequence similarity."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .stemmer import stem_word

#: Question words dropped before a keyword search.
QUESTION_WORDS = [
    "how", "often", "what", "which", "when", "where", "who", "whom", "whose", "why", "whether", "must", "can", "could", "shall", "should", "would", "will", "may", "might", "need", "needs",
    "required", "require", "does", "do", "did", "is", "are", "was", "were", "be", "been", "has", "have", "any", "many", "much", "there", "still", "now", "also", "please", "tell", "explain", "list",
]
#: Stop words of the published English Snowball list.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]
#: Weights of the letters of positions in a search vector; a position without a letter weighs as D.
POSITION_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: One lexeme of a search vector written as text: quoted, quotes doubled, with positions or without.
LEXEME = r"'([^']*+(?:''[^']*+)*+)'(?::([0-9]+[A-D]?(?:,[0-9]+[A-D]?)*))?"
#: Number words and multipliers.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100,
}
MULTIPLIERS = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000}


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None else None)


def clean(c: Column) -> Column:
    """Repairs of extracted text: links to their text, ``\\_``, split ordinals and hyphens, blanks. Entities: apply ``unescape`` first."""
    c = F.regexp_replace(c, r"\[([^\]]+)\]\((?:https?://|www\.)[^)]*\)", "$1")
    c = F.replace(c, F.lit("\\_"), F.lit("_"))
    c = F.regexp_replace(c, r"\b(\d{1,2})\s+(st|nd|rd|th)\b", "$1$2")
    c = F.regexp_replace(c, r"(?U)(\w)-\s+(?!(?:and|or|to)\b)(\w)", "$1-$2")
    c = F.regexp_replace(c, r"\bMoneyLaundering\b", "Money-Laundering")
    c = F.regexp_replace(c, r"\bAnti(?=[A-Z][a-z])", "Anti-")
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def squash(c: Column) -> Column:
    """Form for matching quotes: quotes and dashes unified, white space and hyphens dropped, lower case."""
    c = F.translate(c, "‘’`“”–—‐‑­", "'''\"\"-----")
    return F.lower(F.regexp_replace(c, r"[\s\-   -     　\u0085\u001c-\u001f]+", ""))


def numbers_in(c: Column) -> Column:
    """Distinct numeric values (array<double>) of a text: digits with separators, number words, and a multiplier right after either."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"\d[\d,]*(?:\.\d+)?|[a-z]+"), F.lit(0))
    values, scale = _map({k: float(v) for k, v in NUMBER_WORDS.items()}), _map({k: float(v) for k, v in MULTIPLIERS.items()})

    def value(t: Column, i: Column) -> Column:
        own = F.coalesce(F.expr("cast(null as double)"), F.when(t.rlike(r"^\d"), F.regexp_replace(t, ",", "").try_cast("double")).otherwise(F.try_element_at(values, t)))
        return own * F.coalesce(F.try_element_at(scale, F.coalesce(F.get(tokens, i + 1), F.lit(""))), F.lit(1.0))

    return F.array_distinct(F.filter(F.transform(tokens, value), lambda v: v.isNotNull()))


def number_text(c: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))


def query_words(c: Column) -> Column:
    """Distinct words of a query without question words; single characters only if they are digits."""
    return F.array_distinct(F.filter(words(c), lambda w: ~w.isin(QUESTION_WORDS) & ((F.length(w) > 1) | w.rlike(r"^\d$"))))


def query_stems(c: Column) -> Column:
    """Distinct stems of the words of a query without question words and stop words, in the same way as stored lexemes are made; single characters
    only if they are digits."""
    kept = F.filter(F.flatten(F.transform(words(c), lambda w: F.when(w.contains("-"), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w)))), lambda w: (w != "") & ~w.isin(QUESTION_WORDS) & ~w.isin(STOP_WORDS))
    return F.array_distinct(F.filter(stems(kept), lambda w: (F.length(w) > 1) | w.rlike(r"^\d$")))


def lexemes(tsv: Column) -> Column:
    """array<struct<lexeme, weight, first>> of a search vector written as text; null gives null.

    ``weight`` is the sum of the weights of its positions, 0 for a lexeme without positions. A lexeme listed twice is ``first`` once.
    """
    names = F.transform(F.regexp_extract_all(tsv, F.lit(LEXEME), F.lit(1)), lambda t: F.replace(t, F.lit("''"), F.lit("'")))
    marked = lambda p, k: F.length(p) - F.length(F.replace(p, F.lit(k), F.lit("")))
    places = lambda p: F.when(p == "", 0).otherwise(F.length(p) - F.length(F.replace(p, F.lit(","), F.lit(""))) + 1)
    extra = lambda p: sum(((w - POSITION_WEIGHTS["D"]) * marked(p, k) for k, w in POSITION_WEIGHTS.items() if k != "D"), F.lit(0.0))
    weights = F.transform(F.regexp_extract_all(tsv, F.lit(LEXEME), F.lit(2)), lambda p: F.when(p.rlike("[ABC]"), POSITION_WEIGHTS["D"] * places(p) + extra(p)).otherwise(POSITION_WEIGHTS["D"] * places(p)))
    once = F.size(F.array_distinct(names)) == F.size(names)
    first = F.when(once, F.transform(names, lambda _: F.lit(True))).otherwise(F.transform(names, lambda t, i: F.array_position(names, t) == i + 1))
    return F.transform(F.arrays_zip(names.alias("n"), weights.alias("w"), first.alias("f")), lambda x: F.struct(x["n"].alias("lexeme"), F.round(x["w"], 6).alias("weight"), x["f"].alias("first")))


@F.pandas_udf(ArrayType(StringType()))
def stems(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ws: None if ws is None else list(dict.fromkeys(stem_word(w) for w in ws)))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, 2M / T, of two lower-cased texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def snippet(c: Column, n: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)


# ---- labels of a chunk -----------------------------------------------------------------------

def _region(region: Column) -> Column:
    return F.when(region != "main", F.replace(region, F.lit("annex_"), F.lit("Annex ")))


def _part() -> Column:
    return F.when(F.col("parts") > 1, F.format_string(" (part %d/%d)", F.col("part"), F.col("parts"))).otherwise("")


def where_label() -> Column:
    """'para 42', 'Annex I para 5 (part 2/3)', 'Annex I ...' from region, para, para_title, part and parts."""
    para = F.when(blank_to_null(F.col("para")).isNotNull(), F.concat(F.lit("para "), F.col("para"))).otherwise(F.coalesce(blank_to_null(F.col("para_title")), F.lit("preamble")))
    return F.trim(F.concat(F.coalesce(_region(F.col("region")), F.lit("")), F.lit(" "), para, _part()))


def page_label() -> Column:
    start, end = F.col("page_start"), F.col("page_end")
    return F.when(start.isNull(), "").when(end.isNotNull() & (end != 0) & (end != start), F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))


def location() -> Column:
    """Path of a chunk, joined by ' › ', with part and pages."""
    path = F.array_compact(F.array(_region(F.col("region")), F.when(F.col("chapter") != "", F.col("chapter")), F.when(F.col("section") != "", F.col("section"))))
    has_title = F.coalesce(F.col("para_title") != "", F.lit(False))
    numbered = F.concat(path, F.array(F.concat(F.lit("para "), F.col("para"), _part(), F.when(has_title, F.concat(F.lit(": "), F.col("para_title"))).otherwise(""))))
    titled = F.concat(path, F.array(F.concat(F.col("para_title"), _part())))
    last = F.when(F.size(path) > 0, F.concat(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.array(F.concat(F.element_at(path, -1), _part())))).otherwise(path)
    full = F.when(F.coalesce(F.col("para") != "", F.lit(False)), numbered).when(has_title & ~F.array_contains(path, F.col("para_title")), titled).otherwise(last)
    pages = page_label()
    tail = F.when(pages == "", "").when(pages.contains("-"), F.concat(F.lit(", pp. "), pages)).otherwise(F.concat(F.lit(", p. "), pages))
    return F.concat(F.array_join(full, " › "), tail)


def embed_text() -> Column:
    """Text given to an embedder: path of headings, then the text. Empty parts are skipped."""
    region = F.when(F.col("region") != "main", F.replace(F.col("region"), F.lit("annex_"), F.lit("Annex ")))
    title = blank_to_null(F.col("para_title"))
    numbered = F.concat(F.lit("para "), F.col("para"), F.coalesce(F.concat(F.lit(": "), title), F.lit("")))
    place = F.coalesce(blank_to_null(F.col("chapter")), region)
    label = F.when(blank_to_null(F.col("para")).isNotNull(), numbered).when(~F.coalesce(title.eqNullSafe(F.col("section")) | title.eqNullSafe(place), F.lit(False)), title)
    head = F.array_join(F.array_compact(F.array(blank_to_null(F.col("title")), place, blank_to_null(F.col("section")), label)), " › ")
    return F.concat_ws("\n", head, F.col("text"))


# ---- boilerplate -----------------------------------------------------------------------------

#: Closing lines without a rule, placeholders of deleted paragraphs, circular references.
CLOSING = r"(?i)requested to (?:ensure|note)\b|ensure strict compliance|strict compliance of this|acknowledge (?:the )?receipt|yours faithfully|for (?:your )?information and (?:necessary|appropriate) action"
DELETED = r"(?i)^(?:\d{1,3}[A-Z]?\.\s*)?(?:\d{1,3}\s*)?\[?\s*(?:Deleted|\*+)\s*\]?\.?\s*(?:\d{1,3})?$"
CIRCULAR_NUMBER = r"\d{2}\.\d{2}\.\d{2,3}/\d{4}-\d{2}"
#: Prefix of the issuer's own numbers.
ISSUER = "RBI"
CIRCULAR_ROW = r"^\s*\d{1,3}\.\s*\|.*\|\s*(?:[A-Z][a-z]+\s+\d{1,2}\s*,\s*\d{4}|\d{2}\.\d{2}\.\d{4})\b"


def is_circular_list(text: Column, issuer: str = ISSUER) -> Column:
    """At least three lines, at least half of them rows of a list of circulars: with a circular's number, or with one that starts with ``issuer``."""
    number = rf"{CIRCULAR_NUMBER}|{issuer}/\d{{4}}-\d{{2}}/\d+"
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: (F.trim(x) != "") & ~x.startswith("["))
    rows = F.filter(lines, lambda x: x.rlike(number) | x.rlike(CIRCULAR_ROW))
    return (F.size(lines) >= 3) & (F.size(rows) * 2 >= F.size(lines))


def is_boilerplate(text: Column, parts: Column, max_chars: int = 300) -> Column:
    short = (parts == 1) & (F.length(text) <= max_chars) & (text.rlike(CLOSING) | text.rlike(DELETED))
    return F.coalesce(short, F.lit(False)) | F.coalesce(is_circular_list(text), F.lit(False))
