"""Text, string and url functions as Column expressions; the few that built-ins can't express are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

TOKEN = r"[^\p{Punct}\p{Space}]+"
MIN_SIZE = 2
#: Fixed default stop words.
STOPWORDS = ("the", "and", "for", "with", "that", "this", "are", "was", "der", "die", "das", "und", "les", "des", "que", "los", "las", "para")


def tokens(text: Column) -> Column:
    """Words between punctuation and white space, of more than two characters."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > MIN_SIZE)


def without_stopwords(words: Column, stopwords=STOPWORDS) -> Column:
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(words, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(stop, F.lower(t)))


def key(text: Column, stopwords=STOPWORDS) -> Column:
    """What a text is looked up by: its words without stop words, joined by single spaces."""
    return F.array_join(without_stopwords(tokens(text), stopwords), " ")


def ngrams(text: Column, n: int = 3, pad: str = "$") -> Column:
    """Lower-cased character n-grams, padded on both sides; repeats are kept."""
    padded = F.concat(F.lit(pad * (n - 1)), F.lower(text), F.lit(pad * (n - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, n))


def strip_iri(text: Column) -> Column:
    return F.regexp_replace(text, r"^<(.*)>$", "$1")


def strip_literal(text: Column) -> Column:
    """Strips a short language tag after the closing quote, or the quotes of an untagged literal."""
    tagged = F.regexp_replace(text, r'^(".*")@[A-Za-z-]{1,7}$', "$1")
    return F.when(text.rlike(r'^".*"$'), F.regexp_replace(text, r'^"(.*)"$', "$1")).otherwise(tagged)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(" [...] ("), F.length(text).cast("string"), F.lit(")"))).otherwise(text)


def percent_decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def clean_markup(text: Column) -> Column:
    """Newlines and angle brackets to spaces, double spaces to one, once."""
    return F.replace(F.regexp_replace(text, r"[\n\r<>]", " "), F.lit("  "), F.lit(" "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def html_text(html: Column) -> Column:
    """Title line, then what is left of the body without scripts, styles and tags."""
    body = F.regexp_replace(html, r"(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>", " ")
    return F.concat(html_title(html), F.lit("\n"), F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f]+", " ")))


def label_norm(text: Column) -> Column:
    """Drops # , . ; _ and - to spaces; words in one case to capitals; camel case is split where there is no space."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[#,.]", ""), r"[_-]", " ")
    capital = F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))
    one_case = (F.length(t) > 4) & ((t == F.upper(t)) | (t == F.lower(t)))
    split = F.when(t.contains(" "), t).otherwise(F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2"))
    return F.when(one_case, capital).otherwise(split)


def iri(base: str, column: Column) -> Column:
    return F.concat(F.lit(base), F.translate(column, " ", "_"))


@pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, without backslashes, bars, braces, quotes and white space."""
    return s.map(lambda t: None if t is None else re.sub(r'[\\|{}"\s]', "", unicodedata.normalize("NFKD", t)))


#: Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_of(words: str | None) -> str | None:
    """Digits of a number in English words, the text itself if it is none."""
    if words is None:
        return None
    total = now = 0
    parts = re.split(r"[\s-]+", words.strip().lower())
    whole, _, fraction = " ".join(p for p in parts if p != "and").partition(" point ")
    for w in whole.split():
        if w in UNITS:
            now += UNITS.index(w)
        elif w in TENS:
            now += 10 * (TENS.index(w) + 2)
        elif w == "hundred":
            now = max(1, now) * 100
        elif w in ("thousand", "million"):
            total, now = total + max(1, now) * (1000 if w == "thousand" else 1_000_000), 0
        else:
            return words
    if not whole:
        return words
    digits = "".join(str(UNITS.index(w)) if w in UNITS[:10] else "?" for w in fraction.split())
    return words if "?" in digits else f"{total + now}" + (f".{digits}" if digits else "")


@pandas_udf(StringType())
def word2num(s: pd.Series) -> pd.Series:
    return s.map(number_of)


#: Letters that stand for more than one, while endings are taken off.
PAIRS = (("sch", "$"), ("ei", "%"), ("ie", "&"))


def bracketed(c: Column) -> Column:
    """An IRI in angle brackets; brackets that are there already are not doubled."""
    return F.concat(F.when(c.startswith("<"), "").otherwise("<"), c, F.when(c.endswith(">"), "").otherwise(">"))


def with_offset(form: Column, offset: Column) -> Column:
    """The key of a surface form at its place."""
    return F.concat(form, F.lit("__;__"), offset.cast("string"))


def span_faults(text: Column, start: Column, length: Column) -> Column:
    """What is odd about a span of code points, as names: it begins or ends with white space, or cuts a word at its
    front or back. Empty where nothing is; a span beyond the text has only the faults of what is there."""

    def at(place: Column) -> Column:
        return F.when(place >= 0, F.substring(text, place + 1, F.lit(1))).otherwise("")

    faults = {"space_first": at(start).rlike(r"^\s$"), "letter_before": at(start - 1).rlike(r"^\p{L}$"), "space_last": at(start + length - 1).rlike(r"^\s$"), "letter_after": at(start + length).rlike(r"^\p{L}$")}
    return F.array_compact(F.array(*[F.when(c, name) for name, c in faults.items()]))


def german_stem_of(word: str | None) -> str | None:
    """A light German stem: umlauts folded, ß as ss, a leading ge- and inflection endings off. sch, ei and ie count as
    one letter, the second of two equal letters as one of its own. Punctuation goes but for hyphens; points and commas
    outside numbers become spaces."""
    if word is None:
        return None
    w = re.sub(r"(?<!\d)[.,](?!\d)", " ", word.lower())
    w = re.sub(r"[!-+/:-@\[-`{-~]", "", w).translate(str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss"}))
    w = re.sub(r"^ge(.{4,})", r"\1", w)
    for pair, one in PAIRS:
        w = w.replace(pair, one)
    w = re.sub(r"(.)\1", r"\1*", w)
    while len(w) > 3:
        n = len(w)
        if n > 5 and re.search(r"(e[mr]|nd)$", w):
            w = w[:-2]
        elif w[-1] in "tesn":
            w = w[:-1]
        if len(w) == n:
            break
    w = re.sub(r"(.)\*", r"\1\1", w)
    for pair, one in PAIRS:
        w = w.replace(one, pair)
    return w


@pandas_udf(StringType())
def german_stem(s: pd.Series) -> pd.Series:
    return s.map(german_stem_of)
