"""Name and address normalisation as Spark expressions; folding and transliteration as Arrow UDFs, as no built-in does them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knotwork.functions import tables as T

BLANK = ""
# What stands for a missing address, names a trade name, is a web address, and is no part of a name at its ends.
NULL_TEXT = r"<\s*null\s*>|\bn/a\b|\bnull\b|\bnone\b"
DBA = r"\b(?:doing business as|d\s*/\s*b\s*/\s*a|d\.b\.a\.?|dba|trading as|t/a|a\.k\.a\.?|aka)\b"
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|in|net|org|co\.in|co|fr|biz|us|info|io)\b"
EDGES = " -<>#*_~|.,;:!?\"'()[]{}="


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str, most: int | None = None) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, the first `most` of them. For these the text is split no further: a blank piece may come first, what is left comes last."""
    if most is None:
        return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda x: x != BLANK)
    return F.slice(F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+", most + 2), lambda x: x != BLANK), 1, most)


def leet(token: Column) -> Column:
    """Two digits at most among four other characters at least stand for letters."""
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    mixed = token.rlike("[0-9]") & token.rlike("[^0-9]")
    return F.when(mixed & (digits <= 2) & (F.length(token) - digits >= 4), F.translate(token, T.LEET_FROM, T.LEET_TO)).otherwise(token)


def core(tokens: Column, extra: tuple[str, ...] = ()) -> Column:
    """Tokens without legal words; all of them if none is left."""
    legal = F.array(*map(F.lit, [*T.LEGAL_WORDS, *extra]))
    kept = F.filter(tokens, lambda t: ~F.array_contains(legal, t))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def without_null_text(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(text)), NULL_TEXT, " ")


def after_dba(text: Column | str) -> Column:
    """What follows the first 'doing business as' or the like, if anything does."""
    low = F.lower(_c(text))
    rest = F.regexp_extract(low, f"(?s)^.*?{DBA}(.*)$", 1)
    return F.when(F.trim(rest) != BLANK, rest).otherwise(low)


def domain_label(text: Column | str) -> Column:
    """The host label of a text that is a web address as a whole, with blanks for hyphens; empty otherwise."""
    low = F.lower(_c(text))
    return F.when(low.contains(" "), BLANK).otherwise(F.replace(F.regexp_extract(low, DOMAIN, 1), F.lit("-"), F.lit(" ")))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGES))


def name_tokens(text: Column | str) -> Column:
    """Junk at the ends off, m/s off, & and + as 'and', abbreviations of two letters or more joined, l' and d' off, apostrophes off, leet undone."""
    s = stripped(after_dba(text))
    s = F.when(domain_label(s) != BLANK, domain_label(s)).otherwise(s)
    s = F.regexp_replace(s, r"\bm\s*/\s*s\b", " ")
    s = F.regexp_replace(s, r"[&+]", " and ")
    # A dot goes where it is one of at least two that each follow a letter.
    s = F.regexp_replace(s, r"(?<=[a-z])\.(?=[a-z]\.)|(?<=[a-z]\.[a-z])\.", "")
    s = F.replace(F.regexp_replace(s, r"\b[ld]'(?=[a-z])", ""), F.lit("'"), F.lit(""))
    return F.transform(words(s), leet)


def has_indic(text: Column | str) -> Column:
    return _c(text).rlike("[\u0900-\u0D7F]")


def is_domain(text: Column | str) -> Column:
    """Whether a text without a blank is a web address or starts with #."""
    s = stripped(after_dba(text))
    return ((domain_label(s) != BLANK) | _c(text).startswith("#")) & ~F.trim(_c(text)).contains(" ")


def latin(text: Column | str) -> Column:
    """Indic letters as Latin ones, letters without marks; one call into Python."""
    return to_latin(_c(text))


def french_area(text: Column | str) -> Column:
    """An address whose comma-separated parts that are a region or department as a whole stand as the region's code."""
    area = _map(T.FR_AREAS)
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.array_join(F.transform(F.split(_c(text), ","), lambda c: F.coalesce(F.element_at(area, key(c)), c)), ",")


def french_address_tokens(tokens: Column) -> Column:
    """French address words in short form, without apartment marks."""
    short = _map(T.ADDRESS_WORDS_FR)
    return F.filter(F.transform(tokens, lambda t: F.coalesce(F.element_at(short, t), t)), lambda t: t != "apt")


def french_name_tokens(text: Column | str) -> Column:
    """name_tokens after abbreviations were joined whether or not they end with a dot."""
    joined = F.regexp_replace(F.lower(_c(text)), r"(?<=\b[a-z])\.(?=[a-z]\b)|(?<=\b[a-z]\.[a-z])\.", "")
    return name_tokens(joined)


# Words that a regex-only clean name leaves out.
SUFFIXES = "inc incorporated llc corp corporation ltd limited pvt private gmbh sarl sa co company enterprises enterprise services service group holdings holding tech technologies technology intl international solutions solution traders trading store stores mart center centre p v t".split()


def plain_name(text: Column | str) -> Column:
    """Lower case, & and + as 'and', all but letters, digits, _ and blanks off, single blanks."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[&+]", " and "), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def without_suffixes(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"\b(?:{'|'.join(SUFFIXES)})\b", ""), r"\s+", " "))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _several(d: dict[str, str]) -> list[tuple[str, str]]:
    return [(k, v) for k, v in d.items() if " " in k]


def address_tokens(text: Column | str) -> Column:
    """Numbers without leading zeros, their suffixes apart, states and address words in short form, filler words off."""
    s = F.regexp_replace(F.regexp_replace(without_null_text(text), "&", " and "), "[^a-z0-9]+", " ")
    s = F.concat(F.lit(" "), s, F.lit(" "))
    several = [*_several(T.US_STATES), *_several(T.IN_STATES)]
    shortened = lambda s: reduce(lambda s, x: F.regexp_replace(s, rf"\b{x[0]}\b", x[1]), several, s)
    s = _once(s, lambda s: F.when(s.rlike(rf"\b(?:{'|'.join(full for full, _ in several)})\b"), shortened(s)).otherwise(s))
    tokens = F.filter(F.split(s, " +"), lambda t: t != BLANK)
    us, india, short = _map(T.US_STATES), _map(T.IN_STATES), _map(T.ADDRESS_WORDS)
    filler = F.array(*map(F.lit, T.ADDRESS_FILLER))

    mapped = lambda by: lambda w: F.coalesce(F.element_at(by, w), w)

    def word(t: Column) -> Column:
        w = reduce(_once, map(mapped, (us, india, short)), leet(t))
        return _once(w, lambda w: F.when(F.array_contains(filler, w), F.array().cast("array<string>")).otherwise(F.array(w)))

    def number(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_extract(t, "^([0-9]+)[a-z]{0,3}$", 1), "^0+(?=[0-9])", "")
        suffix = F.regexp_extract(t, "^[0-9]+([a-z]{0,3})$", 1)
        return F.when(suffix.isin("", "st", "nd", "rd", "th"), F.array(plain)).otherwise(F.array(plain, suffix))

    one = lambda t: F.when(t.rlike("^[0-9]+[a-z]{0,3}$"), number(t)).otherwise(word(t))
    return F.flatten(F.transform(tokens, one))


def numbers(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))


def fold_text(text: str) -> str:
    """Letters without marks; what Unicode can't take apart by the table of fixed values."""
    out = unicodedata.normalize("NFKD", "".join(T.FOLDED.get(c, c) for c in text))
    return "".join(c for c in out if not unicodedata.combining(c))


def transliterate_text(text: str) -> str:
    """Indic letters to Latin ones. A consonant carries an a unless a vowel sign, a virama or the word's end takes it away; a word of one letter keeps it."""
    out: list[str] = []
    for run in re.split("([ऀ-ൿ]+)", text):
        if not run or not "ऀ" <= run[0] <= "ൿ":
            out.append(run)
            continue
        bare = False  # whether the last consonant still has its own vowel to come
        for ch in run:
            at = ord(ch) & 0x7F
            sound, takes_vowel = "", True
            if at in T.INDIC_CONSONANTS:
                sound = T.INDIC_CONSONANTS[at]
            elif at in T.INDIC_SIGNS:
                sound, takes_vowel = T.INDIC_SIGNS[at], False
            elif at == 0x4D:
                takes_vowel = False
            elif ord(ch) >= 0x0D7A:
                sound = T.MALAYALAM_CHILLU[at]
            elif at in T.INDIC_VOWELS or at in T.INDIC_NASALS:
                sound = T.INDIC_VOWELS.get(at) or T.INDIC_NASALS[at]
            elif 0x66 <= at <= 0x6F:
                sound = str(at - 0x66)
            elif at in (0x64, 0x65):
                sound = " "
            else:
                continue
            if bare and takes_vowel:
                out.append("a")
            out.append(sound)
            bare = at in T.INDIC_CONSONANTS
        if bare and len(run) == 1:
            out.append("a")
    return "".join(out)


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold_text(t))


@F.pandas_udf(StringType())
def transliterate(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else transliterate_text(t))


@F.pandas_udf(StringType())
def to_latin(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else fold_text(transliterate_text(t)))
