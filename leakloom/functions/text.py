"""Normalisation and compaction of text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Which characters normalisation drops or maps, and what compaction keeps.
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060\u00ad"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACES = "\t\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
APOSTROPHES = "\u2018\u2019\u2032"
QUOTES = "\u201c\u201d\u2033"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
BULLETS = "\u2022●▪◦\u2023\u2043\u00b7"
KEPT = "가-힣A-Za-z0-9"
#: What Python's strip takes off and the steps before it have left.
STRIPPED = r"[\n \x85\u1680\u2028\u2029]"
#: All white space of Python's \s.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@cache
def _nfc():
    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return nfc


#: Beyond ASCII, texts without these have nothing to compose, drop or map; in ASCII, texts without tabs.
SPECIAL = r"[\t\xa0\xad\xb7\u0300-\x{10ffff}]"


def normalize_text(text: Column) -> Column:
    """Line ends, composition, invisible and control characters, spaces, quotes, dashes and bullets, blank runs.

    The order of the steps is part of the result: composition comes before invisible
    characters go, so a second pass may still change a text. Composition is Python's;
    rows of plain characters send it a null and skip the steps that can't change them.
    """
    raw = F.coalesce(text, F.lit(""))
    special = F.when(F.octet_length(raw) == F.length(raw), F.contains(raw, F.lit("\t"))).otherwise(raw.rlike(SPECIAL))
    lines = F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    source = SPACES + APOSTROPHES + QUOTES + DASHES + BULLETS
    target = " " * len(SPACES) + "'" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * (len(DASHES) + len(BULLETS))
    mapped = F.translate(F.regexp_replace(F.translate(_nfc()(F.when(special, lines)), INVISIBLE, ""), CONTROL, ""), source, target)
    out = F.when(special, mapped).otherwise(F.regexp_replace(lines, CONTROL, ""))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " +\n", "\n"), " {2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"\A{STRIPPED}+|{STRIPPED}+\z", "")


def normalize_for_matching(text: Column) -> Column:
    """The normalised text without any white space."""
    return F.regexp_replace(normalize_text(text), WHITE, "")


def is_normalization_stable(text: Column) -> Column:
    return normalize_text(text) == text


def compact_text(text: Column) -> Column:
    """Hangul syllables, ASCII letters (lowered) and digits of a normalised text."""
    ascii_only = F.octet_length(text) == F.length(text)  # a plain class is several times as fast
    return F.lower(F.when(ascii_only, F.regexp_replace(text, "[^A-Za-z0-9]+", "")).otherwise(F.regexp_replace(text, f"[^{KEPT}]+", "")))


def compact_with_offsets(text: Column) -> Column:
    """array<struct<ch, off>>: the kept characters, lowered, with their places in the text."""
    characters = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("ch"), i.alias("off"))), lambda x: x["ch"].rlike(f"^[{KEPT}]$"))
    return F.transform(characters, lambda x: F.struct(F.lower(x["ch"]).alias("ch"), x["off"].alias("off")))


def window_count(text: Column, window: int) -> Column:
    """How many windows a normalised text has."""
    return F.greatest(F.length(compact_text(text)) - (window - 1), F.lit(0))


def kept_length(text: Column) -> Column:
    """The place after the last kept character; 0 if there is none."""
    return F.length(F.regexp_replace(text, rf"[^{KEPT}]+\z", ""))


def unwrapped_lines(text: Column) -> Column:
    """array<string>: the paragraphs of text that was wrapped into lines, as page extraction gives it.

    A blank line ends a paragraph; a line that ends in a letter and a hyphen joins the
    next without it; a sentence's end, or a list item's start, begins a new paragraph;
    other lines are joined by a space.
    """
    # The ends of sentences, starts of list items and broken characters.
    sentence = ".!?:다요함음됨죠"
    item = r"(?:[-\u2022▪◦\u2023*]|\d+[.)]|[가나다라마][.)]|\([0-9가-힣]+\))[^\S\n]"
    fixed = F.replace(F.replace(F.translate(text, "\u00ad", ""), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    stripped = F.array_join(F.transform(F.split(fixed, "\n"), lambda x: F.regexp_replace(x, rf"\A{WHITE}+|{WHITE}+\z", "")), "\n")
    # What joins two lines hangs on the end of the one and the start of the other alone.
    hyphens = F.regexp_replace(stripped, r"([A-Za-z]-)(?:\n-(?=\n|\z))+", "$1")
    joined = F.regexp_replace(hyphens, r"([A-Za-z])-\n(?=[^\n])", "$1")
    joined = F.regexp_replace(joined, rf"(?<=[^\n{sentence}])\n(?!{item})(?=[^\n])", " ")
    return F.filter(F.split(joined, "\n+"), lambda x: x != "")
