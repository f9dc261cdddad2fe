"""Column expressions for tags, names and missing marks. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------
# Capital and small letters of Cyrillic and Greek that look like the Latin letter below them.
CYRILLIC_LOOKS = "АВЕКМНОРСТУХІЈЅаеорсухіјѕ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXIJSaeopcyxijs"
GREEK_LOOKS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXvo"
INVISIBLE = "​‌‍⁠﻿­"
HYPHENS = "‐‑‒–—―−－"
# White space and separators: of ASCII, the no-break, Ogham, typographic, narrow, mathematical and ideographic spaces, line and paragraph separators.
BLANKS = "\t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DASHES = "-\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
MISSING_WORDS = ["n/a", "н/д", "none", "noans", "{}", "tbd", "hold", "уточняется"]
# --------------------------------------------------------------------------------------------------
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULL_WIDTH_AS_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def squeeze(c: Column) -> Column:
    """White space of any kind as single plain spaces, none at the ends; a pattern is run only where spaces follow each other."""
    plain = F.trim(F.translate(c, BLANKS, " " * len(BLANKS)))
    return F.when(plain.contains("  "), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def is_missing(c: Column) -> Column:
    """True for null, blank text and the signs for no value (dashes, N/A, none, ...)."""
    return c.isNull() | missing_text(squeeze(c))


def missing_text(t: Column) -> Column:
    """is_missing of a text that squeeze has gone over."""
    return (F.translate(t, DASHES, "") == "") | F.lower(t).isin(MISSING_WORDS)


def latin_looks(c: Column) -> Column:
    """Cyrillic and Greek look-alikes as Latin letters, full-width forms as ASCII."""
    return F.translate(c, CYRILLIC_LOOKS + GREEK_LOOKS + FULL_WIDTH, CYRILLIC_AS_LATIN + GREEK_AS_LATIN + FULL_WIDTH_AS_ASCII)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def tag_key(c: Column) -> Column:
    """What all spellings of one tag share: no white space or invisible characters, plain hyphens, Latin capitals, no E- before the number."""
    hyphens = HYPHENS + "_"
    t = F.translate(c, hyphens + INVISIBLE + BLANKS + " ", "-" * len(hyphens))
    known = F.upper(latin_looks(F.upper(latin_looks(t))))
    return let(known, lambda k: F.when(k.startswith("E-") & F.substring(k, 3, 1).between("0", "9"), F.substr(k, F.lit(3))).otherwise(k))


def name_key(c: Column) -> Column:
    """A property name without case, underscores, notes in brackets and the difference of ё and е."""
    t = F.regexp_replace(F.lower(c), r"\([^()]*\)|_", " ")
    return F.translate(squeeze(t), "ё", "е")
