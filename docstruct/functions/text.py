"""Text normalisation as Columns.

White space is what Python's ``str.isspace`` holds, as a plain character class: Java's Unicode flag costs far more.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of white space.
WS_CHARS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Characters that become a plain space, that go, and quotation marks with their ASCII forms.
SPACES = "              　"
GONE = "﻿‎‏‪‫‬‭‮­​‌‍"
DOUBLE_QUOTES, SINGLE_QUOTES = "“”„", "‘’‚"
BULLETS = "•·▪▫◦‣⁃"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def let(c: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def where(c: Column, holds, then) -> Column:
    """``then`` of the values for which the cheap test ``holds``; others as they are."""
    return let(c, lambda x: F.when(holds(x), then(x)).otherwise(x))


def collapse(c: Column) -> Column:
    """Each run of white space a plain space, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """The words between white space; none for a text without any."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def nfc(c: Column) -> Column:
    """Unicode normal form C by the ICU library that Spark itself brings: no Python worker holds the texts.

    What lies below the first combining character is in that form already. Spark takes a call by reflection as not
    deterministic, so that a later filter on its result does not run it twice.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\u02ff]"), composed).otherwise(c)


def _characters(c: Column) -> Column:
    src = SPACES + DOUBLE_QUOTES + SINGLE_QUOTES + GONE
    to = " " * len(SPACES) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES)
    return where(c, lambda x: x.rlike(r"[\xa0\xad\u2000-\u206f\u3000\ufeff]"), lambda x: F.translate(x, src, to))


def normalize_unicode(c: Column, compose: bool = True) -> Column:
    return _characters(nfc(c) if compose else c)


def normalize_encoding(c: Column, compose: bool = True) -> Column:
    """As :func:`normalize_unicode`, then white space collapsed; null is empty."""
    return F.coalesce(collapse(normalize_unicode(c, compose)), F.lit(""))


def decode(data: Column) -> Column:
    """Bytes as UTF-8, else as Latin-1, which takes any bytes."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


def normalize_whitespace(c: Column) -> Column:
    """Runs of spaces, then tabs, then blank lines, then single line ends, in this order."""
    c = where(c, lambda x: x.contains("  "), lambda x: F.regexp_replace(x, "  +", " "))
    c = where(c, lambda x: x.contains("\t"), lambda x: F.replace(x, F.lit("\t"), F.lit(" ")))
    return where(c, lambda x: x.contains("\n"), lambda x: F.regexp_replace(F.regexp_replace(x, rf"\n{WS}*\n+", "\n\n"), r"(?<!\n)\n(?!\n)", " "))


def clean(c: Column) -> Column:
    """Control characters go, repeated punctuation is cut down, quotation marks become ASCII."""
    c = F.regexp_replace(c, r"[\p{C}&&[^\n\t]]+", "")
    c = where(c, lambda x: x.rlike("[.!?]{3}"), lambda x: F.regexp_replace(x, r"([.!?]){3,}", "$1$1$1"))
    c = where(c, lambda x: x.rlike("[,-]{2}"), lambda x: F.regexp_replace(x, r"([,-]){2,}", "$1"))
    quotes = DOUBLE_QUOTES + SINGLE_QUOTES
    return where(c, lambda x: x.rlike(r"[\u2018-\u201f]"), lambda x: F.translate(x, quotes, '"""' + "'''"))


def special_cases(c: Column) -> Column:
    """Bullets become one bullet, and list numbers ``n.`` or ``n)`` become ``n. ``; lines end at ``\\n`` alone."""
    c = where(c, lambda x: x.rlike(r"[\xb7\u2022-\u25e6]"), lambda x: F.regexp_replace(x, rf"(?md)(^|{WS})[{BULLETS}]{WS}*", "$1• "))
    return F.regexp_replace(c, rf"(?md)^(\p{{Nd}}+)[.)]{WS}*", "$1. ")


def normalize(c: Column, compose: bool = True, keep_multilevel_numbering: bool = False) -> Column:
    """The whole cascade; null is empty. Multi-level numbers lose their form unless they are to be kept."""
    c = clean(normalize_whitespace(normalize_unicode(c, compose)))
    if keep_multilevel_numbering:
        done = let(c, lambda x: F.when(x.rlike(r"(?md)^\p{Nd}+\.\p{Nd}"), F.regexp_replace(x, rf"(?md)(^|{WS})[{BULLETS}]{WS}*", "$1• ")).otherwise(special_cases(x)))
    else:
        done = special_cases(c)
    return F.coalesce(strip(done), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sentences(c: Column, most: int | None = None) -> Column:
    """Sentences of over ten characters, each with an end mark; split before an ASCII capital, where the marks go."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"[.!?]+{WS}+(?=[A-Z])"), strip)
    parts = F.transform(F.filter(parts, lambda s: F.length(s) > 10), lambda s: F.when(s.rlike(r"[.!?]\z"), s).otherwise(F.concat(s, F.lit("."))))
    return F.slice(parts, 1, most) if most else parts


def query_text(role: Column, task: Column, most: int = 1000) -> Column:
    """Null where neither says anything."""
    both = strip(F.concat(F.coalesce(role, F.lit("")), F.lit(" "), F.coalesce(task, F.lit(""))))
    return F.when(both != "", F.substring(both, 1, most))


def section_text(title: Column, content: Column, most: int = 5000) -> Column:
    text = F.concat(title, F.lit(". "), content)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
