"""Features of a block as Columns. A ratio whose base is not positive has the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstruct.functions.text import WS_CHARS, let, strip, words

UPPER, LOWER, CASED, LETTER = r"[\p{Lu}\p{IsUppercase}]", r"[\p{Ll}\p{IsLowercase}]", r"[\p{Lu}\p{Ll}\p{Lt}]", r"\p{L}"
# Words that stay lower-case in titles, and signs of a heading in font names.
SMALL_WORDS = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
FONT_SIGNS = ("heading", "title", "header", "bold", "black", "heavy")
PUNCTUATION = r".,;:!?()\[\]{}\"'\-"


def ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(default))


# ASCII without white space, without digits and without capitals: what a regular expression passes over quickest.
NO_BLANK, NO_DIGIT, NO_CAPITAL = "!-~", r"\x00-/:-\x7f", r"\x00-@\[-\x7f"


def rare(c: Column, members: str, never: str | None = None) -> Column:
    """Number of characters of a class that few are of: the length without runs of others.

    ``never`` are characters out of the class that go first, so that the class is asked of few.
    """
    if never:
        c = F.regexp_replace(c, f"[{never}]+", "")
    return F.length(F.regexp_replace(c, f"[^{members}]+", ""))


def unspaced(c: Column) -> Column:
    """A text without plain spaces, whose letters stand in longer runs."""
    return F.replace(c, F.lit(" "), F.lit(""))


def other_blanks(c: Column) -> Column:
    """Number of white space characters that are no plain spaces."""
    return rare(unspaced(c), WS_CHARS, NO_BLANK)


def common(c: Column, members: str) -> Column:
    """The same for a class that most are of: what its runs leave is not of it."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{members}]+", ""))


def share(c: Column, members: str) -> Column:
    """Characters of a class, of all."""
    return ratio(rare(c, members).cast("double"), F.length(c))


def is_upper(c: Column) -> Column:
    return c.rlike(UPPER) & ~c.rlike(r"[\p{Ll}\p{IsLowercase}\p{Lt}]")


def is_title(c: Column) -> Column:
    """Upper case after what has no case, lower case after what has, and one letter with case at least."""
    return c.rlike(CASED) & ~c.rlike(CASED + r"[\p{Lu}\p{Lt}]") & ~c.rlike(r"(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def is_bold(flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(16) != 0, F.lit(False))


def is_italic(flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(2) != 0, F.lit(False))


def font_size_ratio(size: Column, average: Column) -> Column:
    return ratio(size, average, 1.0)


def relative_font_size(size: Column, least: Column, most: Column) -> Column:
    return F.when(most > least, (size - least) / (most - least)).otherwise(F.lit(0.5))


def font_weight_score(of_average: Column, bold: Column) -> Column:
    return F.least(F.when(bold, of_average * 1.5).otherwise(of_average), F.lit(3.0))


def font_style_score(name: Column, italic: Column) -> Column:
    signs = sum((F.lower(name).contains(s).cast("int") for s in FONT_SIGNS), F.lit(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), signs * F.lit(0.3) - F.when(italic, F.lit(0.1)).otherwise(F.lit(0.0))))


def normalized(at: Column, margin: Column, extent: Column) -> Column:
    return F.when(extent > 0, (at - margin) / extent).otherwise(F.lit(0.0))


def page_position_score(nx: Column, ny: Column) -> Column:
    return (1 - ny) * 0.7 + (1 - F.abs(nx)) * 0.3


def alignment_score(nx: Column) -> Column:
    return F.greatest(1 - F.least(nx, F.lit(1.0)), (1 - F.abs(nx - 0.5) * 2) * 0.8)


def whitespace_above(y0: Column, top: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), normalized(y0, top, height))


def whitespace_below(y1: Column, top: Column, height: Column) -> Column:
    return F.when(height > 0, F.greatest(F.lit(0.0), 1 - (y1 - top) / height)).otherwise(F.lit(0.0))


def capitalization(c: Column) -> Column:
    """Upper-case letters of those that have case."""
    return ratio(rare(c, r"\p{Lu}", NO_CAPITAL).cast("double"), common(unspaced(c), r"a-zA-Z\p{Lu}\p{Ll}\p{Lt}"))


def capitalization_basic(c: Column) -> Column:
    """Upper-case letters of all letters, those without case too."""
    return ratio(rare(c, r"\p{Lu}", NO_CAPITAL).cast("double"), common(unspaced(c), r"a-zA-Z\p{L}"))


def whitespace_ratio(c: Column) -> Column:
    return ratio((F.length(c) - F.length(unspaced(c)) + other_blanks(c)).cast("double"), F.length(c))


def punctuation_density(c: Column) -> Column:
    return share(c, PUNCTUATION)


def numeric_ratio(c: Column) -> Column:
    return ratio(rare(c, r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨", NO_DIGIT).cast("double"), F.length(c))


def special_ratio(c: Column) -> Column:
    return ratio((F.length(c) - common(c, r"\p{L}\p{N}" + WS_CHARS)).cast("double"), F.length(c))


def word_count(c: Column) -> Column:
    """Words between white space; counted by spaces where each stands alone and no other white space is there."""
    t = strip(c)
    plain = (other_blanks(t) == 0) & ~t.contains("  ")
    return F.when(t == "", F.lit(0)).when(plain, F.length(t) - F.length(unspaced(t)) + 1).otherwise(F.size(words(t)))


def sentence_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[.!?]+"))


# Patterns of words in a text of :func:`_spaced`, each after the space before its word: a look behind at every place costs far more.
_TEXT, _END = "[^ ]", "(?![^ ])"
_INSIDE = r"[^\p{L}\p{N}_ ]*+"
_SMALL = "(?:" + "|".join(_INSIDE + _INSIDE.join(f"[{x}{x.upper()}]" for x in w) + _INSIDE for w in SMALL_WORDS) + ")" + _END
_HEADS = "".join(sorted({w[0] for w in SMALL_WORDS}))
_BIG = rf"\p{{Lu}}{_TEXT}*?[\p{{Ll}}\p{{Lt}}]"
_BELOW = r"\p{Ll}\p{IsLowercase}\p{Lt}"


def _spaced(c: Column) -> Column:
    """A space before, and plain spaces for other white space."""
    return F.concat(F.lit(" "), F.when(other_blanks(c) > 0, F.regexp_replace(c, f"[{WS_CHARS}]", " ")).otherwise(c))


def count_words(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(" " + pattern))


def title_case_score(c: Column) -> Column:
    """Share of words as titles have them; 0 where each word of letters alone is in capitals, or there is none such.

    A first or other large word counts if it starts upper-case and is not all upper; a small word if it starts lower-case.
    """

    def score(x: Column) -> Column:
        mixed = x.rlike(rf" (?:(?:(?![\p{{Ll}}\p{{Lt}}])\p{{L}})*+[\p{{Ll}}\p{{Lt}}]\p{{L}}*+|[\p{{Lo}}\p{{Lm}}]++){_END}")
        later = F.regexp_replace(x, "^ *[^ ]+", "")
        hits = count_words(x, _BIG) - count_words(later, rf"(?=[{_HEADS.upper()}])(?={_SMALL}){_BIG}") + count_words(later, rf"(?=[{_HEADS}]){_SMALL}")
        return F.when(~mixed, F.lit(0.0)).otherwise(hits.cast("double") / count_words(x, _TEXT))

    return let(_spaced(c), score)


def all_caps_score(c: Column) -> Column:
    """Share of words of over one character that are all upper-case."""
    return let(_spaced(c), lambda x: ratio(count_words(x, rf"(?=[^{_BELOW} ]{{2,}}+{_END})[^\p{{Lu}}\p{{IsUppercase}} ]*+[\p{{Lu}}\p{{IsUppercase}}]").cast("double"), count_words(x, _TEXT)))


def hints(text: Column, size_ratio: Column, bold: Column, italic: Column, y: Column, capitals: Column, length: Column) -> Column:
    """The text behind its feature hints."""
    signs = [(size_ratio > 1.5, "[LARGE_FONT]"), (bold, "[BOLD]"), (italic, "[ITALIC]"), (y < 0.2, "[TOP_POSITION]"), (capitals > 0.8, "[ALL_CAPS]"), (length < 50, "[SHORT_TEXT]")]
    return F.concat_ws(" ", *[F.when(c, F.lit(s)) for c, s in signs], text)
