"""Text functions on fixture cases, and against plain Python."""

import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docstruct.functions import features as f
from docstruct.functions import rules, text
from tests.conftest import SMALL

NORMALIZED = [
    ("  Hello   World  ", "Hello World"), ("Line 1\nLine 2\n\nParagraph 2", "Line 1 Line 2\n\nParagraph 2"), ("Hello!!!!! World???", "Hello!!! World???"), ("Hello,, World--", "Hello, World-"),
    ("“Hello” ‘World’", "\"Hello\" 'World'"), ("1) First item", "1. First item"), ("1.1 Overview", "1. 1 Overview"), (None, ""), ("", ""), ("   ", ""), ("Text with various spaces", "Text with various spaces"),
    ("RTL‪embedding‬test", "RTLembeddingtest"), ("é", "é"), ("▪ point", "• point"), ("a\x07b", "ab"),
]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, [a for a, _ in NORMALIZED], text.normalize) == [b for _, b in NORMALIZED]
    assert column(spark, ["Text   various spaces", None], text.normalize_encoding) == ["Text various spaces", ""]
    assert column(spark, ["1.1 Overview", "2) x"], lambda c: text.normalize(c, keep_multilevel_numbering=True)) == ["1.1 Overview", "2. x"]


def test_decode(spark):
    rows = spark.createDataFrame([(b"\xc3\xa9",), (b"\xe9",)], "b binary")
    assert [r.v for r in rows.select(text.decode(F.col("b")).alias("v")).collect()] == ["é", "é"]


def plain_white(t):
    t = re.sub(r" +", " ", t).replace("\t", " ")
    t = re.sub(r"\n\s*\n+", "\n\n", t)
    return re.sub(r"(?<!\n)\n(?!\n)", " ", t)


def plain_clean(t):
    t = "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\t")
    return re.sub(r"([,-]){2,}", r"\1", re.sub(r"([.!?]){3,}", r"\1\1\1", t))


def plain_special(t):
    t = re.sub(r"(^|\s)[•·▪▫◦‣⁃]\s*", r"\1• ", t, flags=re.M)
    return re.sub(r"^(\d+)[.)]\s*", r"\1. ", t, flags=re.M)


TEXTS = st.lists(st.text(alphabet="aB1 \n\t.,-!?)•▪É\x1c\x85 ", max_size=40), min_size=1, max_size=20)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_against_python(spark, values):
    assert column(spark, values, text.normalize_whitespace) == [plain_white(v) for v in values]
    assert column(spark, values, text.clean) == [plain_clean(v) for v in values]
    assert column(spark, values, text.special_cases) == [plain_special(v) for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.words) == [v.split() for v in values]


def test_lines_end_at_newlines_alone(spark):
    """Java's multi-line mode also starts lines after carriage returns and U+0085, U+2028, U+2029, unless it is told not to."""
    values = ["•\x85•", "•\x85\x85•", "a\r1) b", "a\x851.b", "a\u20281) b", "a\u20292.b", "a\r\n1) b", "a\n1) b\n•c"]
    assert column(spark, values, text.special_cases) == [plain_special(v) for v in values]
    kept = column(spark, ["2) x\u20281.1 y", "1.1 y"], lambda c: text.normalize(c, keep_multilevel_numbering=True))
    assert kept == ["2. x\u20281.1 y", "1.1 y"]


def plain_sentences(t):
    out = []
    for s in re.split(r"[.!?]+\s+(?=[A-Z])", t):
        s = s.strip()
        if len(s) > 10:
            out.append(s if s.endswith((".", "!", "?")) else s + ".")
    return out


def test_sentences(spark):
    values = ["Hi there all! Xylophones are here. short. And the end", "", "No split here. lower case goes on", "One sentence of text?!  Écarté stays. Z"]
    assert column(spark, values, text.sentences) == [plain_sentences(v) for v in values]


def plain_title_score(t):
    words = t.split()
    if not words or all(w.isupper() for w in words if w.isalpha()):
        return 0.0
    n = 0
    for i, w in enumerate(words):
        if i == 0 or re.sub(r"[^\w]", "", w.lower()) not in f.SMALL_WORDS:
            n += w[0].isupper() and not w.isupper()
        else:
            n += w[0].islower()
    return n / len(words)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["the", "The", "THE", "of", "A", "a", "Word", "wORD", "WORD", "(the)", "t-he", "1st", "É", "Éa", "x", "...", "B2"]), max_size=7).map(" ".join), min_size=1, max_size=30))
def test_case_scores(spark, values):
    assert column(spark, values, f.title_case_score) == [plain_title_score(v) for v in values]
    assert column(spark, values, f.all_caps_score) == [sum(w.isupper() and len(w) > 1 for w in v.split()) / len(v.split()) if v.split() else 0.0 for v in values]
    assert column(spark, values, f.is_title) == [v.istitle() for v in values]
    assert column(spark, values, f.is_upper) == [v.isupper() for v in values]


def test_feature_cases(spark):
    assert column(spark, ["hello world", "HELLO WORLD", "Hello World", "123 456", "FRANÇAIS AVEC 中文"], f.capitalization) == [0, 1, 0.2, 0, 1]
    assert column(spark, ["This Is Title Case", "THIS IS ALL CAPS"], f.title_case_score) == [1.0, 0.0]
    assert column(spark, ["First sentence. Second sentence! Third sentence?"], f.sentence_count) == [3]
    assert column(spark, ["NoSpaces", "   ", ""], f.whitespace_ratio) == [0, 1, 0]
    style = lambda c: f.font_style_score(c, c == "Arial")
    assert column(spark, ["Arial-Bold", "Arial", "Times"], style) == [0.3, 0.0, 0.0]
    weight = lambda r, b: f.font_weight_score(F.lit(r), F.lit(b))
    assert spark.range(1).select(weight(1.0, False), weight(1.0, True), weight(2.0, True)).first() == (1.0, 1.5, 3.0)


HEADINGS = {"1. Introduction": (True, "h1"), "1.1 Overview": (True, "h2"), "1.1.1 Details": (True, "h3"), "2.3.4.5 Deep nesting": (False, "h3"), "1 Introduction": (False, "h1"), "Chapter 1": (True, "h2"), "Capítulo 1": (True, "h2"), "Глава 1": (True, "h2"), "第一章": (True, "h2"), "الفصل 1": (True, "h2"), "제 1 장": (True, "h2"), "I. Introduction": (True, "h2"), "A. First Section": (True, "h2"), "(a) Sub item": (True, "h2"), "a) x": (True, "h2"), "(1) First item": (True, "h2"), "Regular text": (False, "h2"), "This is a sentence.": (False, "h2"), "глава 2": (True, "h2"), "page 3": (True, "h2")}


def test_headings(spark):
    assert column(spark, list(HEADINGS), rules.is_numbered) == [a for a, _ in HEADINGS.values()]
    assert column(spark, list(HEADINGS), rules.numbering_level) == [b for _, b in HEADINGS.values()]


def test_text_only(spark):
    got = column(spark, ["1. Start", "Abstract: x", "just words", "Words, and more.", "CAPS, YES"], rules.classify_text_only)
    assert [tuple(r) for r in got] == [("h1", 0.5), ("title", 0.6), ("title", 0.6), ("text", 0.8), ("h1", 0.4)]


def test_paths_and_cuts(spark):
    assert column(spark, ["/a/b.c.pdf", "x.pdf", "y"], text.stem) == ["b.c", "x", "y"]
    assert column(spark, ["/a/b.pdf", "x"], text.basename) == ["b.pdf", "x"]
    assert column(spark, ["  ", "a", None], lambda c: text.query_text(c, F.lit(" "))) == [None, "a", None]
    assert column(spark, ["abc"], lambda c: text.section_text(c, F.lit("defgh"), 7)) == ["abc. de..."]


def test_words_and_blanks_are_counted_alike_by_both_ways(spark):
    texts = ["", " ", "one", "a b c", "a  b", " a b ", "a\tb", "a \n b", "\u2003é\u00a0b", "Ünï 1२ ²b", "a\x85b\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", f.word_count(F.col("t")), f.whitespace_ratio(F.col("t"))).collect()}
    assert got == {t: (len(t.split()), pytest.approx(sum(c.isspace() for c in t) / len(t) if t else 0.0)) for t in texts}


def test_case_scores_take_linear_time(spark):
    """A long word of letters before a comma, in which a search for a lower-case letter could start over at each place."""
    column(spark, ["Warm up"], f.title_case_score)
    began = time.monotonic()
    assert column(spark, ["a" * 200_000 + ","], f.title_case_score) == [0.0]
    assert time.monotonic() - began < 5


def test_normal_form_c_without_python(spark):
    values = [chr(c) + m for c in (*range(0x20, 0x250), 0x41F, 0x915, 0x1100, 0x3046) for m in ("", "́", "̣̇", "̈́", "़", "ᅡ", "゙")] + ["Å", "ﬁ", "\U0001d15e", "", None]
    assert column(spark, values, text.nfc) == [v and unicodedata.normalize("NFC", v) for v in values]
    df = spark.createDataFrame([("é",)], "t string").select(text.nfc(F.col("t")).alias("t")).where("t > ''")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_encoding_is_normalised_without_python(spark):
    from docstruct.plans.queries import QUERIES

    assert "Python" not in QUERIES["txt_collapse_ws"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
