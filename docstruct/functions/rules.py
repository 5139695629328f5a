"""Heading and header rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstruct.functions.features import is_title, is_upper
from docstruct.functions.text import strip

# Patterns of numbered headings (any case), of numbered headings in other scripts, and of titles.
NUMBERED = (
    r"\d+\.\s+",
    r"\d+\.\d+\s+",
    r"\d+\.\d+\.\d+\s+",
    r"[A-Z][a-z]+\s+\d+",
    r"(?:Chapter|Section|Part|Capítulo|Chapitre|Kapitel|Capitolo|Глава|章节|فصل)\s+\d+",
    r"(?:Appendix|Apéndice|Annexe|Anhang|Appendice|Приложение|附录|ملحق)\s*[A-Z]?",
    r"[IVX]+\.\s+",
    r"[A-Z]\.\s+",
    r"[a-z]\)\s+",
    r"\([a-z]\)\s+",
    r"\([0-9]+\)\s+",
)
NUMBERED_OTHER = (r"第[一二三四五六七八九十\d]+章", r"[一二三四五六七八九十]+、", r"الفصل\s+\d+", r"القسم\s+\d+", r"제\s*\d+\s*장", r"제\s*\d+\s*절")
TITLE_CAPS = r"[A-Z\s\d]+$"
TITLE_MARKS = (
    r"(?:TITLE|SUBJECT|TOPIC|TÍTULO|TITRE|TITEL|TITOLO|ЗАГОЛОВОК|标题|العنوان)[:]\s*",
    r"(?:Abstract|Resumen|Résumé|Zusammenfassung|Riassunto|Аннотация|摘要|الملخص)[:]\s*",
    r"(?:Introduction|Introducción|Einleitung|Introduzione|Введение|介绍|مقدمة)[:]\s*",
    r"(?:Conclusion|Conclusión|Schlussfolgerung|Conclusione|Заключение|结论|خاتمة)[:]\s*",
)
BOLD_FONTS = ("bold", "black", "heavy")
HEADINGS = ("title", "h1", "h2", "h3")


def any_of(patterns: tuple[str, ...], flags: str = "U") -> str:
    return f"(?{flags})^(?:{'|'.join(patterns)})"


def is_numbered(text: Column) -> Column:
    return text.rlike(any_of(NUMBERED, "iU")) | text.rlike(any_of(NUMBERED_OTHER))


def numbering_level(text: Column) -> Column:
    """By the dots of the leading number; h2 without one."""
    number = F.regexp_extract(text, r"(?U)^(\d+(?:\.\d+)*)", 1)
    dots = F.regexp_count(number, F.lit(r"\."))
    return F.when(number == "", F.lit("h2")).when(dots == 0, F.lit("h1")).when(dots == 1, F.lit("h2")).otherwise(F.lit("h3"))


def result(name: Column | str, confidence: float) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("predicted_class"), F.lit(confidence).alias("confidence"))


def classify(text: Column, size_ratio: Column, bold: Column, length: Column) -> Column:
    """``struct<predicted_class, confidence>`` by the rules on text and features."""
    text = strip(text)
    one_line = ~text.contains("\n")
    return (
        F.when(is_numbered(text) & (length > 5) & (length < 100) & one_line, result(numbering_level(text), 0.6))
        .when((size_ratio > 2.0) & bold & (length > 10) & (length < 80) & one_line, result("h1", 0.7))
        .otherwise(result("text", 0.9))
    )


def classify_text_only(text: Column) -> Column:
    """The same from the text alone. In any case, the first title pattern takes any letters, white space and digits."""
    text = strip(text)
    title = text.rlike(any_of((TITLE_CAPS, *TITLE_MARKS), "iU"))
    return F.when(is_numbered(text), result(numbering_level(text), 0.5)).when(title, result("title", 0.6)).when(is_upper(text) & (F.length(text) > 3), result("h1", 0.4)).otherwise(result("text", 0.8))


def is_title_block(text: Column, size_ratio: Column, x: Column, y: Column, length: Column, capitals: Column) -> Column:
    """The title rule, which the cascade does not use."""
    marked = text.rlike(any_of((TITLE_CAPS,))) | text.rlike(any_of(TITLE_MARKS, "iU"))
    return marked | ((size_ratio > 2.2) & (y < 0.15) & (length < 200) & ~is_numbered(text) & ((x < 0.05) | (capitals > 0.7)))


def cascade(text: Column, ruled: Column, model_class: Column, model_confidence: Column, failed: Column, least: float = 0.5) -> Column:
    """A model's answer unless it is unsure or a too certain title; rules otherwise, text alone where the model failed.

    A null model class means that no model is loaded; blank text has no answer.
    """
    unsure = (model_confidence < least) | ((model_confidence >= 0.99) & (model_class == "title"))
    model = F.struct(model_class.alias("predicted_class"), model_confidence.alias("confidence"))
    return F.when(strip(text) != "", F.when(failed, classify_text_only(text)).when(model_class.isNull() | unsure, ruled).otherwise(model))


def is_header(text: Column, size: Column, font: Column, median: Column, factor: float = 1.2) -> Column:
    """Whether a span opens a section."""
    own, font = strip(text), F.lower(F.coalesce(font, F.lit("")))
    bold = F.lit(False)
    for sign in BOLD_FONTS:
        bold = bold | font.contains(sign)
    n, m = F.length(text), F.length(own)
    return (m >= 3) & ((size > median * factor) | (bold & n.between(5, 150)) | own.rlike(r"(?U)^\d+\.?\d*\.?\s+[A-Z]") | (is_upper(own) & m.between(5, 80)) | (is_title(own) & m.between(10, 100)))
