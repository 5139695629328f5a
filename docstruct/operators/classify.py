"""Features of blocks and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions import features as f
from docstruct.functions.rules import cascade, classify
from docstruct.functions.text import strip
from docstruct.schema import SETTINGS, Settings


def with_statistics(blocks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Document and page statistics beside each block: window aggregates, so that one exchange by document serves all."""
    d, p = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_number")
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    or_default = lambda c: F.coalesce(c, F.lit(settings.default_size))
    rows = blocks.withColumns({"avg_size": or_default(F.avg(size).over(d)), "least_size": or_default(F.min(size).over(d)), "most_size": or_default(F.max(size).over(d))})
    rows = rows.withColumns({"left": F.min("bbox.x0").over(p), "top": F.min("bbox.y0").over(p), "right": F.greatest(F.max("bbox.x1").over(p), F.lit(0.0)), "bottom": F.greatest(F.max("bbox.y1").over(p), F.lit(0.0))})
    return rows.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")}).drop("right", "bottom")


def font_features() -> dict[str, Column]:
    size, italic, bold = F.col("font_size"), f.is_italic(F.col("font_flags")), f.is_bold(F.col("font_flags"))
    ratio = f.font_size_ratio(size, F.col("avg_size"))
    return {"font_size_ratio": ratio, "is_bold": bold, "is_italic": italic, "relative_font_size": f.relative_font_size(size, F.col("least_size"), F.col("most_size")), "font_weight_score": f.font_weight_score(ratio, bold), "font_style_score": f.font_style_score(F.col("font_name"), italic)}


def position_features() -> dict[str, Column]:
    nx, ny = f.normalized(F.col("bbox.x0"), F.col("left"), F.col("width")), f.normalized(F.col("bbox.y0"), F.col("top"), F.col("height"))
    return {"position_x": nx, "position_y": ny, "page_position_score": f.page_position_score(nx, ny), "alignment_score": f.alignment_score(nx), "whitespace_above": f.whitespace_above(F.col("bbox.y0"), F.col("top"), F.col("height")), "whitespace_below": f.whitespace_below(F.col("bbox.y1"), F.col("top"), F.col("height")), "indentation_level": nx}


def content_features() -> dict[str, Column]:
    t = F.coalesce(strip(F.col("text")), F.lit(""))
    return {"text_length": F.length(t), "word_count": f.word_count(t), "sentence_count": f.sentence_count(t), "capitalization_score": f.capitalization(t), "whitespace_ratio": f.whitespace_ratio(t), "punctuation_density": f.punctuation_density(t), "numeric_content_ratio": f.numeric_ratio(t), "special_char_ratio": f.special_ratio(t), "title_case_score": f.title_case_score(t), "all_caps_score": f.all_caps_score(t)}


def basic_features(blocks: DataFrame) -> DataFrame:
    """The features that preprocessing attaches: size over the document's average, raw position, letters of all scripts."""
    avg = F.coalesce(F.avg(F.when(F.col("font_size") > 0, F.col("font_size"))).over(Window.partitionBy("doc_id")), F.lit(12.0))
    t = F.col("text")
    own = F.struct(f.font_size_ratio(F.col("font_size"), avg).alias("font_size_ratio"), f.is_bold(F.col("font_flags")).alias("is_bold"), f.is_italic(F.col("font_flags")).alias("is_italic"), F.col("bbox.x0").alias("position_x"), F.col("bbox.y0").alias("position_y"), F.length(t).alias("text_length"), f.capitalization_basic(t).alias("capitalization_score"), f.whitespace_ratio(t).alias("whitespace_ratio"))
    return blocks.withColumn("features", own)


#: What the rules and the outline read of the features.
RULE_FEATURES = ("font_size_ratio", "is_bold", "position_y", "text_length")
#: What the title rule and the hints read.
TITLE_FEATURES = ("font_size_ratio", "position_x", "position_y", "text_length", "capitalization_score")
HINT_FEATURES = ("font_size_ratio", "is_bold", "is_italic", "position_y", "text_length", "capitalization_score")


def with_features(blocks: DataFrame, settings: Settings = SETTINGS, names: tuple[str, ...] | None = None) -> DataFrame:
    """The features in one struct: all, or those of ``names`` where only some are worth their cost."""
    every = font_features() | position_features() | content_features()
    rows = with_statistics(blocks, settings)
    return rows.withColumn("features", F.struct(*[c.alias(k) for k, c in every.items() if names is None or k in names])).drop("avg_size", "least_size", "most_size", "left", "top", "width", "height")


def fallback_features(text: Column) -> Column:
    """What a block has whose features failed."""
    return F.struct(F.lit(1.0).alias("font_size_ratio"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_italic"), F.lit(0.0).alias("position_x"), F.lit(0.0).alias("position_y"), F.length(F.coalesce(text, F.lit(""))).alias("text_length"), F.lit(0.0).alias("capitalization_score"), F.lit(0.0).alias("whitespace_ratio"))


def classified(blocks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Blocks of :func:`with_features` with ``predicted_class`` and ``confidence``.

    Model columns ``model_class``, ``model_confidence`` and ``model_failed`` take part where the table has them.
    """
    g = F.col("features")
    ruled = classify(F.col("text"), g["font_size_ratio"], g["is_bold"], g["text_length"])
    if "model_class" in blocks.columns:
        ruled = cascade(F.col("text"), ruled, F.col("model_class"), F.col("model_confidence"), F.coalesce("model_failed", F.lit(False)), settings.confidence)
    return blocks.withColumn("r", ruled).select("*", "r.predicted_class", "r.confidence").drop("r")
