"""From spans to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.rules import is_header
from docstruct.schema import SETTINGS, Settings

INTRODUCTION = "Introduction"


def with_headers(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``median_font_size`` of the document's spans of over three characters, and ``is_header``."""
    median = F.median(F.when(F.length("text") > 3, F.col("font_size"))).over(Window.partitionBy("doc_id"))
    rows = spans.withColumn("median_font_size", F.coalesce(median, F.lit(settings.default_size)))
    return rows.withColumn("is_header", is_header(F.col("text"), F.col("font_size"), F.col("font_name"), F.col("median_font_size"), settings.header_factor))


def sections(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, seq, section_title, content, page_number, median_font_size`` of each section that has content.

    A running count of headers numbers the sections. One exchange by document: the median's window, the running count and
    the aggregate by (document, section) all stand on it.
    """
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = with_headers(spans, settings).withColumn("section", F.count_if("is_header").over(w))
    part = F.collect_list(F.when(~F.col("is_header"), F.struct("seq", "text")))
    found = rows.groupBy("doc_id", "section").agg(F.min("seq").alias("seq"), F.max(F.when(F.col("is_header"), F.col("text"))).alias("title"), F.sort_array(part).alias("parts"), F.min_by("page_number", "seq").alias("page_number"), F.first("median_font_size").alias("median_font_size"))
    content = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    return found.where(F.size("parts") > 0).select("doc_id", "seq", F.coalesce("title", F.lit(INTRODUCTION)).alias("section_title"), content.alias("content"), "page_number", "median_font_size")
