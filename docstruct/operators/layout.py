"""From spans to blocks: validity, normalised text, groups of neighbours, merged blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import normalize, strip
from docstruct.schema import SETTINGS, Settings

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def repair(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """What a decoder leaves open: sizes of one at least, boxes of four numbers or zeros, names and flags, the page cap."""
    b = F.col("bbox")
    whole = b.isNotNull() & b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull()
    zeros = F.struct(*[F.lit(0.0).alias(k) for k in ("x0", "y0", "x1", "y1")])
    return spans.where(F.col("page_number") <= settings.max_pages).withColumns({"font_size": F.greatest(F.coalesce("font_size", F.lit(12.0)), F.lit(1.0)), "bbox": F.when(whole, b).otherwise(zeros), "font_name": F.coalesce("font_name", F.lit("unknown")), "font_flags": F.coalesce("font_flags", F.lit(0))})


def valid_blocks(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Spans of enough text and a positive size."""
    return spans.where((F.length(strip(F.col("text"))) >= max(settings.min_text_length, 1)) & (F.col("font_size") > 0))


def normalized_blocks(spans: DataFrame, compose: bool = True, **options: bool) -> DataFrame:
    return spans.withColumn("text", normalize(F.col("text"), compose, **options)).where("text <> ''")


def reading_order(alias: str = "doc_id"):
    return Window.partitionBy(alias).orderBy("page_number", F.col("bbox.y0"), F.col("bbox.x0"), "seq")


def sorted_blocks(spans: DataFrame) -> DataFrame:
    """``place`` in reading order: page, top, left, then the order of the source."""
    return spans.withColumn("place", F.row_number().over(reading_order()))


def grouped_blocks(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``group_id``: a block joins the group of the block just before it if both look alike and lie close.

    Gaps and islands: a flag where the match with the previous row fails, then its running sum. One exchange and one sort
    by document serve both.
    """
    w = reading_order()
    now = F.struct("page_number", "bbox", "font_size", "font_name", "font_flags")
    was, b = F.col("was"), F.col("bbox")
    p = was["bbox"]
    alike = (was["page_number"] == F.col("page_number")) & (F.abs(F.col("font_size") - was["font_size"]) / F.greatest(F.col("font_size"), was["font_size"]) <= settings.size_tolerance) & (was["font_name"] == F.col("font_name")) & (was["font_flags"] == F.col("font_flags"))
    same_line = F.abs(b["y0"] - p["y0"]) <= settings.line_tolerance
    below = b["y0"] - p["y1"]
    overlap = F.least(b["x1"], p["x1"]) - F.greatest(b["x0"], p["x0"])
    close = F.when(same_line, b["x0"] - p["x1"] <= settings.gap).otherwise(below.between(0.0, settings.line_tolerance) & (overlap > 0))
    rows = spans.withColumn("was", F.lag(now).over(w))
    rows = rows.withColumn("opens", F.when(was.isNull() | ~(alike & close), 1).otherwise(0))
    rows = rows.withColumn("gap", F.when(F.col("opens") == 1, "").when(F.abs(b["y0"] - p["y0"]) <= settings.line_tolerance, " ").otherwise("\n"))
    return rows.withColumn("group_id", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("was", "opens")


def merged_blocks(groups: DataFrame) -> DataFrame:
    """A block for each group: joined text, united box, the first member's font. Clustered by document, so no exchange."""
    first = lambda c: F.min_by(c, F.struct("page_number", "bbox.y0", "bbox.x0", "seq"))
    part = F.struct("page_number", F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), "seq", F.concat("gap", "text").alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda s: s["t"]), "")
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
    return groups.groupBy("doc_id", "group_id").agg(text.alias("text"), F.min("page_number").alias("page_number"), box.alias("bbox"), first("font_size").alias("font_size"), first("font_name").alias("font_name"), first("font_flags").alias("font_flags"), F.count("*").alias("n_spans")).withColumnRenamed("group_id", "seq")


def preprocess(spans: DataFrame, settings: Settings = SETTINGS, compose: bool = True, **options: bool) -> DataFrame:
    """Spans to merged blocks."""
    return merged_blocks(grouped_blocks(normalized_blocks(valid_blocks(spans, settings), compose, **options), settings))
