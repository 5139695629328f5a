"""Statistics of documents, pages and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.schema import SETTINGS, Settings


def upper_median(size: Column) -> Column:
    """The middle of the sorted positive sizes, the upper one of two."""
    held = F.sort_array(F.collect_list(F.when(size > 0, size)))
    return F.get(held, F.floor(F.size(held) / 2).cast("int"))


def doc_font_stats(blocks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """A row for each document, from a partial aggregate."""
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    or_default = lambda c: F.coalesce(c, F.lit(settings.default_size))
    return blocks.groupBy("doc_id").agg(or_default(F.avg(size)).alias("avg_font_size"), or_default(F.max(size)).alias("max_font_size"), or_default(F.min(size)).alias("min_font_size"), or_default(upper_median(F.col("font_size"))).alias("median_font_size"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("std_font_size"), F.count("*").alias("total_blocks"), F.max("page_number").alias("total_pages"))


def top_fonts(blocks: DataFrame, most: int = 5) -> DataFrame:
    """``doc_id, rank, font_name, n``: the most common fonts, first seen first among equals."""
    counts = blocks.groupBy("doc_id", "font_name").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "seen"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "font_name", "n")


def page_extents(blocks: DataFrame) -> DataFrame:
    """Width, height and margins of the text of each page; the right and lower ends are 0 at least."""
    rows = blocks.groupBy("doc_id", "page_number").agg(F.min("bbox.x0").alias("left_margin"), F.min("bbox.y0").alias("top_margin"), F.greatest(F.max("bbox.x1"), F.lit(0.0)).alias("x1"), F.greatest(F.max("bbox.y1"), F.lit(0.0)).alias("y1"))
    return rows.select("doc_id", "page_number", (F.col("x1") - F.col("left_margin")).alias("width"), (F.col("y1") - F.col("top_margin")).alias("height"), "left_margin", "top_margin")


def true_median(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The median size of spans of over three characters."""
    return spans.groupBy("doc_id").agg(F.coalesce(F.median(F.when(F.length("text") > 3, F.col("font_size"))), F.lit(settings.default_size)).alias("median_font_size"))


def level_counts(headings: DataFrame) -> DataFrame:
    return headings.groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def level_map(headings: DataFrame) -> DataFrame:
    return level_counts(headings).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("hierarchy_levels"))


def structure_metadata(classified: DataFrame) -> DataFrame:
    """Blocks, headings and whether a title was found, for each document."""
    heading = F.col("predicted_class").isin("title", "h1", "h2", "h3")
    return classified.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), F.count_if(heading).alias("heading_blocks"), (F.count_if(F.col("predicted_class") == "title") > 0).alias("title_detected"))


def operation_profile(runs: DataFrame) -> DataFrame:
    """``operation, duration, memory_before, memory_after, memory_peak`` rows to a row for each operation."""
    used = F.col("memory_after") - F.col("memory_before")
    return runs.groupBy("operation").agg(F.count("*").alias("n"), F.sum("duration").alias("total_duration"), F.max("duration").alias("max_duration"), F.min("duration").alias("min_duration"), F.avg("duration").alias("avg_duration"), F.sum(used).alias("total_memory_used"), F.avg(used).alias("avg_memory_used"), F.max("memory_peak").alias("max_memory_peak"))


def bottlenecks(runs: DataFrame, share: float = 0.3, memory: float = 200.0) -> DataFrame:
    """Operations that take over ``share`` of all time, and runs that grow by over ``memory``. Windows run over one row an operation."""
    totals = runs.groupBy("operation").agg(F.sum("duration").alias("d"))
    totals = totals.withColumn("value", F.col("d") / F.sum("d").over(Window.partitionBy()))
    slow = totals.where(F.col("value") > share).select(F.lit("time").alias("kind"), "operation", "value")
    grown = runs.select(F.lit("memory").alias("kind"), "operation", (F.col("memory_after") - F.col("memory_before")).alias("value"))
    return slow.union(grown.where(F.col("value") > memory))


def recommendations(profile: DataFrame, seconds: float = 2.0, memory: float = 500.0) -> DataFrame:
    slow = profile.where(F.col("avg_duration") > seconds).select(F.format_string("Optimize '%s' operation (avg: %.2fs)", "operation", "avg_duration").alias("recommendation"))
    return slow.union(profile.where(F.col("max_memory_peak") > memory).select(F.format_string("Reduce memory usage in '%s' (peak: %.1fMB)", "operation", "max_memory_peak")))


def error_counts(errors: DataFrame) -> DataFrame:
    """Counts by ``context:type``, and of all under ``total``."""
    return errors.groupBy(F.concat_ws(":", "context", "error_type").alias("error")).agg(F.count("*").alias("n")).union(errors.agg(F.count("*").alias("n")).select(F.lit("total"), "n"))


def run_summary(results: DataFrame) -> DataFrame:
    """``success, sections_processed, documents_processed, seconds`` rows to one row; ``exit_code`` is 1 only if all failed."""
    n, good = F.count("*"), F.count_if("success")
    return results.agg(n.alias("total"), good.alias("successful"), (n - good).alias("failed"), F.coalesce(F.sum("sections_processed"), F.lit(0)).alias("sections"), F.coalesce(F.sum("documents_processed"), F.lit(0)).alias("documents"), (F.sum("seconds") / F.nullif(F.sum("documents_processed"), F.lit(0))).alias("seconds_per_document"), F.when(good == 0, 1).otherwise(0).alias("exit_code"))
