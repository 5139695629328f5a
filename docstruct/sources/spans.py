"""Adapters from tables to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOLD_FONT, PLAIN_FONT = "Helvetica-Bold", "Helvetica"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def text_spans(docs: DataFrame, lines_a_page: int = 40) -> DataFrame:
    """A span for each line of a text; short lines are large and bold."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    n, place = F.length("text"), F.col("seq") % lines_a_page
    size = F.when(F.col("seq") == 0, 20.0).when(n < 30, 15.0).otherwise(11.0)
    return rows.select("doc_id", "seq", "text", (F.floor(F.col("seq") / lines_a_page) + 1).cast("int").alias("page_number"), box(F.lit(72), 72 + 14 * place, 72 + 5 * n, 84 + 14 * place).alias("bbox"), size.alias("font_size"), F.when(n < 30, BOLD_FONT).otherwise(PLAIN_FONT).alias("font_name"), F.when(n < 30, 16).otherwise(0).alias("font_flags"))


def numbered_spans(docs: DataFrame) -> DataFrame:
    """The same with numbers of several kinds before short lines."""
    kind = F.col("seq") % 6
    sign = F.when(kind == 0, "1. ").when(kind == 1, "1.2 ").when(kind == 2, "1.2.3 ").when(kind == 3, "Chapter 4 ").when(kind == 4, "(a) ").otherwise("")
    return text_spans(docs).withColumn("text", F.when(F.length("text") < 60, F.concat(sign, "text")).otherwise(F.col("text")))


def page_spans(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of web pages."""
    pattern = F.lit(r"<(h1|p|li)[^>]*>([^<]*)")
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("tag"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("text"))).alias("seq", "e"))
    tag, n = F.col("e.tag"), F.length("e.text")
    return rows.select("doc_id", "seq", F.col("e.text").alias("text"), F.lit(1).alias("page_number"), box(F.lit(72), 72 + 14 * F.col("seq"), 72 + 5 * n, 84 + 14 * F.col("seq")).alias("bbox"), F.when(tag == "h1", 24.0).when(tag == "p", 11.0).otherwise(10.0).alias("font_size"), F.when(tag == "h1", BOLD_FONT).otherwise(PLAIN_FONT).alias("font_name"), F.when(tag == "h1", 16).otherwise(0).alias("font_flags"))


def order_spans(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """An order as a document: each line is a span of the part's name."""
    n, q = F.col("n"), F.col("l_quantity").cast("double")
    flags = F.when(F.col("l_returnflag") == "R", 16).when(F.col("l_returnflag") == "A", 2).otherwise(0)
    rows = lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    x0 = F.col("l_tax").cast("double") * 1000
    return rows.select(F.col("l_orderkey").alias("doc_id"), n.alias("seq"), F.col("p_name").alias("text"), (F.floor((n - 1) / 4) + 1).cast("int").alias("page_number"), box(x0, 20 * n, x0 + 5 * F.length("p_name"), 20 * n + q).alias("bbox"), q.alias("font_size"), F.col("p_brand").alias("font_name"), flags.alias("font_flags"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
