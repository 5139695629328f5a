"""Relevance of a collection's sections to a persona and a task, from spans to the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions.text import query_text
from docstruct.operators.collections import found_documents, listed_documents
from docstruct.operators.relevance import Embedder, collection_output, first_match, hashed_arrow, rank_sections, top_sections, top_sentences
from docstruct.operators.sections import sections
from docstruct.schema import SETTINGS, Settings
from docstruct.sources.collections import OUTPUT_NAME, collection_files, read_collections
from docstruct.sources.pdf import Decoder, decode_pdfs, pdf_spans
from docstruct.sources.pdffile import read
from docstruct.sources.sinks import relevance_json, write_documents


def document_sections(spans: DataFrame, names: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Sections with ``collection`` and ``document``; ``names`` has these for each ``doc_id``, of any type.

    ``seq`` becomes a struct of document and place, which orders the sections of a collection; where ``names`` has a
    ``place``, documents come in that order.
    """
    rows = sections(spans, settings).join(names, "doc_id")
    by = ["place"] if "place" in names.columns else []
    return rows.withColumn("seq", F.struct(*by, "doc_id", "seq")).drop(*by)


def relevance(spans: DataFrame, names: DataFrame, collections: DataFrame, stamp: Column, embed: Embedder | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """A row for each collection: metadata, all sections ranked, and the likest sentences of the top ones."""
    return relevance_of(document_sections(spans, names, settings), collections, stamp, embed, settings)


def relevance_of(found: DataFrame, collections: DataFrame, stamp: Column, embed: Embedder | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """The same of sections with ``collection`` and ``document``."""
    embed = embed or hashed_arrow(settings.dim)
    ranked = rank_sections(found, collections, embed, settings)
    asked = query_text(F.col("persona.role"), F.col("job_to_be_done.task"), settings.query_chars)
    queries = collections.withColumn("asked", asked).where("asked is not null").select("collection", embed(F.col("asked")).alias("vector"))
    analysed = top_sentences(first_match(top_sections(ranked, settings), found), queries, embed, settings)
    return collection_output(collections, ranked, analysed, stamp)


def relevance_folder(spark: SparkSession, base: str, work: str, embed: Embedder | None = None, settings: Settings = SETTINGS, decoder: Decoder = read, seconds: float = 10.0, stamp: Column | None = None) -> DataFrame:
    """Write the output of every ``Collection*`` folder of ``base`` into it; a status row for each.

    ``collection, success, error_message, sections_processed, documents_processed, missing, failed``: a collection without a
    good configuration, its files or a section of them fails alone; ``missing`` are listed files that are not there, and
    ``failed`` those that gave no text. Decoded files and sections are written once, into tables of ``work``, a folder that
    the cluster shares.
    """
    asked = read_collections(spark, base)
    asked.write.mode("overwrite").parquet(f"{work}/collections")
    asked = spark.read.parquet(f"{work}/collections")
    good = asked.where("error is null").drop("error")
    listed, files = listed_documents(good), collection_files(spark, base)
    there = found_documents(listed.groupBy("collection", "filename").agg(F.min("place").alias("place")), files)
    wanted = files.join(there, ["collection", "filename"])
    decode_pdfs(wanted, settings, "relevance", decoder, seconds).write.mode("overwrite").parquet(f"{work}/decoded")
    decoded = spark.read.parquet(f"{work}/decoded")
    names = wanted.select(F.col("path").alias("doc_id"), "collection", F.col("filename").alias("document"), "place")
    document_sections(pdf_spans(decoded), names, settings).write.mode("overwrite").parquet(f"{work}/sections")
    found = spark.read.parquet(f"{work}/sections")

    counted = found.groupBy("collection").agg(F.count("*").alias("n"))
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if stamp is None else stamp
    made = relevance_of(found, good.join(counted, "collection", "left_semi"), at, embed, settings)
    write_documents(made, F.concat("collection", F.lit(f"/{OUTPUT_NAME}")), relevance_json(), base, indent=4).write.mode("overwrite").parquet(f"{work}/written")
    written = spark.read.parquet(f"{work}/written").select(F.regexp_extract("name", r"^(.*)/", 1).alias("collection"), F.col("error").alias("unwritten"))

    read_ones = names.join(decoded.where("error_code is null").select(F.col("path").alias("doc_id")).distinct().withColumn("text", F.lit(True)), "doc_id", "left")
    texts = read_ones.groupBy("collection").agg(F.count("text").alias("documents_processed"), F.array_sort(F.collect_list(F.when(F.col("text").isNull(), F.col("document")))).alias("failed"))
    absent = listed.join(there, ["collection", "filename"], "left_anti").groupBy("collection").agg(F.array_sort(F.collect_set("filename")).alias("missing"))
    rows = asked.select("collection", "error")
    for part in (counted, written, texts, absent):
        rows = rows.join(part, "collection", "left")
    none = F.array().cast("array<string>")
    why = F.coalesce("error", F.when(F.col("documents_processed").isNull(), "PDF directory or files not found"), F.when(F.col("n").isNull(), "No sections extracted from any PDF files"), "unwritten")
    return rows.select("collection", why.isNull().alias("success"), why.alias("error_message"), F.coalesce("n", F.lit(0)).alias("sections_processed"), F.coalesce("documents_processed", F.lit(0)).alias("documents_processed"), F.coalesce("missing", none).alias("missing"), F.coalesce("failed", none).alias("failed"))
