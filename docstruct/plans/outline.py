"""The outline of documents, from spans to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions.text import stem
from docstruct.operators.classify import RULE_FEATURES, classified, with_features
from docstruct.operators.layout import preprocess, repair
from docstruct.operators.model import Load, with_model
from docstruct.operators.outline import EMPTY_STAGES, as_json, coded_failure_output, structure
from docstruct.schema import ERROR, OUTLINE, SETTINGS, Settings
from docstruct.sources.pdf import Decoder, decode_pdfs, empty_files, pdf_errors, pdf_files, pdf_spans
from docstruct.sources.pdffile import read
from docstruct.sources.sinks import write_documents


def classify_spans(spans: DataFrame, settings: Settings = SETTINGS, compose: bool = True, model: Load | None = None, **options: bool) -> DataFrame:
    """Blocks with the features that rules read, and classes. One exchange by document serves all steps.

    With a ``model`` all features are computed, and its answers go before the rules.
    """
    blocks = preprocess(repair(spans, settings), settings, compose, **options)
    if model is None:
        return classified(with_features(blocks, settings, RULE_FEATURES), settings)
    return classified(with_model(with_features(blocks, settings), model), settings)


def outline(spans: DataFrame, settings: Settings = SETTINGS, compose: bool = True, **options) -> DataFrame:
    """``doc_id, title, outline`` of every document that has a block."""
    return structure(classify_spans(spans, settings, compose, **options))


def outline_json(spans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return outline(spans, settings).select("doc_id", as_json(F.col("title"), F.col("outline")).alias("json"))


def decoded_outlines(decoded: DataFrame, at: Column, settings: Settings = SETTINGS, seconds: float = 10.0, **options) -> DataFrame:
    """``path, title, outline, error`` of every path of :func:`decode_pdfs`: its outline, or the error that it ended with.

    ``decoded`` is read twice, so it should be a written table. A path of spans that come to no block has the stage's error.
    """
    made = outline(pdf_spans(decoded), settings, **options).withColumnRenamed("doc_id", "path")
    failed = pdf_errors(decoded, int(seconds))
    paths = decoded.where("error_code is null").select("path").distinct().join(made, "path", "left")
    empty = paths.where("title is null").select("path", F.lit("stage").alias("kind"), F.lit(EMPTY_STAGES["preprocess"]).alias("message"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("int").alias("limit"))
    return paths.where("title is not null").withColumn("error", F.lit(None).cast(ERROR)).unionByName(error_outputs(failed.unionByName(empty), at))


def error_outputs(failures: DataFrame, at: Column) -> DataFrame:
    """``path, title, outline, error`` that stand for files without an outline."""
    nothing = F.array().cast(OUTLINE.partition("outline ")[2])
    return coded_failure_output(failures, at).select("path", "title", nothing.alias("outline"), "error")


def outline_files(spark: SparkSession, path: str, out: str, work: str, settings: Settings = SETTINGS, seconds: float = 10.0, decoder: Decoder = read, **options) -> DataFrame:
    """Write ``out/<file's stem>.json`` for every PDF file of ``path``, a file or a folder; ``name, bytes, error`` of each.

    A file that is empty, damaged, encrypted, too slow or without text has a document with its error. Files are decoded
    once, into a table of ``work``, a folder that the cluster shares.
    """
    decode_pdfs(pdf_files(spark, path), settings, decoder=decoder, seconds=seconds).write.mode("overwrite").parquet(f"{work}/decoded")
    at = F.unix_micros(F.current_timestamp()) / 1e6
    made = decoded_outlines(spark.read.parquet(f"{work}/decoded"), at, settings, seconds, **options)
    made = made.unionByName(error_outputs(empty_files(spark, path), at))
    write_documents(made, stem(F.col("path")), as_json(F.col("title"), F.col("outline"), F.col("error")), out).write.mode("overwrite").parquet(f"{work}/written")
    return spark.read.parquet(f"{work}/written")
