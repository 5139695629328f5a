"""Both applications from a shell.

    python -m docstruct outline FILE_OR_FOLDER OUT [--timeout SECONDS] [--model FOLDER]
    python -m docstruct relevance BASE [--embedder FOLDER]

The exit code is 1 where nothing could be processed. ``--work`` is a folder that the cluster shares for tables in between.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docstruct.operators.model import onnx_model
from docstruct.operators.relevance import transformer
from docstruct.plans.outline import outline_files
from docstruct.plans.relevance import relevance_folder


def arguments(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="docstruct", description="Outlines of PDF files, and relevance of their sections.")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("outline", help="titles and headings of a PDF file or a folder of them")
    one.add_argument("path")
    one.add_argument("out")
    one.add_argument("--timeout", type=float, default=10.0, help="seconds a file may take")
    one.add_argument("--model", help="folder of a model in ONNX with its tokenizer")
    two = jobs.add_parser("relevance", help="ranked sections of Collection* folders")
    two.add_argument("base", nargs="?", default=".")
    two.add_argument("--embedder", help="folder of a sentence-transformers model")
    for job in (one, two):
        job.add_argument("--work", help="folder for tables in between; a temporary one of a local session by default")
        job.add_argument("--log-level", default="WARN", choices=["DEBUG", "INFO", "WARN", "ERROR"])
    return parser.parse_args(args)


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def work_folder(spark: SparkSession, given: str | None) -> str:
    """The given folder, one below the cluster's shared folder, or a temporary one of a local session."""
    if given:
        return uri(given)
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise SystemExit("a cluster needs --work or spark.checkpoint.dir")
    return uri(tempfile.mkdtemp(prefix="docstruct"))


def main(args: list[str] | None = None) -> int:
    asked = arguments(args)
    spark = SparkSession.builder.appName("docstruct").getOrCreate()
    spark.sparkContext.setLogLevel(asked.log_level)
    work = work_folder(spark, asked.work)
    if asked.job == "outline":
        options = {"model": onnx_model(asked.model)} if asked.model else {}
        done = outline_files(spark, uri(asked.path), uri(asked.out), work, seconds=asked.timeout, **options)
        told = done.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("good")).first()
        print(f"{told.good} of {told.n} documents written")
    else:
        done = relevance_folder(spark, uri(asked.base), work, transformer(asked.embedder) if asked.embedder else None)
        done.write.mode("overwrite").parquet(f"{work}/status")
        done = spark.read.parquet(f"{work}/status")
        told = done.agg(F.count("*").alias("n"), F.count_if(F.col("success")).alias("good"), F.sum("sections_processed").alias("sections")).first()
        print(f"{told.good} of {told.n} collections, {told.sections or 0} sections")
        done.where("not success").select("collection", "error_message").show(100, False)
    return 0 if told.good or not told.n and asked.job == "relevance" else 1


if __name__ == "__main__":
    sys.exit(main())
