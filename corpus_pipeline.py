"""The corpus pipeline: documents to token shards. Part of ``docstruct.llm``.

Each stage works on all that the one before it kept. The first four return the columns of documents.

Cases: null texts count as empty, and empty texts are rejected by the classifier or are copies of each other; repeated rows
are copies; columns beside ``doc_id``, ``text`` and ``source`` are carried to the mix, whatever their names; an empty table gives no
rows; very long texts go through whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docstruct.llm import decontaminate, mixing, quality, simhash, sstable
from docstruct.llm.common import cut, release
from docstruct.llm.registry import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from those of ``docs`` that ``labels`` marks."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest identifier.

    Near copies are texts whose sets of five-word shingles are alike to 0.8, and what a chain of these reaches.
    """
    return simhash.deduplicate(docs, shingle=5, jaccard=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that it takes twice is there twice."""
    return mixing.emit(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token shards, a row for each document of the mix; in small slices, since executors are full by now."""
    return sstable.token_shards(docs, tokenizer_path(), slice_bytes=1 << 20)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_output),
]
#: Models and byte-pair merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before it kept, written and read again between them."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if written is not None:
                release(written)
            written = docs
    return docs
