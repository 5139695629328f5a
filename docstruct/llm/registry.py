"""Queries of this subpackage and their SQL; ``__spark_entry__`` adds both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstruct.llm.mixing import MIX_SQL
from docstruct.llm.urlrules import JUDGE_SQL
from docstruct.llm.warc import WARC_SQL


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.sstable import token_shards

    return token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.mixing import mix_digest

    return mix_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.common import cut
    from docstruct.llm.matroska import media_column, media_features

    return media_features(cut(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.licenses import find_licenses

    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.warc import deduplicated_archives

    return deduplicated_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.quality import score, train

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))


def op8_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.urlrules import judge, stated_rules

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), stated_rules(spark))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.decontaminate import contaminated

    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docstruct.llm.toxicity import score, train

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sstable, op2_mixing, op3_simhash, op4_matroska, op5_licenses, op6_warc, op7_quality, op8_urlrules, op9_decontamination, op10_toxicity)}
ORACLES: dict[str, str] = {"op2_mixing": MIX_SQL, "op6_warc": WARC_SQL, "op8_urlrules": JUDGE_SQL}
