"""Collections: their configuration and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("challenge_info", "documents", "persona", "job_to_be_done")


def listed_documents(collections: DataFrame) -> DataFrame:
    return collections.select("collection", F.posexplode("documents").alias("place", "d")).select("collection", "place", F.col("d.filename").alias("filename"), F.col("d.title").alias("title"))


def found_documents(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed documents that are there, in their listed order (``place``)."""
    return listed.join(files.select("collection", "filename"), ["collection", "filename"], "left_semi")


def missing_documents(listed: DataFrame, files: DataFrame) -> DataFrame:
    return listed.join(files.select("collection", "filename"), ["collection", "filename"], "left_anti")


def missing_parts(collections: DataFrame) -> DataFrame:
    """``missing``: the required parts that a configuration leaves out."""
    absent = F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED])
    return collections.withColumn("missing", F.sort_array(F.filter(absent, lambda x: x.isNotNull())))
