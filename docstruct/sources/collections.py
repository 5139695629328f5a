"""Collections on disk: folders ``Collection*`` with a configuration and PDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.operators.collections import missing_parts
from docstruct.schema import COLLECTION

# The names of a collection's configuration and output files.
INPUT_NAME = "challenge1b_input.json"
OUTPUT_NAME = "challenge1b_output"


def read_collections(spark: SparkSession, base: str, name: str = INPUT_NAME) -> DataFrame:
    """A row for each collection's configuration, in no order; ``collection`` is its folder's name.

    ``error`` tells what keeps a configuration from use, null for a good one: text that is no JSON, or required parts that
    it leaves out. All parts of text that is no JSON are null.
    """
    reader = spark.read.schema(f"{COLLECTION}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = missing_parts(reader.json(f"{base}/Collection*/{name}"))
    lacks = F.concat(F.lit("Missing required keys in input configuration: "), F.array_join("missing", ", "))
    rows = rows.withColumn("error", F.when(F.col("_corrupt_record").isNotNull(), "Invalid JSON in input configuration").when(F.size("missing") > 0, lacks))
    return rows.withColumn("collection", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))).drop("_corrupt_record", "missing")


def collection_files(spark: SparkSession, base: str, folder: str = "PDFs") -> DataFrame:
    """``collection, filename, path, content`` of the PDF files; content is read only where it is asked for.

    Files that Spark finds none of are an empty table.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/Collection*/{folder}/*.pdf")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], "collection string, filename string, path string, content binary")
    rows = spark.read.format("binaryFile").load(f"{base}/Collection*/{folder}/*.pdf")
    return rows.select(F.regexp_extract("path", rf"([^/]+)/{folder}/[^/]+$", 1).alias("collection"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "content")
