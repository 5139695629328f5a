"""What the operators of this subpackage share: the shared folder, lineage cuts and Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, since there one machine holds all.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (root := getattr(spark, "_docstruct_root", None)):
        root = "file://" + tempfile.mkdtemp(prefix="docstruct-")
        spark.sparkContext.setCheckpointDir(root)
        spark._docstruct_root = root
    return root


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and read it back from the shared folder: its lineage ends there and survives lost executors.

    The table goes when the driver's JVM ends, or with :func:`release`.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    folder, where = _hadoop(spark, path)
    folder.deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docstruct_cut = path
    return out


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def release(df: DataFrame) -> None:
    """Delete a table of :func:`cut` that nothing reads any more."""
    folder, where = _hadoop(df.sparkSession, df._docstruct_cut)
    folder.delete(where, True)


def set_aside(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` under column names that clash with nothing, and these names in order."""
    names = [f"_docstruct_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def attempt_name(stem: str, suffix: str) -> str:
    """A name that no other attempt of the task uses; the manifest tells which attempt counts."""
    from pyspark import TaskContext

    return f"{stem}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"


def held_out(doc_id: str) -> Column:
    """Rows kept from training: the CRC-32 of the identifier's text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *cols: Column | str) -> DataFrame:
    """``fn`` over the Arrow batches of ``cols`` alone, so that the scan reads nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.select(*cols).mapInArrow(run, schema)


def give_back() -> None:
    """Return what a Python worker has freed to the system: it outlives its task, and idle memory counts too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than GNU's
        pass


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
