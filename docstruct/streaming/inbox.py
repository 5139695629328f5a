"""An inbox of PDF files as a stream.

Every operator works within a document and a file comes whole, so a micro-batch is the batch plan: no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstruct.plans.outline import outline
from docstruct.schema import SETTINGS, Settings
from docstruct.sources.pdf import decode_pdfs, pdf_spans


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, settings: Settings = SETTINGS, once: bool = False) -> StreamingQuery:
    """Outlines of files that arrive in ``inbox``, as Parquet below ``out`` in a folder for each batch.

    A batch that is run again overwrites its own folder, so each file's outline is there once.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").load(inbox)

    def write(batch: DataFrame, number: int) -> None:
        outline(pdf_spans(decode_pdfs(batch, settings)), settings).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
