"""Outputs: a JSON document for each row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_documents(rows: DataFrame, name: Column, value: Column, out: str, indent: int = 2) -> DataFrame:
    """Write each JSON string to ``out/<name>.json``, indented, without escapes; ``name, bytes, error`` of each.

    A file appears whole: it is written under another name, looked at and then moved. A name may hold folders. The folder
    must be one that executors share.
    """
    schema = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        to, base = _store(out)
        to.create_dir(base, recursive=True)
        for b in batches:
            done = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = json.dumps(json.loads(text), indent=indent, ensure_ascii=False).encode()
                    part = f"{base}/{key}".rpartition("/")[0] + f"/.{uuid.uuid4().hex}"
                    to.create_dir(part.rpartition("/")[0], recursive=True)
                    with to.open_output_stream(part) as sink:
                        sink.write(data)
                    if to.get_file_info(part).size != len(data):
                        raise OSError("the written file is not whole")
                    to.move(part, f"{base}/{key}.json")
                    done.append((key, len(data), None))
                except (OSError, ValueError, TypeError) as e:
                    done.append((key, 0, f"{type(e).__name__}: {e}"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return rows.select(name.cast("string").alias("name"), value.alias("value")).mapInArrow(run, "name string, bytes long, error string")


def write_outlines(outlines: DataFrame, path: str) -> None:
    """One JSON object a line, null errors left out: the form for many documents."""
    outlines.write.mode("overwrite").json(path)


def relevance_json() -> Column:
    """The JSON of a row of ``collection_output``."""
    return F.to_json(F.struct("metadata", "extracted_sections", "subsection_analysis"))
