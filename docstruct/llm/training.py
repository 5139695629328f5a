"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import held_out


def labelled_ids(labels: DataFrame, label: str, rows: int, by_class: bool = False, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Up to ``rows`` identifiers with their label (of each class where ``by_class``), and the count of each class.

    Held-out rows are left out first; of labels that repeat an identifier the largest counts; null labels don't. The
    sample is the rows of smallest hash of the identifier, so that it is the same in each run.
    """
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("_label")).groupBy("_id").agg(F.max("_label").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    order = (F.xxhash64("_id"), F.col("_id"))
    if not by_class:
        return known.orderBy(*order).limit(rows), counts
    return known.where("_label = 1").orderBy(*order).limit(rows).union(known.where("_label = 0").orderBy(*order).limit(rows)), counts


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _label, text`` of the sample; ``ids`` is bounded by its own limit, so it is sent to every task."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "_id")
