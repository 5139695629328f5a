"""Embeddings, cosine ranking of sections and sentences, and the output of a collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import query_text, section_text, sentences
from docstruct.schema import SETTINGS, Settings

#: Similarities that agree to so many digits are ties, so that the order of a sum decides nothing.
TIE_DIGITS = 12
#: An embedder takes a text column and gives an ``array<double>`` column.
Embedder = Callable[[Column], Column]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hashed(dim: int = SETTINGS.dim) -> Embedder:
    """Counts of tokens in ``dim`` slots by the head of their MD5, of length one. Stays in the JVM, and SQL can repeat it."""

    def embed(text: Column) -> Column:
        slots = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
        counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), dim), lambda a, s: F.transform(a, lambda x, i: F.when(i == s, x + 1).otherwise(x)))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    return embed


#: Words whose slots the hashed embedder remembers, and rows whose vectors it holds at once.
SLOTS_KEPT, ROWS_HELD = 20_000, 512


def hashed_arrow(dim: int = SETTINGS.dim) -> Embedder:
    """The same values in Arrow batches: linear in the tokens, for long texts and many slots.

    Beside the batch that Spark sends, a worker holds one text as Python strings, a bounded table of slots and flat vectors.
    """
    import re
    from hashlib import md5

    import numpy as np

    word = re.compile(r"[^\W_]+")

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slot: dict[str, int] = {}
        for texts in batches:
            parts = []
            for at in range(0, len(texts), ROWS_HELD):
                some = texts.slice(at, ROWS_HELD)
                out = np.zeros((len(some), dim))
                for row, text in zip(out, some, strict=True):
                    for found in word.finditer((text.as_py() or "").lower()):
                        t = found[0]
                        if (k := slot.get(t)) is None:
                            if len(slot) >= SLOTS_KEPT:
                                slot.clear()
                            k = slot[t] = int(md5(t.encode()).hexdigest()[:8], 16) % dim
                        row[k] += 1
                norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
                out /= np.where(norm > 0, norm, 1.0)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))
            pa.default_memory_pool().release_unused()

    return run


def batched(load: Callable[[], Callable[[list[str]], object]], dim: int, batch_size: int = 32) -> Embedder:
    """An embedder of a function from texts to rows of ``dim`` numbers, loaded once in a Python worker.

    A batch that fails, or gives other than a row of that length for each text, has zero vectors, and so has a null text.
    """
    import numpy as np

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            out = []
            for at in range(0, len(texts), batch_size):
                some = texts.iloc[at : at + batch_size]
                try:
                    rows = np.asarray(encode([t or "" for t in some]), np.float64)
                    if rows.shape != (len(some), dim):
                        raise ValueError("a vector for each text is needed")
                except Exception:  # a batch's fault costs its own texts their likeness
                    rows = np.zeros((len(some), dim))
                rows[some.isna().to_numpy()] = 0
                out += rows.tolist()
            yield pd.Series(out, dtype=object)

    return run


def transformer(path: str, dim: int = SETTINGS.dim, batch_size: int = 32) -> Embedder:
    """A sentence-transformers model at ``path``. Needs that library."""

    def load() -> Callable[[list[str]], object]:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(path, device="cpu").encode

    return batched(load, dim, batch_size)


def rank_vectors(sections: DataFrame, queries: DataFrame) -> DataFrame:
    """Sections with ``vector`` against the one query of their ``collection``: ``similarity`` and ``importance_rank``.

    Queries are a row a collection; Spark broadcasts them while its size check allows.
    """
    rows = sections.join(queries.select("collection", F.col("vector").alias("query")), "collection")
    rows = rows.withColumn("similarity", cosine(F.col("query"), F.col("vector")))
    rank = F.row_number().over(Window.partitionBy("collection").orderBy(F.round("similarity", TIE_DIGITS).desc(), "seq"))
    return rows.withColumn("importance_rank", rank).drop("query", "vector")


def rank_sections(sections: DataFrame, collections: DataFrame, embed: Embedder | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """All sections of each collection by likeness to its persona and task."""
    embed = embed or hashed_arrow(settings.dim)
    asked = query_text(F.col("persona.role"), F.col("job_to_be_done.task"), settings.query_chars)
    queries = collections.withColumn("asked", asked).where("asked is not null").select("collection", embed(F.col("asked")).alias("vector"))
    rows = sections.withColumn("vector", embed(section_text(F.col("section_title"), F.col("content"), settings.section_chars)))
    return rank_vectors(rows, queries)


def top_sections(ranked: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return ranked.where(F.col("importance_rank") <= settings.top_sections)


def first_match(ranked: DataFrame, sections: DataFrame) -> DataFrame:
    """Each ranked row with the content of the first section of its document, title and page; so equal keys share it."""
    key = ["collection", "document", "section_title", "page_number"]
    first = sections.groupBy(*key).agg(F.min_by("content", "seq").alias("first_content"))
    return ranked.join(first, key).withColumn("content", F.col("first_content")).drop("first_content")


def top_sentences(top: DataFrame, queries: DataFrame, embed: Embedder, settings: Settings = SETTINGS) -> DataFrame:
    """For each section its likest sentences joined in that order, their count and mean likeness; none without sentences."""
    rows = top.select("collection", "importance_rank", "document", "page_number", F.posexplode(sentences(F.col("content"), settings.max_sentences)).alias("place", "sentence"))
    rows = rows.withColumn("vector", embed(F.col("sentence"))).join(queries.select("collection", F.col("vector").alias("query")), "collection")
    rows = rows.withColumn("similarity", cosine(F.col("query"), F.col("vector")))
    section = ["collection", "importance_rank", "document", "page_number"]
    rank = F.row_number().over(Window.partitionBy(*section).orderBy(F.round("similarity", TIE_DIGITS).desc(), "place"))
    kept = rows.withColumn("rk", rank).where(F.col("rk") <= settings.top_sentences)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "sentence"))), lambda s: s["sentence"]), " ")
    return kept.groupBy(*section).agg(text.alias("refined_text"), F.count("*").alias("sentence_count"), F.avg("similarity").alias("avg_similarity"))


def metadata(collections: DataFrame, stamp: Column) -> DataFrame:
    """Names, persona, task and the given time stamp, empty strings for what is missing."""
    own = F.struct(F.coalesce(F.transform("documents", lambda d: d["filename"]), F.array().cast("array<string>")).alias("input_documents"), F.coalesce("persona.role", F.lit("")).alias("persona"), F.coalesce("job_to_be_done.task", F.lit("")).alias("job_to_be_done"), stamp.cast("string").alias("processing_timestamp"))
    return collections.select("collection", own.alias("metadata"))


def collection_output(collections: DataFrame, ranked: DataFrame, analysed: DataFrame, stamp: Column) -> DataFrame:
    """A row for each collection: metadata, every ranked section, and the analysis of the top ones, both in rank order."""
    section = F.struct("importance_rank", F.struct("document", "section_title", "importance_rank", "page_number").alias("s"))
    some = ranked.groupBy("collection").agg(F.transform(F.sort_array(F.collect_list(section)), lambda x: x["s"]).alias("extracted_sections"))
    part = F.struct("importance_rank", F.struct("document", "refined_text", "page_number").alias("s"))
    told = analysed.groupBy("collection").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]).alias("subsection_analysis"))
    return metadata(collections, stamp).join(some, "collection", "left").join(told, "collection", "left")
