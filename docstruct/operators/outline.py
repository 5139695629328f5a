"""Titles, heading levels, outlines and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.rules import HEADINGS
from docstruct.functions.text import basename, strip
from docstruct.schema import ERROR

UNTITLED = "Untitled Document"
LEVELS = ("H1", "H2", "H3")


def level_of(name: Column) -> Column:
    """The level of a heading class; null for text."""
    return F.when(name == "title", "title").when(name == "h1", "H1").when(name == "h2", "H2").when(name == "h3", "H3")


def headings(classified: DataFrame) -> DataFrame:
    """Blocks of a heading class, with ``level``."""
    rows = classified.where(F.col("predicted_class").isin(*HEADINGS))
    return rows.withColumn("level", level_of(F.col("predicted_class"))).withColumn("text", strip(F.col("text")))


def surest_title() -> Column:
    """Aggregate: the title of highest confidence, the first of equals."""
    titled = F.col("level") == "title"
    return F.max_by(F.when(titled, F.col("text")), F.when(titled, F.struct("confidence", (-F.col("seq")).alias("s"))))


def first_heading() -> Column:
    """Aggregate: the first heading by page and height."""
    found = F.col("level").isNotNull()
    return F.min_by(F.when(found, F.col("text")), F.when(found, F.struct("page_number", "position_y", "seq")))


def titles(found: DataFrame) -> DataFrame:
    """``doc_id, title`` of documents with headings."""
    return found.groupBy("doc_id").agg(F.coalesce(surest_title(), first_heading()).alias("title"))


def largest_on_first_page(found: DataFrame) -> DataFrame:
    """The heading of largest relative size on page 1; the title cascade never comes to it."""
    return found.where("page_number = 1").groupBy("doc_id").agg(F.max_by("text", F.struct("font_size_ratio", (-F.col("seq")).alias("s"))).alias("title"))


def repeats(text: Column, title: Column) -> Column:
    """Whether a heading is its document's title again; no title is repeated by nothing."""
    return F.coalesce((strip(title) != "") & (text == strip(title)), F.lit(False))


def without_title(found: DataFrame, title: DataFrame) -> DataFrame:
    """Headings that don't repeat their document's title."""
    rows = found.join(title, "doc_id", "left")
    return rows.where(~repeats(F.col("text"), F.col("title"))).drop("title")


def progressed(found: DataFrame, *within: str) -> DataFrame:
    """Levels in the order of page and text, none skipped: the first is H1, and an H3 needs an H2 since the first row.

    Closed form of the running state: after the first row that is no title, each H2 or H3 comes out as H2 at least.
    ``within`` names further columns whose groups run apart; clustering by document serves them too.
    """
    w = Window.partitionBy("doc_id", F.col("level") == "title", *within).orderBy("page_number", "text", "seq")
    before = F.count_if(F.col("level").isin("H2", "H3") & (F.col("rn") > 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("rn", F.row_number().over(w)).withColumn("deep", before)
    level = F.when(F.col("level").isNull(), F.lit(None)).when(F.col("level") == "title", "title").when((F.col("rn") == 1) | (F.col("level") == "H1"), "H1").when((F.col("level") == "H3") & (F.col("deep") > 0), "H3").otherwise("H2")
    return rows.withColumn("level", level).drop("rn", "deep")


def outlines(docs: DataFrame, title: DataFrame, levels: DataFrame) -> DataFrame:
    """``doc_id, title, outline`` of every document of ``docs``; titles are no entries."""
    entry = F.struct(F.col("page_number").alias("page"), "text", "seq", "level")
    rows = levels.where("level <> 'title'").groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    named = docs.select("doc_id").distinct().join(title, "doc_id", "left").join(rows, "doc_id", "left")
    outline = F.transform(F.coalesce("e", F.array().cast("array<struct<page:int,text:string,seq:int,level:string>>")), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"), x["page"].alias("page")))
    return named.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), outline.alias("outline"))


def structure(classified: DataFrame) -> DataFrame:
    """Classified blocks to ``doc_id, title, outline`` of every document.

    The same as :func:`outlines` of the single steps, in one chain: titles are window aggregates, so that the blocks are
    read once and no row leaves its document's partition.
    """
    d = Window.partitionBy("doc_id")
    rows = classified.select("doc_id", "seq", strip(F.col("text")).alias("text"), "page_number", "confidence", F.col("features.position_y").alias("position_y"), level_of(F.col("predicted_class")).alias("level"))
    rows = rows.withColumn("title", F.coalesce(surest_title().over(d), first_heading().over(d)))
    rows = rows.withColumn("kept", F.col("level").isNotNull() & ~repeats(F.col("text"), F.col("title")))
    entry = F.when(F.col("kept") & (F.col("level") != "title"), F.struct(F.col("page_number").alias("page"), "text", "seq", "level"))
    made = progressed(rows, "kept").groupBy("doc_id").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(entry)).alias("e"))
    outline = F.transform("e", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"), x["page"].alias("page")))
    return made.select("doc_id", F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), outline.alias("outline"))


def is_valid(title: Column, outline: Column) -> Column:
    """Whether an output has its keys, known levels, text and pages from 1."""
    good = lambda e: F.coalesce(e["level"].isin(*LEVELS), F.lit(False)) & F.coalesce(strip(e["text"]) != "", F.lit(False)) & F.coalesce(e["page"] >= 1, F.lit(False))
    return title.isNotNull() & outline.isNotNull() & F.coalesce(F.forall(outline, good), F.lit(False))


def as_json(title: Column, outline: Column, error: Column | None = None, pretty: bool = False) -> Column:
    parts = [title.alias("title"), outline.alias("outline")] + ([error.alias("error")] if error is not None else [])
    return F.to_json(F.struct(*parts), {"pretty": "true"} if pretty else {})


def error_struct(kind: Column | str, message: Column | str, details: Column | str, code: Column | None = None, at: Column | None = None, limit: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = (text(kind).alias("type"), text(message).alias("message"), text(details).alias("details"), (code if code is not None else F.lit(None).cast("string")).alias("error_code"), (at if at is not None else F.lit(None).cast("double")).alias("timestamp"), (limit if limit is not None else F.lit(None).cast("int")).alias("timeout_limit"))
    return F.struct(*parts).cast(ERROR)


# Titles and errors of the outputs that stand for a failed document.
FAILURES = {
    "processing": ("Error: Processing Failed", None, None, "An error occurred during document processing"),
    "format": ("Error: Invalid Output Format", "ValidationError", "Generated output failed format validation", "The processed document structure could not be formatted correctly"),
    "write": ("Error: File Write Failed", "WriteError", None, "Failed to write output file"),
    "no_title": (UNTITLED, "NoTitleFound", "No document title could be detected", "Using default title"),
    "no_headings": ("Document", "NoHeadingsDetected", "No headings could be detected in the document", "The document may not contain structured headings"),
}
EMPTY_STAGES = {"parse": "No text content found", "preprocess": "No content after preprocessing", "classify": "Classification failed for all blocks"}


def failure_output(failures: DataFrame) -> DataFrame:
    """``kind, error_type, message`` rows with ``title`` and ``error``: the output for each kind of ``FAILURES``."""
    kind, title, error = F.col("kind"), F.lit(None).cast("string"), F.lit(None).cast(ERROR)
    for k, (t, of, said, details) in FAILURES.items():
        title = F.when(kind == k, F.lit(t)).otherwise(title)
        error = F.when(kind == k, error_struct(of or F.col("error_type"), said or F.col("message"), details)).otherwise(error)
    return failures.withColumns({"title": title, "error": error})


def coded_failure_output(failures: DataFrame, at: Column) -> DataFrame:
    """``path, kind, message, error_code, limit`` rows with ``title`` and a coded, stamped ``error``; a "stage" has neither."""
    name, path, kind, message = basename(F.col("path")), F.col("path"), F.col("kind"), F.col("message")
    code = lambda default: F.coalesce("error_code", F.lit(default))
    title = F.when(kind.isin("pdf", "stage"), F.concat(F.lit("Error: Failed to process "), name)).when(kind == "model", "Error: Model Loading Failed").when(kind == "output", "Error: Output Generation Failed").when(kind == "timeout", F.concat(F.lit("Error: Processing timeout for "), name)).otherwise("Error: Invalid Output Format")
    error = (
        F.when(kind == "pdf", error_struct("PDFProcessingError", message, F.concat(F.lit("Failed to process PDF: "), path), code("PDF_PROCESSING_FAILED"), at))
        .when(kind == "stage", error_struct("ProcessingError", message, F.concat(F.lit("Failed to process PDF: "), path)))
        .when(kind == "model", error_struct("ModelLoadingError", message, F.concat(F.lit("Failed to load model from: "), path), code("MODEL_LOADING_FAILED"), at))
        .when(kind == "output", error_struct("OutputGenerationError", message, "Failed to generate proper JSON output", code("OUTPUT_GENERATION_FAILED"), at))
        .when(kind == "timeout", error_struct("TimeoutError", F.concat(F.lit("Processing exceeded "), F.col("limit").cast("string"), F.lit(" second limit")), F.concat(F.lit("PDF processing timed out: "), path), F.lit("PROCESSING_TIMEOUT"), at, F.col("limit")))
        .otherwise(error_struct("ValidationError", message, "Generated output failed format validation", code("VALIDATION_FAILED"), at))
    )
    return failures.withColumns({"title": title, "error": error})


def empty_stage_errors(docs: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, message``: the first stage that left a document nothing; ``counts`` hold ``doc_id`` of what each stage left."""
    rows, message = docs.select("doc_id").distinct(), F.lit(None).cast("string")
    for k, stage in reversed(list(counts.items())):
        rows = rows.join(stage.select("doc_id").distinct().withColumn(f"has_{k}", F.lit(True)), "doc_id", "left")
        message = F.when(F.col(f"has_{k}").isNull(), EMPTY_STAGES[k]).otherwise(message)
    return rows.select("doc_id", message.alias("message")).where("message is not null")


def salvaged_blocks(blocks: DataFrame, most: int = 10, chars: int = 100) -> DataFrame:
    """The first blocks of each document, cut short, for a document whose structure failed."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return blocks.withColumn("rn", rn).where(F.col("rn") <= most).select("doc_id", "seq", F.substring("text", 1, chars).alias("text"), "page_number")


def salvaged_outline(outline: Column, most: int = 5, chars: int = 200) -> Column:
    return F.transform(F.slice(outline, 1, most), lambda e: F.struct(e["level"].alias("level"), F.substring(e["text"], 1, chars).alias("text"), F.coalesce(e["page"], F.lit(1)).alias("page")))


def missing_keys(rows: DataFrame, keys: str, required: tuple[str, ...]) -> DataFrame:
    """``missing``: required keys that the array column ``keys`` lacks."""
    return rows.withColumn("missing", F.sort_array(F.array_except(F.array(*map(F.lit, required)), keys)))
