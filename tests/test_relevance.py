"""Sections, ranking and the output of a collection."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docstruct.functions.rules import is_header
from docstruct.operators import collections as c
from docstruct.operators import relevance as r
from docstruct.operators import sections as s
from docstruct.operators import stats
from docstruct.plans.relevance import relevance
from docstruct.schema import COLLECTION, SETTINGS, SPANS

COOKING = [("book.pdf", 0, "Basic techniques", "Learn to cook with these basic cooking techniques. Boil water before you add the pasta. Knives should be sharp at all times.", 1), ("book.pdf", 1, "History", "The origins of food go far back. Many kings had large kitchens in their palaces.", 2), ("book.pdf", 2, "Desserts", "Sugar and butter make sweet things at home. Bake until it is golden.", 3)]
SECTIONS = "collection string, document string, seq long, section_title string, content string, page_number int"


@pytest.fixture
def cooking(spark):
    sections = spark.createDataFrame([("Collection 1", *row) for row in COOKING], SECTIONS)
    config = spark.createDataFrame([("Collection 1", ("1", "t", "d"), [("book.pdf", "Book")], ("home cook",), ("learn basic cooking techniques",))], "collection string, " + COLLECTION)
    return sections, config


def test_ranks(spark, cooking):
    sections, config = cooking
    out = r.rank_sections(sections, config).orderBy("importance_rank").collect()
    assert [x.importance_rank for x in out] == [1, 2, 3] and out[0].section_title == "Basic techniques"
    silent = config.withColumn("persona", F.struct(F.lit(" ").alias("role"))).withColumn("job_to_be_done", F.struct(F.lit(None).cast("string").alias("task")))
    assert r.rank_sections(sections, silent).count() == 0


def test_embedders_agree(spark):
    rows = spark.createDataFrame([("Cook the pasta, cook IT 2x",), ("",), (None,), ("Éa ßb 中文",)], "t string")
    out = rows.select(r.hashed(16)(F.col("t")).alias("a"), r.hashed_arrow(16)(F.col("t")).alias("b")).collect()
    assert all(x.a == pytest.approx(x.b) for x in out) and sum(out[1].a) == 0


def test_cosine(spark):
    out = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>").select(r.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [x.c for x in out] == pytest.approx([math.sqrt(0.5), 0.0])


def test_first_match_keeps_the_first_content(spark):
    rows = spark.createDataFrame([("c", "d", i, "T", f"content {i}", 1) for i in range(3)], SECTIONS)
    assert {x.content for x in r.first_match(rows, rows).collect()} == {"content 0"}


def test_output(spark, cooking):
    sections, config = cooking
    embed = r.hashed_arrow(64)
    ranked = r.rank_sections(sections, config, embed)
    queries = config.select("collection", embed(F.lit("home cook learn basic cooking techniques")).alias("vector"))
    told = r.top_sentences(r.first_match(r.top_sections(ranked), sections), queries, embed)
    out = r.collection_output(config, ranked, told, F.lit("2024-01-01T00:00:00")).first()
    assert out.metadata.input_documents == ["book.pdf"] and out.metadata.persona == "home cook" and out.metadata.processing_timestamp == "2024-01-01T00:00:00"
    assert [x.importance_rank for x in out.extracted_sections] == [1, 2, 3]
    assert all(x.refined_text for x in out.subsection_analysis) and out.subsection_analysis[0].refined_text.startswith("Learn to cook with these basic cooking techniques.")


def test_documents_of_string_identifiers(spark):
    rows = [("file:/a/b.pdf", i, t, 1, None, z, "F", 0) for i, (t, z) in enumerate([("Cooking Basics For Home", 20.0), ("Learn basic cooking techniques here.", 10.0), ("Gardens", 20.0), ("Plants grow slowly in the shade.", 10.0)])]
    spans = spark.createDataFrame(rows, SPANS.replace("doc_id bigint", "doc_id string"))
    names = spark.createDataFrame([("file:/a/b.pdf", "C", "b.pdf")], "doc_id string, collection string, document string")
    config = spark.createDataFrame([("C", None, [("b.pdf", "B")], ("home cook",), ("learn cooking techniques",))], "collection string, " + COLLECTION)
    out = relevance(spans, names, config, F.lit("now")).first()
    assert [(x.document, x.section_title) for x in out.extracted_sections] == [("b.pdf", "Cooking Basics For Home"), ("b.pdf", "Gardens")]


def test_whole_plan(spark):
    lines = [(1, "Cooking Basics For Home", 20.0), (1, "Learn basic cooking techniques here, step by step.", 10.0), (1, "Gardens Of The World", 20.0), (1, "Plants grow slowly in the shade of trees.", 10.0)]
    spans = spark.createDataFrame([(d, i, t, 1, (0.0, 20.0 * i, 9.0, 20.0 * i + 10), z, "F", 0) for i, (d, t, z) in enumerate(lines)], SPANS)
    names = spark.createDataFrame([(1, "C", "a.pdf")], "doc_id long, collection string, document string")
    config = spark.createDataFrame([("C", None, [("a.pdf", "A")], ("home cook",), ("learn cooking techniques",))], "collection string, " + COLLECTION)
    out = relevance(spans, names, config, F.lit("now")).first()
    assert [x.section_title for x in out.extracted_sections] == ["Cooking Basics For Home", "Gardens Of The World"] and len(out.subsection_analysis) == 2


#: Text, size and font of a span beside body text of size 10, and whether it opens a section.
HEADERS = [
    ("Plain words go on here.", 10.0, "F", False), ("Plain words go on here.", 13.0, "F", True), ("Plain words go on here.", 12.0, "F", False), ("Plain words go on here.", 10.0, "F-Bold", True), ("ok", 30.0, "F-Bold", False),
    ("four", 10.0, "Heavy", False), ("x" * 151, 10.0, "F-Black", False), ("1.2 Numbered", 10.0, "F", True), ("1.2 numbered", 10.0, "F", False), ("7 Years", 10.0, "F", True), ("SHOUTED", 10.0, "F", True), ("LOUD", 10.0, "F", False),
    ("A Heading In Title Case", 10.0, "F", True), ("A Heading in Title Case", 10.0, "F", False), ("Too Short", 10.0, "F", False), ("  SHOUTED  ", 10.0, "F", True), ("   ", 30.0, "F", False),
]


def test_headers_by_hand(spark):
    rows = spark.createDataFrame([(i, t, z, n) for i, (t, z, n, _) in enumerate(HEADERS)], "i int, t string, z double, n string")
    got = rows.select("i", is_header(F.col("t"), F.col("z"), F.col("n"), F.lit(10.0)).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [h for *_, h in HEADERS]


def section_rows(spark, docs):
    rows = [(d, i, t, p, None, z, "F", None) for d, spans in docs.items() for i, (t, z, p) in enumerate(spans)]
    return [tuple(x) for x in s.sections(spark.createDataFrame(rows, SPANS)).select("doc_id", "section_title", "content", "page_number", "median_font_size").orderBy("doc_id", "seq").collect()]


def test_sections_by_hand(spark):
    got = section_rows(spark, {
        1: [("before the first", 10.0, 1), ("Large", 20.0, 1), ("one two", 10.0, 1), ("three", 10.0, 2)],
        2: [("Large", 20.0, 3), ("Larger", 30.0, 3), ("under the second", 10.0, 4), ("and on it", 10.0, 4), ("and more", 10.0, 4), ("Last", 40.0, 4)],
        3: [("no", 9.0, 1)],
        4: [("ALONE HERE", 10.0, 1)],
    })
    assert got == [(1, "Introduction", "before the first", 1, 10.0), (1, "Large", "one two three", 1, 10.0), (2, "Larger", "under the second and on it and more", 3, 15.0), (3, "Introduction", "no", 1, 12.0)]


def test_sections_keep_every_span(spark):
    """Each span is one section's title or in one section's content, and titles are headers."""
    rng = random.Random(8)
    docs = {d: [(f"w{d}x{i} " + rng.choice(["plain words", "Title Case Words Here", "of it"]), rng.choice([10.0, 10.0, 15.0]), 1 + i // 4) for i in range(rng.randint(1, 12))] for d in range(60)}
    for d, title, content, page, median in section_rows(spark, docs):
        sizes = sorted(z for _, z, _ in docs[d])
        assert min(sizes) <= median <= max(sizes) and content and page in {p for *_, p in docs[d]}
    for d, spans in docs.items():
        told = " ".join(f"{t} {c}" for k, t, c, *_ in section_rows(spark, {d: spans})) if d < 6 else None
        if told is not None:
            marks = [t.split()[0] for t, *_ in spans]
            body = [m for m in marks if m in told.split()]
            assert body == sorted(body, key=marks.index) and len(set(told.split()) & set(marks)) == len(body)


def test_header_of_no_font(spark):
    out = spark.createDataFrame([("plain text", 10.0, None)], "t string, z double, n string").select(is_header(F.col("t"), F.col("z"), F.col("n"), F.lit(12.0)).alias("h"))
    assert out.first().h is False


def test_collections_and_status(spark):
    config = spark.createDataFrame([("A", ("1", "t", "d"), [("x.pdf", "X"), ("y.pdf", "Y")], ("r",), ("t",)), ("B", None, None, None, ("t",))], "collection string, " + COLLECTION)
    listed, files = c.listed_documents(config), spark.createDataFrame([("A", "y.pdf"), ("A", "z.pdf")], "collection string, filename string")
    assert [x.filename for x in c.found_documents(listed, files).collect()] == ["y.pdf"] and [x.filename for x in c.missing_documents(listed, files).collect()] == ["x.pdf"]
    assert {x.collection: x.missing for x in c.missing_parts(config).collect()} == {"A": [], "B": ["challenge_info", "documents", "persona"]}
    runs = spark.createDataFrame([(True, 3, 2, 4.0), (False, None, 1, 1.0)], "success boolean, sections_processed int, documents_processed int, seconds double")
    assert tuple(stats.run_summary(runs).first()) == (2, 1, 1, 3, 3, pytest.approx(5 / 3), 0)
    assert stats.run_summary(runs.where("not success")).first().exit_code == 1


def test_limits():
    assert (SETTINGS.top_sections, SETTINGS.max_sentences, SETTINGS.top_sentences, SETTINGS.section_chars, SETTINGS.query_chars) == (10, 100, 10, 5000, 1000)


def test_embedder_memory_is_bounded():
    """Words that never come again are not kept."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(300)])
    tracemalloc.start()
    out = list(r.hashed_arrow(16).func(iter([texts, pa.array([], pa.string())])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in out] == [300, 0] and peak < 8_000_000
