"""Layout, statistics, classes and outlines on fixtures, tables worked out by hand, and properties."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docstruct.operators import classify, layout, outline, stats
from docstruct.plans.outline import outline as whole
from docstruct.plans.outline import outline_json
from docstruct.plans.queries import QUERIES
from docstruct.schema import SPANS
from tests.conftest import SMALL


def spans(spark, rows):
    full = [(d, i, t, p, b, float(s), n, g) for i, (d, t, p, b, s, n, g) in enumerate(rows)]
    return spark.createDataFrame([(d, i, t, p, tuple(map(float, b)) if b else None, s, n, g) for d, i, t, p, b, s, n, g in full], SPANS)


PAGE = [(1, "Document Title", 1, (72, 100, 200, 120), 18, "Arial-Bold", 16), (1, "Chapter 1: Introduction", 1, (72, 150, 250, 165), 14, "Arial-Bold", 16), (1, "1.1 Overview", 1, (72, 200, 150, 212), 12, "Arial", 0), (1, "This is regular paragraph text with normal formatting.", 1, (72, 230, 400, 242), 10, "Arial", 0)]


def test_document_statistics(spark):
    r = stats.doc_font_stats(spans(spark, PAGE)).first()
    assert (r.total_blocks, r.total_pages, r.max_font_size, r.min_font_size, r.avg_font_size, r.median_font_size) == (4, 1, 18, 10, 13.5, 14)
    ratios = [(r.features.font_size_ratio, r.features.is_bold) for r in classify.with_features(spans(spark, PAGE)).orderBy("seq").collect()]
    assert [b for _, b in ratios] == [True, True, False, False] and all(a > b for (a, _), (b, _) in itertools.pairwise(ratios))
    assert stats.doc_font_stats(spans(spark, [(1, "x", 1, (0, 0, 0, 0), 0, "a", 0)])).first().avg_font_size == 12.0
    assert classify.basic_features(spans(spark, PAGE)).where("seq = 0").first().features.position_x == 72


GROUPS = [
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("World", 1, (55, 0, 100, 10), 12, "A", 0), "Hello World"),
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("World", 2, (0, 0, 50, 10), 12, "A", 0), None),
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("World", 1, (55, 0, 100, 10), 16, "A", 0), None),
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("World", 1, (55, 0, 100, 10), 12, "Times", 0), None),
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("Far", 1, (200, 0, 250, 10), 12, "A", 0), None),
    (("Hello", 1, (0, 0, 50, 10), 12, "A", 0), ("Below", 1, (10, 12, 60, 22), 12, "A", 0), "Hello\nBelow"),
]


@pytest.mark.parametrize("a, b, joined", GROUPS)
def test_grouping(spark, a, b, joined):
    out = layout.merged_blocks(layout.grouped_blocks(spans(spark, [(1, *a), (1, *b)]))).orderBy("seq").collect()
    assert [r.text for r in out] == ([joined] if joined else [a[0], b[0]])
    if joined == "Hello\nBelow":
        assert tuple(out[0].bbox) == (0, 0, 60, 22)


def test_groups_restore_the_text(spark):
    """Groups are runs of the reading order of one page, size class, font and flags, and their texts joined are the document."""
    rng, rows = random.Random(4), []
    for d in range(60):
        for i in range(rng.randint(1, 14)):
            x, y = rng.choice([0, 40, 55, 60]), rng.choice([0, 1, 2, 10, 11, 12, 24])
            rows.append((d, i, f"t{i}", rng.randint(1, 2), (float(x), float(y), x + 50.0, y + 10.0), rng.choice([10.0, 10.5, 12.0]), rng.choice("AAAB"), rng.choice([0, 0, 16])))
    table = spark.createDataFrame(rows, SPANS)
    placed = {(r.doc_id, r.seq): r.place for r in layout.sorted_blocks(table).collect()}
    grouped = layout.grouped_blocks(table)
    members = {}
    for r in grouped.collect():
        members.setdefault((r.doc_id, r.group_id), []).append(r)
    for group in members.values():
        places = sorted(placed[r.doc_id, r.seq] for r in group)
        assert places == list(range(places[0], places[0] + len(places)))
        assert len({(r.page_number, r.font_name, r.font_flags) for r in group}) == 1 and sum(r.gap == "" for r in group) == 1
    for d in range(60):
        numbers = sorted(k for e, k in members if e == d)
        assert numbers == list(range(1, len(numbers) + 1))
    texts = {}
    for r in layout.merged_blocks(grouped).orderBy("doc_id", "seq").collect():
        texts.setdefault(r.doc_id, []).extend(r.text.split())
    assert texts == {d: [f"t{k}" for k in sorted((r[1] for r in rows if r[0] == d), key=lambda k: placed[d, k])] for d in range(60)}
    assert any(len(g) > 1 for g in members.values())


def test_validity_and_preprocessing(spark):
    rows = spans(spark, [(1, t, 1, (0, 40 * i, 90, 40 * i + 10), s, "A", 0) for i, (t, s) in enumerate([("Valid text", 12), ("", 12), ("   ", 12), ("AB", 12), ("Sized", 0)])])
    assert [r.text for r in layout.valid_blocks(rows).collect()] == ["Valid text"]
    page = spans(spark, [(1, t, 1, (72, y, 300, y + 12), s, n, g) for t, y, s, n, g in [("DOCUMENT TITLE", 50, 18, "B", 16), ("Chapter 1: Introduction", 100, 14, "B", 16), ("Regular text here", 150, 12, "A", 0), ("• First bullet point", 200, 12, "A", 0), ("1) First numbered item", 250, 12, "A", 0)]])
    out = [r.text for r in layout.preprocess(page).orderBy("seq").collect()]
    assert len(out) == 5 and out[-1] == "1. First numbered item"


def test_repair(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1, (1.0, None, 2.0, 3.0), None, None, None), (1, 1, "b", 60, None, 0.2, "f", 1), (1, 2, "c", 2, None, 0.2, "f", 1)], SPANS)
    out = layout.repair(rows).orderBy("seq").collect()
    assert [(r.seq, tuple(r.bbox), r.font_size, r.font_name, r.font_flags) for r in out] == [(0, (0, 0, 0, 0), 12.0, "unknown", 0), (2, (0, 0, 0, 0), 1.0, "f", 1)]


#: Levels as they come, and as an outline shows them.
LEVELS = [
    ("H1", "H1"), ("H2", "H1"), ("H3", "H1"), ("H1 H2 H3", "H1 H2 H3"), ("H1 H3", "H1 H2"), ("H1 H3 H3", "H1 H2 H3"), ("H2 H2", "H1 H2"), ("H2 H3 H3", "H1 H2 H3"), ("H3 H3 H3", "H1 H2 H3"), ("H3 H1 H3", "H1 H1 H2"),
    ("H1 H2 H1 H3", "H1 H2 H1 H3"), ("title H3 H2", "title H1 H2"), ("H1 title H3", "H1 title H2"), ("title", "title"), ("H1 H1 H3 H2 H3", "H1 H1 H2 H2 H3"),
]


def progressed(spark, sequences):
    rows = [(d, i, 1, f"{i:03d}", x) for d, levels in enumerate(sequences) for i, x in enumerate(levels)]
    out = [[] for _ in sequences]
    for r in outline.progressed(spark.createDataFrame(rows, "doc_id long, seq int, page_number int, text string, level string")).orderBy("doc_id", "seq").collect():
        out[r.doc_id].append(r.level)
    return out


def test_progression_by_hand(spark):
    assert progressed(spark, [a.split() for a, _ in LEVELS]) == [b.split() for _, b in LEVELS]


def test_progression_of_all_short_sequences(spark):
    """No level is skipped, none goes deeper than it was, H1 and titles stay, and titles change nothing for the rest."""
    sequences = [list(x) for n in range(1, 6) for x in itertools.product(("H1", "H2", "H3", "title"), repeat=n)]
    got = dict(zip(map(tuple, sequences), progressed(spark, sequences), strict=True))
    for raw, out in got.items():
        deep = [(int(a[1]), int(b[1])) for a, b in zip(raw, out, strict=True) if a != "title"]
        assert [b for a, b in zip(raw, out, strict=True) if a == "title"] == ["title"] * raw.count("title")
        assert all(b <= a for a, b in deep) and all(b == 1 for a, b in deep if a == 1) and (not deep or deep[0][1] == 1)
        shown = [b for _, b in deep]
        assert all(2 in shown[:k] for k, b in enumerate(shown) if b == 3)
        rest = tuple(a for a in raw if a != "title")
        assert not rest or [b for b in out if b != "title"] == got[rest]


CLASSED = "doc_id long, seq int, text string, predicted_class string, confidence double, page_number int, features struct<position_y:double>"


def test_structure_and_single_steps_agree(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.choice(["Alpha", " Beta", "Gamma", "Delta ", ""]), rng.choice(["title", "h1", "h2", "h3", "text"]), rng.choice([0.2, 0.5, 0.9]), rng.randint(1, 3), (rng.random(),)) for d in range(150) for i in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, CLASSED)
    found = outline.headings(table.withColumn("position_y", F.col("features.position_y")))
    title = outline.titles(found)
    steps = outline.outlines(table, title, outline.progressed(outline.without_title(found, title)))
    assert sorted(map(str, outline.structure(table).collect())) == sorted(map(str, steps.collect()))


def test_title_ties_and_largest(spark):
    rows = spark.createDataFrame([(1, 0, "First", "title", 0.8, 1, (0.5,)), (1, 1, "Second", "title", 0.8, 1, (0.1,)), (2, 0, "Low", "h1", 0.9, 2, (0.0,)), (2, 1, "Top", "h2", 0.3, 1, (0.9,)), (3, 0, "t", "text", 0.9, 1, (0.9,))], CLASSED)
    assert {r.doc_id: r.title for r in outline.structure(rows).collect()} == {1: "First", 2: "Top", 3: "Untitled Document"}
    sized = spark.createDataFrame([(1, 0, "a", 1, 2.0), (1, 1, "b", 1, 2.0), (1, 2, "c", 2, 3.0)], "doc_id long, seq int, text string, page_number int, font_size_ratio double")
    assert outline.largest_on_first_page(sized).first().title == "a"


def test_whole_outline_of_a_long_document(spark):
    rows = []
    for p in range(1, 51):
        y = 72
        for text, size, flags in ([("The Great Title of It", 24, 16)] if p == 1 else []) + ([(f"Chapter {p // 10 + 1}", 18, 16)] if p % 10 == 1 else []) + ([(f"{p}. Section", 14, 16)] if p % 5 == 1 else []) + [("Body text goes on for a while in this line, and further on.", 10, 0)]:
            rows.append((7, text, p, (72, y, 300, y + size), size, "F", flags))
            y += 60
    r = whole(spans(spark, rows)).first()
    assert r.title == "The Great Title of It" and [e.level for e in r.outline][0] == "H1" and len(r.outline) == 15
    assert [(e.page, e.text) for e in r.outline] == sorted((e.page, e.text) for e in r.outline)
    assert '"title":"The Great Title of It"' in outline_json(spans(spark, rows)).first().json


def test_validator(spark):
    form = "title string, outline array<struct<level:string,text:string,page:int>>"
    rows = [("t", [("H1", "x", 1)]), ("t", []), (None, []), ("t", None), ("t", [("H4", "x", 1)]), ("t", [("H1", " ", 1)]), ("t", [("H1", "x", 0)]), ("t", [(None, "x", 1)])]
    got = [r.v for r in spark.createDataFrame(rows, form).select(outline.is_valid(F.col("title"), F.col("outline")).alias("v")).collect()]
    assert got == [True, True, False, False, False, False, False, False]


def test_salvage_and_keys(spark):
    form = "outline array<struct<level:string,text:string,page:int>>"
    out = spark.createDataFrame([([("H1", "x" * 300, None)] * 9,)], form).select(outline.salvaged_outline(F.col("outline")).alias("o")).first().o
    assert len(out) == 5 and len(out[0].text) == 200 and out[0].page == 1
    assert outline.missing_keys(spark.createDataFrame([(["title"],)], "k array<string>"), "k", ("title", "outline")).first().missing == ["outline"]


def test_plan_has_one_exchange(spark):
    plan = whole(spans(spark, PAGE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["cls_title_rule", "fea_hints"])
def test_features_that_nothing_reads_are_not_computed(spark, name):
    """The case scores cost most of all features."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "capitalization_score" in plan and not any(k in plan for k in ("all_caps_score", "title_case_score", "whitespace_above"))
