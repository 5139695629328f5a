"""Queries over the tables, one for each operator family; their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions import features as f
from docstruct.functions import rules, text
from docstruct.operators import classify, collections, layout, model, outline, relevance, sections, stats
from docstruct.plans.outline import classify_spans
from docstruct.plans.outline import outline as whole_outline
from docstruct.plans.relevance import document_sections
from docstruct.schema import SETTINGS
from docstruct.sources import spans as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Slots of the hashed vectors in queries.
DIM = 64
ROLE, TASK = "Reader of the news", "Find what is in the text and that it was with them"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return src.table(spark, d, name)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return src.text_spans(table(spark, d, "documents"))


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return src.numbered_spans(table(spark, d, "documents"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return src.order_spans(table(spark, d, "lineitem"), table(spark, d, "part"))


def flat(df: DataFrame) -> list[Column]:
    return [F.col(f"bbox.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# text


@query
def flt_valid_blocks(spark, d):
    return layout.valid_blocks(lines(spark, d)).select("doc_id", "seq", "text", "font_size")


@query
def prj_repair(spark, d):
    rows = lines(spark, d).withColumns({"font_size": F.when(F.col("seq") % 3 > 0, F.col("font_size") / 30), "font_name": F.when(F.col("seq") % 5 > 0, F.col("font_name")), "bbox": F.when(F.col("seq") % 7 > 0, F.col("bbox"))})
    done = layout.repair(rows)
    return done.select("doc_id", "seq", "page_number", r6("font_size").alias("font_size"), "font_name", "font_flags", *flat(done))


@query
def txt_collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_encoding(F.col("text")).alias("text"))


@query
def txt_whitespace(spark, d):
    t = F.regexp_replace("text", r"\. ", ".  \t\n \n")
    return table(spark, d, "documents").select("doc_id", text.normalize_whitespace(t).alias("text"))


@query
def txt_clean(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"\.", "!!!!!"), ",", ",-,-" + chr(7))
    return table(spark, d, "documents").select("doc_id", text.clean(t).alias("text"))


@query
def txt_bullets_numbers(spark, d):
    t = F.concat(F.when(F.col("seq") % 3 == 0, F.concat(F.col("seq").cast("string"), F.lit(")"))).when(F.col("seq") % 3 == 1, "▪ ").otherwise("7.2  "), "text")
    return lines(spark, d).select("doc_id", "seq", text.special_cases(t).alias("text"))


@query
def txt_normalize(spark, d):
    return numbered(spark, d).select("doc_id", "seq", text.normalize(F.col("text")).alias("text"))


@query
def txt_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"), 100)).alias("place", "sentence"))


@query
def txt_query_section(spark, d):
    q = text.query_text(F.col("source"), F.nullif(F.col("lang"), F.lit("en")))
    return table(spark, d, "documents").select("doc_id", q.alias("query"), text.section_text(F.col("source"), F.col("text"), SETTINGS.section_chars).alias("section"))


@query
def txt_paths(spark, d):
    return table(spark, d, "pages").select("page_id", text.basename(F.col("url")).alias("basename"), text.stem(F.col("url")).alias("stem"))


# statistics


@query
def agg_doc_font_stats(spark, d):
    rows = stats.doc_font_stats(orders(spark, d))
    return rows.select("doc_id", r6("avg_font_size").alias("avg_font_size"), "max_font_size", "min_font_size", "median_font_size", r6("std_font_size").alias("std_font_size"), "total_blocks", "total_pages")


@query
def agg_top_fonts(spark, d):
    rows = orders(spark, d).withColumn("seq", 10 * F.col("doc_id") + F.col("seq")).withColumn("doc_id", F.col("doc_id") % 500)
    return stats.top_fonts(rows)


@query
def agg_page_extents(spark, d):
    return stats.page_extents(lines(spark, d))


@query
def agg_true_median(spark, d):
    return stats.true_median(orders(spark, d))


@query
def agg_level_counts(spark, d):
    return stats.level_counts(outline.headings(classify_spans(numbered(spark, d))))


@query
def agg_structure_metadata(spark, d):
    return stats.structure_metadata(classify_spans(numbered(spark, d)))


# features


@query
def fea_font(spark, d):
    own = classify.font_features()
    rows = classify.with_statistics(orders(spark, d))
    return rows.select("doc_id", "seq", *[(c if k.startswith("is_") else r6(c)).alias(k) for k, c in own.items()])


@query
def fea_position(spark, d):
    rows = classify.with_statistics(lines(spark, d))
    return rows.select("doc_id", "seq", *[r6(c).alias(k) for k, c in classify.position_features().items()])


@query
def fea_content(spark, d):
    own = {k: c for k, c in classify.content_features().items() if k not in ("title_case_score", "all_caps_score")}
    return numbered(spark, d).select("doc_id", "seq", *[(r6(c) if k.endswith(("ratio", "score", "density")) else c).alias(k) for k, c in own.items()])


@query
def fea_case(spark, d):
    own = classify.content_features()
    return numbered(spark, d).select("doc_id", "seq", r6(own["title_case_score"]).alias("title_case_score"), r6(own["all_caps_score"]).alias("all_caps_score"))


@query
def fea_basic(spark, d):
    rows = classify.basic_features(lines(spark, d)).select("doc_id", "seq", "features.*")
    return rows.select("doc_id", "seq", r6("font_size_ratio").alias("font_size_ratio"), "is_bold", "is_italic", "position_x", "position_y", "text_length", r6("capitalization_score").alias("capitalization_score"), r6("whitespace_ratio").alias("whitespace_ratio"))


@query
def fea_hints(spark, d):
    rows = classify.with_features(lines(spark, d), names=classify.HINT_FEATURES)
    g = F.col("features")
    return rows.select("doc_id", "seq", f.hints(F.col("text"), g["font_size_ratio"], g["is_bold"], g["is_italic"], g["position_y"], g["capitalization_score"], g["text_length"]).alias("hinted"))


# layout


@query
def lay_sort(spark, d):
    return layout.sorted_blocks(orders(spark, d)).select("doc_id", "seq", "place")


@query
def lay_group(spark, d):
    return layout.grouped_blocks(orders(spark, d)).select("doc_id", "seq", "group_id", "gap")


@query
def lay_merge(spark, d):
    rows = layout.merged_blocks(layout.grouped_blocks(lines(spark, d)))
    return rows.select("doc_id", "seq", "text", "page_number", *flat(rows), "font_size", "font_name", "font_flags", "n_spans")


# rules


@query
def cls_numbered(spark, d):
    return numbered(spark, d).select("doc_id", "seq", rules.is_numbered(F.col("text")).alias("numbered"))


@query
def cls_level(spark, d):
    return numbered(spark, d).select("doc_id", "seq", rules.numbering_level(F.col("text")).alias("level"))


def _ruled(rows: DataFrame) -> Column:
    g = F.col("features")
    return rules.classify(F.col("text"), g["font_size_ratio"], g["is_bold"], g["text_length"])


@query
def cls_rules(spark, d):
    rows = classify.with_features(numbered(spark, d), names=classify.RULE_FEATURES)
    return rows.select("doc_id", "seq", _ruled(rows).alias("r")).select("doc_id", "seq", "r.*")


@query
def cls_text_only(spark, d):
    return numbered(spark, d).select("doc_id", "seq", rules.classify_text_only(F.col("text")).alias("r")).select("doc_id", "seq", "r.*")


@query
def cls_title_rule(spark, d):
    rows = classify.with_features(lines(spark, d), names=classify.TITLE_FEATURES)
    g = F.col("features")
    return rows.select("doc_id", "seq", rules.is_title_block(F.col("text"), g["font_size_ratio"], g["position_x"], g["position_y"], g["text_length"], g["capitalization_score"]).alias("is_title"))


@query
def cls_cascade(spark, d):
    k = (F.col("doc_id") + F.col("seq")) % 7
    rows = classify.with_features(numbered(spark, d), names=classify.RULE_FEATURES).withColumns({"model_class": F.when(k == 0, F.lit(None)).when(k < 3, "title").when(k < 5, "h2").otherwise("text"), "model_confidence": F.element_at(F.array(*map(F.lit, (0.9, 0.995, 0.7, 0.3, 0.8, 0.5, 0.49))), (k + 1).cast("int")), "model_failed": k == 6})
    return classify.classified(rows).select("doc_id", "seq", "predicted_class", "confidence")


def _toy_model() -> model.Predict:
    """Logits from the length of a text, in elevenths; one text in thirteen fails."""
    import numpy as np

    def predict(texts: list[str]) -> np.ndarray:
        if any(len(t) % 13 == 7 for t in texts):
            raise ValueError("no answer")
        return np.array([[(len(t) * (j + 3)) % 11 / 2 for j in range(5)] for t in texts])

    return predict


@query
def cls_model(spark, d):
    rows = classify.with_features(numbered(spark, d), names=classify.RULE_FEATURES)
    rows = classify.classified(model.with_model(rows, _toy_model, F.col("text")))
    return rows.select("doc_id", "seq", "model_class", r6("model_confidence").alias("model_confidence"), "model_failed", "predicted_class", r6("confidence").alias("confidence"))


@query
def cls_levels(spark, d):
    rows = classify.with_features(numbered(spark, d), names=classify.RULE_FEATURES)
    return model.heading_levels(classify.classified(rows.withColumns({"model_class": F.lit(None).cast("string"), "model_confidence": F.lit(None).cast("double"), "model_failed": F.lit(False)})))


# outline


def _headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines with classes and confidences from arithmetic, so that each level, titles and ties come up."""
    k = (F.col("doc_id") * 31 + F.col("seq") * 7) % 11
    rows = lines(spark, d).where(F.length(text.strip(F.col("text"))) > 0)
    rows = rows.withColumns({"predicted_class": F.when(k == 0, "title").when(k < 3, "h1").when(k < 6, "h2").when(k < 9, "h3").otherwise("text"), "confidence": (k % 4).cast("double") / 4, "position_y": F.col("bbox.y0"), "font_size_ratio": F.col("font_size") / 11})
    return outline.headings(rows)


@query
def out_title(spark, d):
    return outline.titles(_headings(spark, d))


@query
def out_largest_font(spark, d):
    return outline.largest_on_first_page(_headings(spark, d))


@query
def out_filter_title(spark, d):
    found = _headings(spark, d)
    return outline.without_title(found, outline.titles(found)).select("doc_id", "seq", "level", "text")


@query
def out_progression(spark, d):
    return outline.progressed(_headings(spark, d)).select("doc_id", "seq", "level", "page_number", "text")


@query
def out_outline(spark, d):
    rows = whole_outline(numbered(spark, d))
    return rows.select("doc_id", "title", F.posexplode_outer("outline").alias("place", "e")).select("doc_id", "title", F.coalesce("place", F.lit(-1)).alias("place"), "e.level", "e.text", F.coalesce("e.page", F.lit(0)).alias("page"))


@query
def out_json(spark, d):
    """The JSON read again, so that both sides hold values and not their spelling."""
    rows = whole_outline(numbered(spark, d)).select("doc_id", outline.as_json(F.col("title"), F.col("outline")).alias("json"))
    form = "title string, outline array<struct<level:string,text:string,page:int>>"
    rows = rows.select("doc_id", F.from_json("json", form).alias("j"))
    return rows.select("doc_id", F.col("j.title").alias("title"), F.size("j.outline").alias("entries"), F.array_join(F.transform("j.outline", lambda e: F.concat_ws("|", e["level"], e["page"].cast("string"), e["text"])), ";").alias("joined"))


@query
def out_validate(spark, d):
    found = _headings(spark, d).withColumns({"level": F.when(F.col("seq") % 19 == 5, "H4").otherwise(F.col("level")), "page": F.when(F.col("seq") % 23 == 7, 0).otherwise(F.col("page_number"))})
    rows = found.where("level <> 'title'").groupBy("doc_id").agg(F.collect_list(F.struct("level", "text", "page")).alias("outline"))
    return rows.select("doc_id", outline.is_valid(F.when(F.col("doc_id") % 13 > 0, "t"), F.col("outline")).alias("valid"))


@query
def out_salvage(spark, d):
    return outline.salvaged_blocks(lines(spark, d))


# sections


@query
def sec_header(spark, d):
    return sections.with_headers(lines(spark, d)).select("doc_id", "seq", "median_font_size", "is_header")


@query
def sec_sections(spark, d):
    return sections.sections(lines(spark, d))


@query
def sec_pages(spark, d):
    return sections.sections(src.page_spans(table(spark, d, "pages")))


# relevance


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    return rows, rows.groupBy("collection").agg(F.min_by("vector", "seq").alias("vector"))


@query
def rel_cosine(spark, d):
    rows, asked = _vectors(spark, d)
    rows = rows.join(asked.select("collection", F.col("vector").alias("query")), "collection")
    return rows.select("collection", "seq", r6(relevance.cosine(F.col("query"), F.col("vector"))).alias("similarity"))


@query
def rel_rank(spark, d):
    return relevance.rank_vectors(*_vectors(spark, d)).select("collection", "seq", "importance_rank", r6("similarity").alias("similarity"))


@query
def rel_topk(spark, d):
    return relevance.top_sections(relevance.rank_vectors(*_vectors(spark, d))).select("collection", "seq", "importance_rank")


@query
def rel_lookup_first(spark, d):
    rows = sections.sections(lines(spark, d)).select((F.col("doc_id") % 10).alias("collection"), (F.col("doc_id") % 40).alias("document"), (F.col("doc_id") * 1000 + F.col("seq")).alias("seq"), "section_title", "page_number", "content")
    return relevance.first_match(rows.drop("content"), rows).select("seq", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query
def rel_hashed_embed(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(relevance.hashed_arrow(DIM)(F.col("text"))).alias("slot", "weight"))
    return rows.where("weight > 0").select("doc_id", "slot", r6("weight").alias("weight"))


def _collections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("collection")).distinct()
    return rows.select("collection", F.array().cast("array<struct<filename:string,title:string>>").alias("documents"), F.struct(F.lit(ROLE).alias("role")).alias("persona"), F.struct(F.lit(TASK).alias("task")).alias("job_to_be_done"))


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document"))
    found = document_sections(lines(spark, d), names)
    return found, relevance.rank_sections(found, _collections(spark, d), relevance.hashed_arrow(DIM))


@query
def rel_sections(spark, d):
    return _ranked(spark, d)[1].select("collection", "document", "section_title", "importance_rank", "page_number", r6("similarity").alias("similarity"))


@query
def rel_sentences(spark, d):
    found, ranked = _ranked(spark, d)
    embed = relevance.hashed_arrow(DIM)
    asked = _collections(spark, d).select("collection", embed(F.lit(f"{ROLE} {TASK}")).alias("vector"))
    rows = relevance.top_sentences(relevance.first_match(relevance.top_sections(ranked), found), asked, embed)
    return rows.select("collection", "importance_rank", "document", "page_number", "refined_text", "sentence_count", r6("avg_similarity").alias("avg_similarity"))


@query
def rel_output(spark, d):
    """The whole output as JSON, read again: counts and the heads of both lists."""
    found, ranked = _ranked(spark, d)
    embed = relevance.hashed_arrow(DIM)
    asked = _collections(spark, d).select("collection", embed(F.lit(f"{ROLE} {TASK}")).alias("vector"))
    told = relevance.top_sentences(relevance.first_match(relevance.top_sections(ranked), found), asked, embed)
    rows = relevance.collection_output(_collections(spark, d), ranked, told, F.lit("2024-01-01T00:00:00"))
    return rows.select("collection", F.col("metadata.persona").alias("persona"), F.size("extracted_sections").alias("sections"), F.size("subsection_analysis").alias("analysed"), F.col("extracted_sections")[0]["section_title"].alias("first_title"), F.md5(F.col("subsection_analysis")[0]["refined_text"].cast("binary")).alias("first_refined_md5"))


# configuration and status


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    listed = table(spark, d, "documents").select((F.col("doc_id") % 25).alias("collection"), F.col("doc_id").alias("place"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return listed, listed.where("place % 3 > 0 or place % 5 = 0")


@query
def cfg_found(spark, d):
    return collections.found_documents(*_listed(spark, d)).select("collection", "place", "filename")


@query
def cfg_missing(spark, d):
    return collections.missing_documents(*_listed(spark, d)).select("collection", "place", "filename")


@query
def cfg_required_keys(spark, d):
    k = F.col("doc_id")
    keys = F.filter(F.array(*[F.when(k % m > 0, F.lit(n)) for m, n in ((2, "challenge_info"), (3, "documents"), (5, "persona"), (7, "job_to_be_done"))]), lambda x: x.isNotNull())
    rows = outline.missing_keys(table(spark, d, "documents").select("doc_id", keys.alias("keys")), "keys", collections.REQUIRED)
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(F.col("event_type").alias("operation"), v.alias("duration"), (F.col("user_id") % 50).cast("double").alias("memory_before"), ((F.col("user_id") * 7) % 300).cast("double").alias("memory_after"), ((F.col("user_id") * 13) % 700).cast("double").alias("memory_peak"), "event_id")


@query
def sts_profile(spark, d):
    rows = stats.operation_profile(_runs(spark, d))
    return rows.select("operation", "n", *[r6(c).alias(c) for c in ("total_duration", "max_duration", "min_duration", "avg_duration", "total_memory_used", "avg_memory_used", "max_memory_peak")])


@query
def sts_bottlenecks(spark, d):
    return stats.bottlenecks(_runs(spark, d), share=0.15).select("kind", "operation", r6("value").alias("value"))


@query
def sts_recommendations(spark, d):
    return stats.recommendations(stats.operation_profile(_runs(spark, d)))


@query
def sts_error_counts(spark, d):
    return stats.error_counts(table(spark, d, "events").select(F.col("event_type").alias("context"), (F.col("user_id") % 4).cast("string").alias("error_type")))


@query
def sts_summary(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select((k % 4 > 0).alias("success"), (k % 9).alias("sections_processed"), (k % 3).alias("documents_processed"), (k % 8).cast("double").alias("seconds"))
    return stats.run_summary(rows).withColumn("seconds_per_document", r6("seconds_per_document"))


@query
def sts_error_docs(spark, d):
    kinds = F.array(*map(F.lit, outline.FAILURES))
    rows = table(spark, d, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"), F.lit("OSError").alias("error_type"), F.concat(F.lit("failed "), F.col("source")).alias("message"))
    return outline.failure_output(rows).select("doc_id", "title", F.col("error.type").alias("type"), F.col("error.message").alias("message"), F.col("error.details").alias("details"))


@query
def sts_coded_errors(spark, d):
    kinds = F.array(*map(F.lit, ("pdf", "model", "output", "timeout", "validation")))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit(".pdf")).alias("path"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"), F.lit("broken").alias("message"), F.when(F.col("doc_id") % 2 == 0, "EMPTY_FILE").alias("error_code"), F.lit(10).alias("limit"))
    return outline.coded_failure_output(rows, F.lit(0.0)).select("doc_id", "title", F.col("error.type").alias("type"), F.col("error.message").alias("message"), F.col("error.details").alias("details"), F.col("error.error_code").alias("error_code"), F.coalesce("error.timeout_limit", F.lit(0)).alias("timeout_limit"))


@query
def sts_empty_stages(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return outline.empty_stage_errors(docs, {"parse": docs.where("doc_id % 7 > 0"), "preprocess": docs.where("doc_id % 5 > 0"), "classify": docs.where("doc_id % 3 > 0")})
