"""The pipeline against its stages done plainly."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from docstruct.llm import mixing, quality
from docstruct.llm.common import cut
from tests.conftest import SMALL
from tests.llm.test_simhash import plain_similar


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = p.quality_classifier(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = sorted((r.doc_id, r.text) for r in good.collect())
    assert [i for i, _ in held] == sorted(i for i, v in scores.items() if v)
    single = p.near_duplicates(spark, good, SMALL)
    assert sorted(r.doc_id for r in single.collect()) == sorted({held[k][0] for k in plain_similar([t for _, t in held])})
    clean = p.decontamination(spark, single, SMALL)
    mixed = p.mixture(spark, clean, SMALL)
    assert all(x.columns == docs.columns for x in (good, single, clean, mixed))
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(clean).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}
    tokens = p.token_output(spark, mixed, SMALL).collect()
    assert sorted(r.doc_id for r in tokens) == sorted(i for i, n in plan.items() for _ in range(n))
    again = p.run(spark, SMALL).collect()
    assert sorted(again) == sorted(tokens)


def test_stage_list():
    assert [n for n, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"] and p.ORACLE_SQL is None


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_cases_through_all_stages(spark, tmp_path, rows):
    """Empty tables; null texts, identifiers and sources, repeated rows, a very long text and clashing columns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"size": F.lit("s"), "label": F.lit(1), "copies": F.lit(0.5), "_mix_key": F.lit(b"k"), "stays": F.lit(None).cast("string")})
    schema = docs.schema
    if rows == "none":
        docs = docs.limit(0)
    else:
        some = docs.limit(60)
        long = some.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.expr("concat_ws(' ', transform(sequence(1, 200000), i -> concat('w', i)))")})
        docs = some.union(some.limit(5)).union(some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).union(some.limit(4).withColumn("text", F.lit(None).cast("string"))).union(some.limit(9).withColumn("source", F.lit(None).cast("string")))
        docs = docs.union(long.select(docs.columns)).union(some.limit(2).withColumn("text", F.lit("")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        table = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (table.limit(0) if rows == "none" else table).write.parquet(f"{tmp_path}/{t}.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        before, left = left, cut(stage(spark, left, str(tmp_path)))
        assert [(f.name, f.dataType) for f in left.schema] == [(f.name, f.dataType) for f in schema]
        if stage is not p.mixture:
            assert left.count() <= before.count()
    tokens = p.token_output(spark, left, str(tmp_path))
    assert tokens.count() == left.count() == p.run(spark, str(tmp_path)).count()
    assert left.count() > 20 if rows == "odd" else left.count() == 0
