import duckdb
import pytest

from docstruct.llm import mixing
from tests.conftest import MEDIUM

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, weights, total, most=2):
    """Targets by handing the excess out again until none is above."""
    targets, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        left = total - sum(targets[s] for s in sizes if s not in open_)
        now = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if now[s] > most * sizes[s]}
        targets |= now | {s: most * sizes[s] for s in over}
        if not over:
            break
        open_ -= over
    return targets


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000}, {"a": 1000, "b": 10, "c": 5, "d": 0}, {"a": 7}, {"a": 50, "b": 50, "c": 50, "d": 5000, None: 20}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(want)


def test_mix(spark):
    data = [(i, "w " * (1 + i % 40), f"s{i % 7 if i % 3 else 0}") for i in range(4000)] + [(None, "x y", None), (1, None, "s1"), (2, "", "s2"), (7, "a b\x0bc d", "s0"), (7, "a b\x0bc d", "s0")]
    docs = spark.createDataFrame([(*r, 1) for r in data], SCHEMA + ", target int")
    out = mixing.mix_digest(docs).toPandas()
    assert len(out) == len(data) and (out.taken <= 2 * out["size"]).all() and out[(out.doc_id == 7) & (out["size"] == 4)].shape[0] == 2
    by = out.groupby("source_size").agg({"taken": "sum", "target": "first"})
    assert (abs(by.taken - by.target) <= 0.1 * by.target + 45).all()
    again = mixing.mix_digest(docs).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.selectExpr(r"sum(size(filter(split(text, '[ \\x09-\\x0D]+'), x -> x <> '')))").first()[0] == out.taken.sum()


def test_empty(spark):
    assert mixing.mix_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.emit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{MEDIUM}/documents.parquet'")
    want = con.sql(mixing.MIX_SQL).fetchall()
    got = mixing.mix_digest(spark.read.parquet(f"{MEDIUM}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(want) == sorted(tuple(r) for r in got.collect())


def test_no_python_in_the_plan(spark):
    plan = mixing.mix_digest(spark.read.parquet(f"{MEDIUM}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_many_sources_by_range(spark):
    names = [f"{chr(97 + i % 26)}{i}é" for i in range(700)] + [None, "", "Z", "\U0001f600"]
    sizes = spark.createDataFrame([(n, 1 + i % 9) for i, n in enumerate(names)] * 2, "source string, size long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.nth, r.source, r.source_size) for r in mixing.ranked_sources(sizes).collect())
        targets = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    size = {n: 2 * (1 + i % 9) for i, n in enumerate(names)}
    assert got == [(i, n, size[n]) for i, n in enumerate(order)]
    assert targets == pytest.approx(filled(size, {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values())))


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ab " * 700_000, "a"), (2, "x", "b")], SCHEMA)
    assert {r.doc_id: r["size"] for r in mixing.mix_digest(docs).collect()} == {1: 700_000, 2: 1}
