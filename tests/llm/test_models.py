"""Quality and toxicity classifiers: held-out accuracy and cases."""

import zlib

import numpy as np
import pytest

from docstruct.llm import quality, toxicity
from docstruct.llm.common import held_out
from docstruct.llm.training import labelled_ids
from tests.conftest import MEDIUM

SCHEMA, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


def scored(spark, module, label, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = module.score(docs, module.train(docs, labels)).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    return out.merge(labels.toPandas(), on="doc_id").query("held_out").rename(columns={label: "y"})


def test_quality_held_out(spark):
    out = scored(spark, quality, "quality", LARGE)
    assert auc(out.score.to_numpy(), out.y.to_numpy()) > 0.97
    assert ((out.predicted == out.y).mean() > 0.95) and (out[out.y == 1].predicted.mean() > 0.97)


def test_toxicity_held_out(spark):
    out = scored(spark, toxicity, "toxic", LARGE)
    assert auc(out.score.to_numpy(), out.y.to_numpy()) > 0.97
    assert (out[out.y == 0].predicted.mean() < 0.01) and (out[out.y == 1].predicted.mean() > 0.8)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    trees = quality.grow(x[:2000], y[:2000], trees=40)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    assert trees.log_odds(x[:20]) == pytest.approx([walk(r) for r in x[:20]])
    assert quality.grow(x[:5], np.ones(5)).score(x).min() > 0.5


@pytest.mark.parametrize("module", [quality, toxicity])
def test_cases(spark, module):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "word " * 200_000, 7), (None, "a b", 7), (3, "a b", 7), (3, "a b", 7)], SCHEMA + ", score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (99, 1, 1)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for known in (labels, none):
        out = module.score(docs, module.train(docs, known)).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in module.score(docs, module.train(docs, none)).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert module.score(empty, module.train(empty, labels)).count() == 0


def test_sample_is_bounded_and_keeps_from_held_out(spark):
    labels = spark.createDataFrame([(i, i % 3 == 0, i % 10 == 0) for i in range(2000)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic")
    ids, counts = labelled_ids(labels, "toxic", 50, by_class=True)
    found = ids.collect()
    assert sum(r._label for r in found) == 50 and len(found) == 100 and sum(counts.values()) == labels.where(~held_out("doc_id")).count()
    assert all(zlib.crc32(str(r._id).encode()) % 5 for r in found)
    assert found == labelled_ids(labels, "toxic", 50, by_class=True)[0].collect()


def test_keep_good_keeps_columns(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    trees = quality.train(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    kept = quality.keep_good(docs, trees)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, trees).where("predicted = 1").collect()}


def test_parts_of_long_texts_meet(monkeypatch):
    text = ("abc defg hij " * 50).encode()
    whole = set(toxicity.buckets(text).tolist())
    monkeypatch.setattr(toxicity, "_PART", 64)
    assert set(toxicity.buckets(text).tolist()) == whole


def plain_buckets(text):
    line, out = b" " + b" ".join(text.lower().split()) + b" ", set()
    for i in range(len(line)):
        h = 0
        for n in range(1, 7):
            if i + n > len(line):
                break
            h = (h * 0x01000193 + line[i + n - 1] + 1) % 2**32
            if n >= 3:
                x = h * 0x9E3779B1 % 2**32
                out.add((x ^ x >> 15) * 0x85EBCA77 % 2**32 >> 12)
    return out


def test_toxicity_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((r.doc_id, known[r.doc_id], plain_buckets((r.text or "").encode())) for r in docs.collect() if r.doc_id in known)
    n1 = sum(y for _, y, _ in rows)
    a, b = np.zeros((2, toxicity.BUCKETS), np.int64)
    for _, y, x in rows:
        (a if y else b)[list(x)] += 1
    top, ratio = toxicity.choose(a, b, n1, len(rows) - n1)
    place = {int(v): k for k, v in enumerate(top)}
    want = toxicity.fit([np.array(sorted(place[v] for v in x if v in place), "<i2") for _, _, x in rows], np.array([y for _, y, _ in rows], float), top, ratio, n1 / len(rows))
    model = toxicity.train(docs, labels)
    assert (model.slot == want.slot).all() and np.allclose(model.weight, want.weight) and abs(model.bias - want.bias) < 1e-9 and len(top) > 50
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(150).collect():
        at = model.bias + sum(model.weight[place[v]] for v in plain_buckets((r.text or "").encode()) if v in place)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-at)), abs=1e-9)


def test_quality_against_a_plain_walk(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, trees).collect()}
    for r in docs.limit(200).collect():
        x, total = quality.statistics((r.text or "").encode()), trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (x[f[node]] > t[node])
            total += leaf[node - len(f)]
        p = 1 / (1 + np.exp(-total))
        assert got[r.doc_id] == (pytest.approx(p, abs=1e-9), int(p >= 0.3))


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, quality.statistics(b"One two two!\nx|Y 12\n\n"), strict=True))
    assert x["log_bytes"] == pytest.approx(np.log(22)) and x["log_words"] == pytest.approx(np.log(6)) and x["word_mean"] == pytest.approx(15 / 5)
    assert (x["distinct"], x["top"], x["lines"]) == (1.0, 0.2, pytest.approx(np.log(3))) and x["upper"] == pytest.approx(2 / 21) and x["digit"] == pytest.approx(2 / 21)
    assert x["bang"] == pytest.approx(1 / 21) and x["bar"] == pytest.approx(1 / 5) and x["capital_words"] == pytest.approx(1 / 5) and x["short_lines"] == 1.0
