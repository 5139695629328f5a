"""The classifier around a model: batches, softmax, faults, loading."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstruct.operators import model
from docstruct.operators.classify import classified, with_features
from docstruct.plans.outline import outline
from docstruct.sources.spans import text_spans
from tests.conftest import rows


def toy():
    """The digits of a text are its logits; other texts fail."""

    def predict(texts):
        return np.array([[float(c) for c in t] for t in texts])

    return predict


def broken():
    raise OSError("no weights")


def answers(spark, texts, load=toy, size=2):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).withColumn("text", F.col("t"))
    return {r[0]: r[1:] for r in rows(model.with_model(df, load, F.col("t"), size).select("t", "model_class", "model_confidence", "model_failed"))}


def test_answers(spark):
    found = answers(spark, ["01000", "00300", "11111", "bad!!", "0100", "", None, "00009"])
    assert found["01000"][0] == "title" and found["01000"][1] == pytest.approx(math.e / (math.e + 4)) and not found["01000"][2]
    assert found["00300"][0] == "h1" and found["00009"][0] == "h3" and found["11111"][:2] == ("text", pytest.approx(0.2))
    assert found["bad!!"] == found["0100"] == found[""] == (None, None, True) and found[None] == (None, None, False)


def test_answers_do_not_hang_on_batches(spark):
    texts = ["01000", "x", "00300", "00009", "y", "11111", "00020"]
    assert len({str(sorted(answers(spark, texts, size=n).items())) for n in (1, 2, 3, 50)}) == 1


def test_not_finite_and_not_loaded(spark):
    def odd():
        return lambda texts: np.array([[float(t), 0, 0, 0, 0] for t in texts])

    found = answers(spark, ["nan", "inf", "2000"], odd)
    assert found["nan"][2] and found["inf"][2] and found["2000"] == ("text", 1.0, False)  # no power overflows
    assert answers(spark, ["01000"], broken)["01000"] == (None, None, False)


def test_softmax(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (1.0, 2.0, 3.0))).alias("z"))
    got = df.select(model.softmax(F.col("z")).alias("p")).first().p
    want = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert got == pytest.approx(want.tolist()) and spark.range(1).select(model.likeliest(F.array().cast("array<double>")).alias("p")).first().p is None


def test_outline_with_a_model(spark):
    docs = spark.createDataFrame([(1, "First line of it\nsomething else here\nand more of the same")], "doc_id bigint, text string")

    def says():
        return lambda texts: np.array([[0, 0, 5, 0, 0] if "else" in t else [5, 0, 0, 0, 0] for t in texts])

    got = outline(text_spans(docs), model=says, compose=False).first()
    assert [(e.level, e.text) for e in got.outline] == [] and got.title.startswith("something else here")  # the only heading is the title
    plain = outline(text_spans(docs), compose=False).first()
    assert outline(text_spans(docs), model=broken, compose=False).first() == plain
    rows_ = with_features(text_spans(docs))
    assert {r.level for r in model.heading_levels(classified(rows_)).collect()} <= set(model.LABELS)
    assert rows_.select(model.hinted(rows_).alias("h")).first().h.startswith("[BOLD] [TOP_POSITION] [SHORT_TEXT] First")


def test_loading(tmp_path):
    assert model.model_fault("")[0] == "EMPTY_MODEL_PATH" and model.model_fault(str(tmp_path / "no"))[0] == "MODEL_PATH_NOT_FOUND"
    (tmp_path / "config.json").write_text("{}")
    code, message = model.model_fault(str(tmp_path))
    assert code == "MISSING_MODEL_FILES" and "tokenizer.json" in message and "'config.json'" not in message
    with pytest.raises(FileNotFoundError):
        model.onnx_model(str(tmp_path))()
    for f in model.MODEL_FILES:
        (tmp_path / f).write_text("{}")
    assert model.model_fault(str(tmp_path)) is None


def test_retries_and_limits():
    waits, calls = [], []

    def twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert model.retried(twice, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    waits.clear()
    with pytest.raises(ZeroDivisionError):
        model.retried(lambda: 1 / 0, sleep=waits.append)
    assert waits == [0.5, 1.0, 2.0]
    assert model.within(lambda: 3, 5) == 3
    with pytest.raises(TimeoutError):
        model.within(lambda: __import__("time").sleep(2), 0.05)
    with pytest.raises(ZeroDivisionError):
        model.within(lambda: 1 / 0, 5)
