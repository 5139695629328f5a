"""Classes of blocks by a model. The tokenizer and the network are an argument; batches, softmax and faults are here."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.functions.features import hints

# The classes in the order of a model's outputs, and the files of a model's folder.
LABELS = ("text", "title", "h1", "h2", "h3")
MODEL_FILES = ("config.json", "tokenizer.json", "tokenizer_config.json")

T = TypeVar("T")
#: Texts to an array of a row of logits for each.
Predict = Callable[[list[str]], np.ndarray]
#: Called once in a Python worker.
Load = Callable[[], Predict]


def model_fault(path: str | None) -> tuple[str, str] | None:
    """The code and message of a model folder that can't be loaded; none for a good one."""
    if not path:
        return "EMPTY_MODEL_PATH", "Empty model path provided"
    if not os.path.exists(path):
        return "MODEL_PATH_NOT_FOUND", f"Model directory does not exist: {path}"
    if absent := [f for f in MODEL_FILES if not os.path.exists(os.path.join(path, f))]:
        return "MISSING_MODEL_FILES", f"Missing required model files: {absent}"
    return None


def retried(call: Callable[[], T], retries: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` returns, tried again after each failure, after ``delay`` seconds and then twice as long each time."""
    for k in range(retries):
        try:
            return call()
        except Exception:  # the last try's own exception is raised
            sleep(delay * 2**k)
    return call()


def within(call: Callable[[], T], seconds: float) -> T:
    """What ``call`` returns, or ``TimeoutError``; the call that is too slow is left to itself in a daemon thread."""
    got: list = []

    def run() -> None:
        try:
            got.append((call(), None))
        except BaseException as e:  # raised again where the caller waits
            got.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"over {seconds} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


def onnx_model(path: str, length: int = 512, seconds: float = 30.0) -> Load:
    """The network ``model.onnx`` and the ``tokenizer.json`` of a folder that every executor sees."""

    def make() -> Predict:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(os.path.join(path, "tokenizer.json"))
        tokenizer.enable_truncation(length)
        tokenizer.enable_padding()
        session = onnxruntime.InferenceSession(os.path.join(path, "model.onnx"), providers=["CPUExecutionProvider"])
        names = [i.name for i in session.get_inputs()]

        def predict(texts: list[str]) -> np.ndarray:
            found = tokenizer.encode_batch(texts)
            own = {"input_ids": [e.ids for e in found], "attention_mask": [e.attention_mask for e in found], "token_type_ids": [e.type_ids for e in found]}
            return session.run(None, {n: np.array(own[n], np.int64) for n in names})[0]

        return predict

    def load() -> Predict:
        if fault := model_fault(path):
            raise FileNotFoundError(": ".join(fault))
        return retried(lambda: within(make, seconds))

    return load


def logits_of(load: Load, batch_size: int = 50) -> Callable[[Column], Column]:
    """A function of a text column to ``struct<logits, failed>``; a model that does not load gives null logits, unfailed.

    A batch that fails is tried text by text, so that a text's answer does not hang on its neighbours; a text that fails
    alone is ``failed``, and so is one whose logits are not as many as the labels or not finite. A null text has null logits.
    """

    @F.pandas_udf("struct<logits array<double>, failed boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            predict = load()
        except Exception:  # without a model the rules decide
            predict = None

        def answers(texts: list[str]) -> list[list[float] | None]:
            try:
                found = np.asarray(predict(texts), np.float64)
                if found.shape != (len(texts), len(LABELS)):
                    raise ValueError("as many logits as labels are needed")
                return [row.tolist() if np.isfinite(row).all() else None for row in found]
            except Exception:  # a text's fault is that text's
                return [None] if len(texts) == 1 else [answers([t])[0] for t in texts]

        for texts in batches:
            logits, failed = [None] * len(texts), [False] * len(texts)
            places = [k for k, t in enumerate(texts) if t is not None] if predict else []
            for at in range(0, len(places), batch_size):
                some = places[at : at + batch_size]
                for k, row in zip(some, answers([texts.iloc[k] for k in some]), strict=True):
                    logits[k], failed[k] = row, row is None
            yield pd.DataFrame({"logits": pd.Series(logits, dtype=object), "failed": pd.Series(failed, dtype=bool)})

    return run


def softmax(logits: Column) -> Column:
    """Shares of one; powers of the distance to the largest, so that none overflows."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def likeliest(logits: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """``struct<predicted_class, confidence>``: the label of the largest share, the first of equals, and that share."""
    top = F.array_max(logits)
    share = 1.0 / F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    label = F.element_at(F.array(*map(F.lit, labels)), F.array_position(logits, top).cast("int"))
    return F.when(F.size(logits) > 0, F.struct(label.alias("predicted_class"), share.alias("confidence")))


def hinted(blocks: DataFrame) -> Column:
    """What the model reads of a block of :func:`~docstruct.operators.classify.with_features`: its text behind feature hints."""
    g = F.col("features")
    return hints(F.col("text"), g["font_size_ratio"], g["is_bold"], g["is_italic"], g["position_y"], g["capitalization_score"], g["text_length"])


def with_model(blocks: DataFrame, load: Load, text: Column | None = None, batch_size: int = 50) -> DataFrame:
    """Blocks with ``model_class, model_confidence, model_failed``, which the cascade of ``classified`` reads."""
    rows = blocks.withColumn("answer", logits_of(load, batch_size)(hinted(blocks) if text is None else text))
    rows = rows.withColumn("best", likeliest(F.col("answer.logits")))
    return rows.withColumns({"model_class": F.col("best.predicted_class"), "model_confidence": F.col("best.confidence"), "model_failed": F.col("answer.failed")}).drop("answer", "best")


def heading_levels(classified: DataFrame) -> DataFrame:
    """``doc_id, seq, level``: the class alone, text where a block has none."""
    return classified.select("doc_id", "seq", F.coalesce("predicted_class", F.lit("text")).alias("level"))
