"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Texts in lower case, white space made one space, give the set of their n-grams of 3 to 6 bytes, hashed to ``BUCKETS``.
From a bounded, balanced sample (``PER_CLASS`` labelled rows of a class at most, held-out rows never) each bucket gets
``r = log((a + 1) / (A + 2) / ((b + 1) / (B + 2)))``, its smoothed share of toxic over that of other texts. The ``FEATURES``
buckets of largest chi-square are kept, of those at ``LEAST_CHI`` or more, and logistic regression is fitted to presence times ``r``, its intercept shifted
from the sample's class rate to that of all labels. Presence, not counts: a few words decide in long texts as in short ones.

Cases: null text is empty, and an empty text scores by the intercept; repeated rows have equal scores; without labelled rows
of both classes each score is the share of toxic labels, 0.5 if there are none; an empty table gives no rows; other
columns are not read. Texts are handled whole, one at a time, in parts of bounded size that overlap. To the driver come two
counts for each of the ``BUCKETS`` and at most ``FEATURES`` places for each sampled row, whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import arrow_map, batch, cut, held_out, texts
from docstruct.llm.training import labelled_ids, labelled_texts

PER_CLASS, FEATURES, LEAST_CHI, LENGTHS, BITS, THRESHOLD = 2_000, 8_192, 20.0, (3, 4, 5, 6), 20, 0.5
BUCKETS = 1 << BITS
_PART = 1 << 20


def buckets(text: bytes) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    line = b" " + b" ".join(text.lower().split()) + b" "
    out, longest = [], max(LENGTHS)
    for at in range(0, len(line), _PART):
        b = np.frombuffer(line[at : at + _PART + longest - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        for n in range(1, longest + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
            if n in LENGTHS:
                x = h[: _PART] * np.uint32(0x9E3779B1)
                out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Model(NamedTuple):
    """``slot`` of a bucket is its place in ``weight`` or the last, which weighs nothing; weights hold ``r``."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        seen = np.zeros(len(self.weight), bool)
        seen[self.slot[buckets(text)]] = True
        seen[-1] = False
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[seen].sum(), -500, 500))))


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(BUCKETS, np.int16), np.zeros(1), float(np.log(share / (1 - share))))


def choose(a: np.ndarray, b: np.ndarray, n1: int, n0: int, features: int = FEATURES, least: float = LEAST_CHI) -> tuple[np.ndarray, np.ndarray]:
    """Kept buckets, ascending, and the log-count ratio of each, from the toxic and other texts that hold each bucket."""
    ratio = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
    e = (a + b) / (n1 + n0)
    chi = np.divide((a - e * n1) ** 2, e * (1 - e) * n1 * n0 / (n1 + n0), out=np.zeros(len(a)), where=(e > 0) & (e < 1))
    top = np.argsort(-chi, kind="stable")[:features]
    top = np.sort(top[chi[top] >= least])
    return top, ratio[top]


def fit(cols: list[np.ndarray], y: np.ndarray, top: np.ndarray, ratio: np.ndarray, share: float, rounds: int = 300, l2: float = 1e-3) -> Model:
    """From the places in ``top`` of each text's buckets, its label, and the share of toxic rows to expect."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    slot = np.full(BUCKETS, len(top), np.int16)
    slot[top] = np.arange(len(top))
    r = np.append(ratio, 0.0)
    col, row = np.concatenate(cols).astype(np.int64), np.repeat(np.arange(len(y)), [len(c) for c in cols])
    values = r[col]
    w, bias, step_w, step_b = np.zeros(len(r)), 0.0, np.zeros(len(r)), 0.0
    mean_w, mean_b = np.zeros(len(r)), 0.0
    for t in range(1, rounds + 1):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * w[col], len(y)) + bias, -30, 30)))
        d = (p - y) / len(y)
        g, gb = np.bincount(col, values * d[row], len(r)) + l2 * w, float(d.sum())
        mean_w, mean_b = 0.9 * mean_w + 0.1 * g, 0.9 * mean_b + 0.1 * gb
        step_w, step_b = 0.99 * step_w + 0.01 * g * g, 0.99 * step_b + 0.01 * gb * gb
        k1, k2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - 0.03 * (mean_w / k1) / (np.sqrt(step_w / k2) + 1e-8)
        bias -= 0.03 * (mean_b / k1) / (step_b / k2 + 1e-16) ** 0.5
    shift = np.log(share / (1 - share)) - np.log(n1 / n0) if 0 < share < 1 else 0.0
    return Model(slot, r * w, float(bias + shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """From at most ``per_class`` labelled documents of each class; of rows that repeat an identifier the smallest counts.

    Each sampled text's buckets are written to the shared folder. The rows that hold a bucket are summed there by class, so
    that the driver sees two numbers a bucket, and then the kept buckets of each row alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(buckets(t)).astype("<i4").tobytes() for t in texts(b.column(2))], pa.binary())], names=["id", "label", "x"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for label, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[label, np.frombuffer(x.as_py(), "<i4")] += 1
        some = np.flatnonzero(held.any(axis=0))
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[1, own]), pa.array(held[0, own])], names=["bucket", "a", "b"])

    ids, counts = labelled_ids(labels, "toxic", per_class, by_class=True)
    found = arrow_map(labelled_texts(docs, ids), run, "id long, label int, x binary", "_id", "_label", "text")
    kept = cut(found.groupBy("id", "label").agg(F.min("x").alias("x")))
    total, own = sum(counts.values()), {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    share = counts.get(1, 0) / total if total else 0.5
    if not own.get(1) or not own.get(0):
        return constant(share)
    summed = kept.select("label", "x").mapInArrow(count, "bucket int, a long, b long").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    a, b = np.zeros((2, BUCKETS), np.int64)
    a[summed["bucket"].to_numpy()], b[summed["bucket"].to_numpy()] = summed["a"].to_numpy(), summed["b"].to_numpy()
    top, ratio = choose(a, b, own[1], own[0])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            chosen = [np.flatnonzero(np.isin(top, np.frombuffer(x.as_py(), "<i4"), assume_unique=True)).astype("<i2").tobytes() for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(chosen, pa.binary())], names=["id", "label", "x"])

    rows = kept.mapInArrow(places, "id long, label int, x binary").toArrow().sort_by("id")
    return fit([np.frombuffer(x, "<i2") for x in rows["x"].to_pylist()], np.array(rows["label"].to_pylist(), np.float64), top, ratio, share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t) for t in texts(b.column(2))], np.float64)
            yield batch(schema, b.column(0), b.column(1), s, (s >= threshold).astype(np.int32))

    return arrow_map(docs, run, "doc_id long, held_out boolean, score double, predicted int", F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
