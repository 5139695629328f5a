"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are gathered in Arrow batches; the trees are grown by Newton steps on histograms of quantile bins
of a bounded sample (``TRAIN_ROWS`` labelled rows at most, held-out rows never), and flattened into arrays for vectorised
traversal: level by level, ``node = 2 * node + 1 + (x > threshold)`` for all rows at once.

Cases: null text is empty, and an empty text has a score like any other; repeated rows have equal scores; without labelled
rows each score is 0.5; with one class alone trees hold its rate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import arrow_map, batch, held_out, texts
from docstruct.llm.training import labelled_ids, labelled_texts

TRAIN_ROWS, TREES, DEPTH, RATE, BINS, L2, LEAST, THRESHOLD = 12_000, 80, 5, 0.15, 64, 1.0, 5.0, 0.3
_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 beyond ASCII
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2, 3
_CLASS[[32, *range(9, 14)]], _CLASS[[*b".,;:?'\"-()"]], _CLASS[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]], _CLASS[128:] = 4, 5, 6, 7
_MARKS = set(b"!#$%&*+/<=>@[\\]^_`{|}~")
NAMES = ("log_bytes", "log_words", "word_mean", "word_sd", "distinct", "top", "twice", "lines", "line_mean", "line_twice", "lower", "upper", "digit", "space", "sentence", "mark", "beyond", "bang", "bar", "entropy", "marked_words", "capital_words", "upper_words", "long_words", "marked_lines", "short_lines", "top_line", "vowels")


def statistics(text: bytes) -> list[float]:
    """The statistics in the order of ``NAMES``; shares are of bytes, words or lines."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=8) / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    words = text.split()
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    found = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    k = len(lines)
    line_counts = Counter(lines)
    marked = sum(c for w, c in found.items() if w[-1] in _MARKS)
    capital = sum(c for w, c in found.items() if 65 <= w[0] <= 90)
    upper = sum(c for w, c in found.items() if len(w) > 1 and w.isupper())
    noisy = sum(len(x) for x in lines if 8 * sum(x.count(c) for c in (b"|", b"!", b"*", b"#", b"%", b"&", b"$")) > x.count(b" ") + 1)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(sizes.mean()), float(sizes.std()), len(found) / max(m, 1), max(found.values(), default=0) / max(m, 1), sum(map(eq, words[1:], words)) / max(m, 1),
        float(np.log1p(k)), n / max(k, 1), sum(len(x) * (c - 1) for x, c in line_counts.items()) / max(n, 1),
        float(shares[1]), float(shares[2]), float(shares[3]), float(shares[4]), float(shares[5]), float(shares[6]), float(shares[7]), text.count(b"!") / max(n, 1), text.count(b"|") / max(m, 1), float(-(p * np.log2(p)).sum()),
        marked / max(m, 1), capital / max(m, 1), upper / max(m, 1), float((sizes > 15).mean()), noisy / max(n, 1), sum(len(x) < 20 for x in lines) / max(k, 1), max(line_counts.values(), default=0) / max(k, 1),
        float(counts[[*b"aeiouAEIOU"]].sum()) / max(n, 1),
    ]


class Trees(NamedTuple):
    """Complete trees as arrays: inner nodes' features and thresholds, leaves' values; ``base`` is the first log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        out = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Fit on features ``x`` and labels ``y``; a node without a gain sends all rows left."""
    inner, f = (1 << depth) - 1, x.shape[1]
    if not len(y):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    at, far = np.full(len(y), base), np.inf
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, far)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            place = node - first
            best = np.zeros(n)
            split = np.full((n, 2), -1)
            for j in range(f):
                key = place * bins + code[:, j]
                gs = np.bincount(key, g, n * bins).reshape(n, bins).cumsum(axis=1)
                hs = np.bincount(key, h, n * bins).reshape(n, bins).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(n), top] > best + 1e-12
                best = np.where(better, gain[np.arange(n), top], best)
                split[better] = np.stack([np.full(n, j), top], axis=1)[better]
            for k in np.flatnonzero(split[:, 0] >= 0):
                feature[first + k], threshold[first + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - inner
        leaf = -rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + L2)
        at = at + leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents; of rows that repeat an identifier the smallest statistics count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t) for t in texts(b.column(2))], pa.list_(pa.float64()))], names=["id", "label", "x"])

    ids, _ = labelled_ids(labels, "quality", rows)
    found = arrow_map(labelled_texts(docs, ids), run, "id long, label int, x array<double>", "_id", "_label", "text")
    kept = found.groupBy("id", "label").agg(F.min("x").alias("x")).select("label", "x", F.xxhash64("id").alias("o")).toPandas().sort_values("o")
    x = np.array(kept["x"].tolist(), np.float64).reshape(len(kept), len(NAMES))
    return grow(x, kept["label"].to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b.column(2))], np.float64).reshape(-1, len(NAMES))
            s = trees.score(x)
            yield batch(schema, b.column(0), b.column(1), s, (s >= threshold).astype(np.int32))

    return arrow_map(docs, run, "doc_id long, held_out boolean, score double, predicted int", F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score at least ``threshold``, in one pass and without a join; columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b.column(at))], np.float64).reshape(-1, len(NAMES))
            yield b.filter(pa.array(trees.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
