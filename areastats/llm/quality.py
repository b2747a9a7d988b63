"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators (present or not) of hashed n-grams of one to three bytes, of one to
three "shapes" (letter case, digit, mark, space, runs collapsed), and of how often a word
repeats its predecessor. Class log-count ratios r scale the indicators, and a linear
hinge-loss model is fitted on the scaled vectors by dual coordinate descent. The weights are
interpolated with the plain naive Bayes weights as usual for this method.

The classifier is fitted on a bounded sample of the labelled ids (``sample_rows``, default
8,000, chosen by a hash of the id; documented bound) with one document each, and of their
features (``sample_features``), so the fit has the same size for any corpus. Everything else
reads all rows and whole texts.

Defined results: empty and null texts are scored like any text (they have no features, so the
bias alone decides); several label rows of one id count as their majority (a tie: 1); null
labels or ids are not learned from; of several documents of one labelled id, the one whose
text has the smallest hash is learned from; with one class only, or no labels, the score is that
class (1 where nothing is known). Repeated rows are each scored. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import batch_of, capped, distinct_sample, map_in_arrow
from ._text import slices, utf8, word_hashes, word_spans

DIM = 1 << 16
_SHIFT = np.uint32(16)
_SHAPE = np.full(256, ord("m"), np.uint8)             # other marks
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("u")
_SHAPE[32] = ord(" ")
_SHAPE[9:14] = ord("n")
_SHAPE[ord(".")] = _SHAPE[ord(",")] = ord(".")


def _grams(x: np.ndarray, orders: int, salt: int) -> list[np.ndarray]:
    out, h = [], np.full(len(x), salt, np.uint32)
    for n in range(1, orders + 1):
        if len(x) < n:
            break
        h = h[:len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1:] + np.uint32(1)
        g = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((g >> _SHIFT).astype(np.uint16))
    return out


def features(data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Sorted distinct feature numbers of one whole text."""
    seen = np.zeros(DIM, bool)
    before = np.zeros(0, np.uint8)                    # the last shapes of the pieces so far
    for a in range(0, len(data), piece):
        for g in _grams(data[a:a + piece + 2], 3, 1):
            seen[g] = True
        s = _SHAPE[data[a:a + piece]]
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        keep[0] = not len(before) or s[0] != before[-1]
        s = np.concatenate((before, s[keep]))
        for g in _grams(s, 3, 2):
            seen[g] = True
        before = s[-2:]
    if len(data):
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        w = word_hashes(data, starts, ends)
        again = int((w[1:] == w[:-1]).sum())
        # how many words repeat their predecessor, as a power of two, and as a share
        for g in {(3, int(again).bit_length()), (4, again * 8 // max(1, len(w)))}:
            seen[(g[0] * 0x9E3779B1 + g[1] * 0x85EBCA6B) >> 7 & (DIM - 1)] = True
    return np.flatnonzero(seen).astype(np.uint16)


def _packed(x: np.ndarray) -> bytes:
    """Feature numbers, or one bit for each possible feature where that is shorter (8 KB)."""
    if 2 * len(x) < DIM // 8:
        return x.tobytes()
    seen = np.zeros(DIM, bool)
    seen[x] = True
    return np.packbits(seen).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if len(blob) < DIM // 8:
        return np.frombuffer(blob, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8))).astype(np.uint16)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0,
                 epochs: int = 15, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge loss by dual coordinate descent; a bias is a last feature.

    Rows of the rarer class cost more, so that both classes weigh the same.
    """
    w, bias = np.zeros(len(r)), 0.0
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    c = np.where(y > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    scaled = [r[x] / max(1e-9, np.sqrt((r[x] ** 2).sum())) for x in rows]
    diag = 1 / (2 * c)
    q = np.array([(s ** 2).sum() + 1 for s in scaled]) + diag
    alpha, rng = np.zeros(len(y)), np.random.default_rng(3)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x, s = rows[i], scaled[i]
            g = y[i] * (w[x] @ s + bias) - 1 + diag[i] * alpha[i]
            step = max(alpha[i] - g / q[i], 0.0) - alpha[i]
            if step:
                worst = max(worst, abs(step * q[i]))
                alpha[i] += step
                w[x] += step * y[i] * s
                bias += step * y[i]
        if worst < tol:
            break
    return w, bias


class Model:
    """Scaled weights of every feature, a bias and a logistic slope: of a fixed size."""

    def __init__(self, r: np.ndarray, w: np.ndarray, bias: float, slope: float = 2.0):
        self.r, self.w, self.bias, self.slope = r, w, bias, slope

    def margin(self, x: np.ndarray) -> float:
        s = self.r[x]
        return float(self.w[x] @ s / max(1e-9, np.sqrt(s @ s)) + self.bias)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x), -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text",
        key: str = "doc_id", label: str = "quality", sample_rows: int = 8000,
        sample_features: int = 1 << 24) -> Model:
    """A model from ``labels`` rows where ``learn`` (a condition on ``key``) holds.

    ``sample_rows`` bounds the documents learned from, ``sample_features`` the sum of their
    features (documents in the order of a hash, as long as they fit).
    """
    marks = (labels.select(F.col(key).alias("key"), F.col(label).alias("y"))
             .where(F.col("key").isNotNull() & F.col("y").isNotNull())
             .withColumnRenamed("key", key).where(learn).withColumnRenamed(key, "key")
             .groupBy("key").agg((F.avg("y") >= 0.5).alias("y")))
    # at most sample_rows small rows: a proven bound for the broadcast
    marks = marks.withColumn("mark", F.xxhash64("key"))
    marks = F.broadcast(capped(distinct_sample(marks, "mark", sample_rows), "mark", sample_rows))
    rows = (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(marks, "key")
            .select("text", "y", "mark", F.xxhash64("text").alias("tie")))

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, "text"):
                data, off = utf8(b.column(0))
                got = [_packed(features(data[off[i]:off[i + 1]])) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), *b.columns[1:]],
                                                 names=["x", "y", "mark", "tie"])

    got = (rows.mapInArrow(extract, "x binary, y boolean, mark long, tie long")
           .groupBy("mark").agg(F.min(F.struct("tie", "x", "y")).alias("r"))
           .select("r.x", "r.y", F.xxhash64("mark", F.lit(17)).alias("by")).toArrow())
    order, held = [], 0
    for _, v, m in sorted(zip(got.column("by").to_pylist(), got.column("x").to_pylist(), got.column("y").to_pylist())):
        u = _unpacked(v)
        held += len(u)
        if held > sample_features:
            break
        order.append((u, m))
    x = [u for u, _ in order]
    y = np.array([1.0 if m else -1.0 for _, m in order])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM), np.zeros(DIM), -10.0 if len(y) and y[0] < 0 else 10.0)
    p, q = np.ones(DIM), np.ones(DIM)
    for v, m in zip(x, y):
        (p if m > 0 else q)[v] += 1
    r = np.log(p / ((y > 0).sum() + 2)) - np.log(q / ((y < 0).sum() + 2))
    w, bias = dual_descent(x, y, r)
    mean = np.abs(w).mean()                           # interpolation towards naive Bayes
    return Model(r, 0.75 * w + 0.25 * mean, bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with ``score`` (0 to 1) and ``predicted`` added, from the text alone.

    Columns of the input that have these names are replaced.
    """
    blob = pickle.dumps(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob)
        for whole in it:
            for b in slices(whole, whole.schema.names[at]):
                data, off = utf8(b.column(at))
                s = np.array([m.score(features(data[off[i]:off[i + 1]])) for i in range(b.num_rows)])
                yield batch_of([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))])

    full = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                         T.StructField("predicted", T.IntegerType())])
    return map_in_arrow(docs, run, full)
