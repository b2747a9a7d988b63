"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary n-gram classifier per bit is learned:
the log ratio of the smoothed frequencies of hashed byte n-grams (1 to 4 bytes) under the
languages with +1 and those with -1. A text's margin on a bit is the mean weight of its
n-grams. Decoding is loss-weighted: each bit's exponential loss against each codeword counts
with the share of a training sample of that language on which the bit was right. The codeword
with the least loss wins; if the runner-up is close the answer is flagged ambiguous.

N-gram counts cover every learnable row (summed per task, then by Spark), so the model has
``DIM`` x languages numbers at any input size. Only the bit weights of the decoder come from a
bounded sample (``sample_rows``, default 4,000 rows).

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows without
a language are predicted but not learned from; if nothing can be learned every row is ``und``.
Repeated rows count as often as they occur; null ids are predicted like others. Whole texts
are read. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import capped, distinct_sample
from ._text import slices, utf8

DIM = 1 << 15
ORDERS = (1, 2, 3, 4)
LETTER = r"\p{L}"


def ngram_rows(data: np.ndarray, orders=ORDERS, dim: int = DIM) -> np.ndarray:
    """Hash buckets of all byte n-grams of one text (ASCII letters in lower case)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    out = []
    h = np.zeros(len(low), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(low) < n:
            break
        h = h[:len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1:] + np.uint32(1)
        if n in orders:
            g = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((g >> np.uint32(32 - int(dim).bit_length() + 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def histogram(data: np.ndarray, dim: int = DIM, piece: int = 1 << 20) -> np.ndarray:
    """N-gram counts of a whole text, a piece at a time (pieces overlap by the longest n-gram)."""
    total = np.zeros(dim, np.int64)
    over = max(ORDERS) - 1
    for a in range(0, max(1, len(data)), piece):
        total += np.bincount(ngram_rows(data[a:a + piece + over]), minlength=dim)
        if a:                                         # n-grams inside the overlap: once only
            total -= np.bincount(ngram_rows(data[a:a + over]), minlength=dim)
    return total


def codewords(n: int) -> np.ndarray:
    """n codewords: all 2^(n-1) - 1 different splits up to 7 languages, else dense random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    rng = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), size=(n, bits))
        if (np.abs(m.sum(0)) == n).any():
            continue
        d = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if d > far:
            best, far = m, d
    return best


class Model:
    """Languages, codewords, bit weights and decoder weights: of a fixed size."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.code = codewords(len(langs))
        freq = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        self.weights = np.stack([
            np.log(freq[bit > 0].mean(0)) - np.log(freq[bit < 0].mean(0)) if (bit < 0).any()
            else np.zeros(counts.shape[1]) for bit in self.code.T], axis=1)
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, hist: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hist)
        return hist[at] @ self.weights[at] / max(1, hist.sum())

    def weigh(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Decoder weights: how often each bit is right on each language's sample rows."""
        for i in range(len(self.langs)):
            m = margins[labels == i]
            right = (m * self.code[i] > 0).mean(0) if len(m) else np.ones(self.code.shape[1])
            self.trust[i] = (right + 1e-3) / (right + 1e-3).sum()

    def decode(self, margins: np.ndarray) -> tuple[int, float, float]:
        """Index of the nearest codeword, its score in (0, 1], and the lead over the next."""
        loss = (self.trust * np.exp(-4 * self.code * margins)).sum(1)
        order = np.argsort(loss, kind="stable")
        p = 1 / np.maximum(loss, 1e-9) ** 2
        p = p / p.sum()
        lead = p[order[0]] - p[order[1]] if len(loss) > 1 else 1.0
        return int(order[0]), float(p[order[0]]), float(lead)


def _fit_counts(rows: DataFrame) -> dict[str, np.ndarray]:
    """N-gram counts by language over all rows; tasks add up their own rows first."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in it:
            for b in slices(whole, "text"):
                data, off = utf8(b.column(0))
                for i, lang in enumerate(b.column(1).to_pylist()):
                    own = total.setdefault(lang, np.zeros(DIM, np.int64))
                    own += histogram(data[off[i]:off[i + 1]])
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                names=["lang", "f", "n"])

    got = (rows.mapInArrow(count, "lang string, f int, n long")
           .groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow())
    out: dict[str, np.ndarray] = {}
    names, f, n = got.column(0).to_pylist(), got.column(1).to_numpy(), got.column(2).to_numpy()
    where: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        where.setdefault(name, []).append(i)
    for name, at in where.items():
        out[name] = np.zeros(DIM, np.int64)
        out[name][f[at]] = n[at]
    return out


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang",
        key: str = "doc_id", sample_rows: int = 4000) -> Model | None:
    """A model from the rows where ``learn`` holds and text and language are not null."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        F.xxhash64(F.col(key), F.col(text), F.col(lang)).alias("mark"))
    counts = _fit_counts(rows.select("text", "lang"))
    if not counts:
        return None
    langs = sorted(counts)
    model = Model(langs, np.stack([counts[x] for x in langs]))
    blob, bits = pickle.dumps(model), model.code.shape[1]

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob)
        for whole in it:
            for b in slices(whole, "text"):
                data, off = utf8(b.column(0))
                got = [m.margins(histogram(data[off[i]:off[i + 1]])) for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g.tolist() for g in got]), b.column(2)],
                                                 names=["lang", "m", "mark"])

    measured = (distinct_sample(rows, "mark", sample_rows)
                .mapInArrow(measure, "lang string, m array<double>, mark long"))
    sample = capped(measured, "mark", sample_rows).toArrow()
    if sample.num_rows:
        index = {x: i for i, x in enumerate(langs)}
        model.weigh(np.array(sample.column("m").to_pylist()).reshape(-1, bits),
                    np.array([index[x] for x in sample.column("lang").to_pylist()]))
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id",
            ambiguous_below: float = 0.2) -> DataFrame:
    """``key``, lang_pred, score and ambiguous for every row, from the text alone."""
    blob = pickle.dumps(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(blob)
        for whole in it:
            for b in slices(whole, "text"):
                data, off = utf8(b.column(1))
                letters = b.column(2).to_pylist()
                out: list[tuple[str, float, bool]] = []
                for i in range(b.num_rows):
                    if m is None or not letters[i]:
                        out.append(("und", 0.0, True))
                        continue
                    at, score, lead = m.decode(m.margins(histogram(data[off[i]:off[i + 1]])))
                    out.append((m.langs[at], score, lead < ambiguous_below))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array([o[j] for o in out], t) for j, t in
                                    enumerate((pa.string(), pa.float64(), pa.bool_())))],
                    names=["key", "lang_pred", "score", "ambiguous"])

    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                        F.coalesce(F.col(text).rlike(LETTER), F.lit(False)).alias("letters"))
            .mapInArrow(run, f"key {kind}, lang_pred string, score double, ambiguous boolean")
            .withColumnRenamed("key", key))
