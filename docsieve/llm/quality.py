"""Quality classifier: random-indexing word vectors, pooled, and a small network.

1. *Random indexing* (Kanerva; Sahlgren). Every word bucket and every word-shape
   bucket has a fixed sparse ternary index vector made from its number. A
   bucket's context vector is the sum of the index vectors of the two words on
   either side of each occurrence, over *all* texts: each task sums its own
   table of fixed size, Spark adds the tables, and the driver gets one of
   ``WORDS + SHAPES`` rows.
2. *Pooling.* A text is the mean and deviation of its words' unit context
   vectors and of its shapes', the mean of its raw index vectors with that
   mean's length (which grows as words repeat), and the logarithm of its size.
3. *Network.* Two layers in numpy, trained by Adam on a bounded sample of
   labelled rows, with a fifth of it held back to choose the epoch and the
   temperature that calibrates the probabilities.

Null text is empty text; it pools to zeros. With no labelled row every score is
0, with labels of one class it is that class's. Only the fixed-size tables are
shuffled, so a hot source or copied text skews nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import labelled_sample, release, remainder

WORDS, SHAPES, DIM = 4096, 512, 24
NONZERO = 4
WINDOW = 2
SAMPLE_LOW, SAMPLE_HIGH = 4000, 5000
HIDDEN = 32
ACCEPT = 0.7
SCHEMA = "doc_id long, score double, predicted int"

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("X")
_CLASS[ord("a") : ord("z") + 1] = ord("x")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_CLASS[0x80:] = ord("x")


def index_vectors() -> np.ndarray:
    """Fixed ternary vectors: NONZERO entries of +1 or -1 in DIM, for words, then shapes."""
    n = WORDS + SHAPES
    draws = K.splitmix(n * NONZERO, 61).reshape(n, NONZERO)
    out = np.zeros((n, DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(n), (draws[:, k] % np.uint64(DIM)).astype(np.int64)), np.where(draws[:, k] >> np.uint64(63), 1, -1))
    return out


def buckets(piece: K.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape bucket (rows of one table) of every word, and each document's slice.

    A shape is the word with capitals, small letters and digits as one sign each and runs of a sign as one.
    """
    found = K.words(piece)
    sign = _CLASS[piece.data]
    new = np.ones(len(sign), bool)
    new[1:] = sign[1:] != sign[:-1]
    new[found.start] = True
    before = np.concatenate([[0], np.cumsum(new)])
    shape = K.run_codes(sign[new], before[found.start], before[found.end])
    return (found.code % np.uint64(WORDS)).astype(np.int64), WORDS + (shape % np.uint64(SHAPES)).astype(np.int64), found.first


def context_sums(piece: K.Piece, index: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for every bucket."""
    word, shape, first = buckets(piece)
    out = np.zeros((WORDS + SHAPES, DIM))
    if not len(word):
        return out
    own = index[word] + index[shape]
    total = np.concatenate([np.zeros((1, DIM)), np.cumsum(own, axis=0, dtype=np.float64)])
    at = np.arange(len(word))
    doc = np.repeat(np.arange(piece.n), np.diff(first))
    context = total[np.minimum(at + WINDOW + 1, first[doc + 1])] - total[np.maximum(at - WINDOW, first[doc])] - own
    for bucket in (word, shape):
        order = np.argsort(bucket, kind="stable")
        rows, begin = np.unique(bucket[order], return_index=True)
        out[rows] += np.add.reduceat(context[order], begin, axis=0)
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors of all buckets, from every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((WORDS + SHAPES, DIM))
        for batch in batches:
            for piece in K.pieces(batch.column(0)):
                total += context_sums(piece, index)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, i].astype(np.int64)) for i in range(DIM))], names=["bucket", *(f"v{i}" for i in range(DIM))])

    parts = docs.select(docs[text].cast("string").alias("text")).mapInArrow(K.released(run), f"bucket long, {', '.join(f'v{i} long' for i in range(DIM))}")
    rows = parts.groupBy("bucket").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM))).toArrow()
    out = np.zeros((WORDS + SHAPES, DIM))
    out[rows["bucket"].to_numpy()] = np.stack([rows[f"v{i}"].to_numpy() for i in range(DIM)], axis=1) if rows.num_rows else 0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(piece: K.Piece, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The documents' features."""
    word, shape, first = buckets(piece)
    count = np.diff(first)
    some = np.flatnonzero(count)
    n = np.maximum(count, 1)[:, None]

    def mean(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((piece.n, rows.shape[1]))
        if len(some):
            out[some] = np.add.reduceat(rows, first[:-1][some], axis=0)
        return out / n

    parts = []
    for bucket in (word, shape):
        rows = vectors[bucket]
        middle = mean(rows)
        parts += [middle, np.sqrt(np.maximum(mean(rows * rows) - middle**2, 0))]
    raw = mean(index[word])
    size = np.log1p(np.stack([count, np.diff(piece.offsets)], axis=1))
    return np.concatenate([*parts, raw, np.linalg.norm(raw, axis=1, keepdims=True), size], axis=1)


@dataclass
class Network:
    """Standardisation, two layers, temperature and the shift of the sample's log odds to the labelled rows'."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, share: float, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Trains on four fifths of the rows; the rest chooses epoch and temperature."""
    n1 = int(y.sum())
    if not n1 or n1 == len(y):
        zero = np.zeros(x.shape[1])
        return Network(zero, zero + 1, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), 30.0 if n1 else -30.0)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    held, own = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 50 else (order, order)
    net = Network(x[own].mean(axis=0), x[own].std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - net.centre) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    best, kept, step = np.inf, [p.copy() for p in params], 0
    for _ in range(epochs):
        for at in range(0, len(own), batch):
            rows = rng.choice(own, batch) if len(own) > batch else own
            h = np.tanh(z[rows] @ params[0] + params[1])
            out = h @ params[2] + params[3]
            d = (1 / (1 + np.exp(-out)) - y[rows]) / len(rows)
            dh = np.outer(d, params[2]) * (1 - h * h)
            step += 1
            for p, (a, b), g in zip(params, moments, (z[rows].T @ dh + decay * params[0], dh.sum(axis=0), h.T @ d + decay * params[2], d.sum(keepdims=True)), strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        logits = np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3]
        if (loss := _loss(logits, y[held])) < best:
            best, kept = loss, [p.copy() for p in params]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[held])))
    net.shift = float(np.log(share / (1 - share)) - np.log(n1 / (len(y) - n1)))
    return net


def train(docs: DataFrame, labels: DataFrame, fold: Column, vectors: np.ndarray) -> Network:
    known = labels.where(fold & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    sample, share = labelled_sample(docs, known.select("doc_id", F.col("quality").alias("label")), SAMPLE_LOW, SAMPLE_HIGH)
    index = index_vectors()
    rows = [pooled(piece, vectors, index) for piece in K.pieces(sample["text"])] or [np.zeros((0, 5 * DIM + 3))]
    net = fit(np.concatenate(rows), np.asarray(sample["label"], np.float64), share)
    del sample, rows
    release()
    return net


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                s = net.probabilities(pooled(piece, vectors, index))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(K.released(run), SCHEMA)


def keep(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the network accepts."""
    index = index_vectors()
    return docs.mapInArrow(K.row_filter(lambda piece: net.probabilities(pooled(piece, vectors, index)) >= ACCEPT, docs.columns.index(text)), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels are learned where crc32(doc_id) mod 4 is not 2."""
    vectors = word_vectors(docs)
    net = train(docs, labels, remainder(F.col("doc_id"), 4) != 2, vectors)
    out = score(docs, vectors, net)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
