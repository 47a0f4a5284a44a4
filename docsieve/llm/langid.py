"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are folded (small letters; other ASCII than letters is one space), and
their 1- to 3-character n-grams are hashed into ``BUCKETS`` features with
sublinear term frequency, inverse document frequency over *all* learning texts
(summed in tables of fixed size), and unit length. Follow-the-regularised-leader
(FTRL-proximal, McMahan et al. 2013) with L1 and L2 penalties learns a weight
vector a language; most stay exactly 0. A fifth of the sample sets the
temperature that calibrates the probabilities.

The classifier is fitted on at most ``SAMPLE`` labelled rows (one a language, if
there are more languages), shared equally by the languages, those of least id
hash, and at most ``shared.SAMPLE_BYTES`` of text; log priors of all learning
rows are put back afterwards. Every language among the learning rows is learned,
so the model is as many columns wide as there are languages.
Texts that are null or have no letter are ``und`` with score 0, as are all texts
when nothing could be learned. Ties go to the language that sorts first. Repeated
rows are predicted one by one; an id that repeats in the sample is one row. A very
long text is read whole, as a piece of its own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import one_text_each, release, remainder

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SAMPLE = 8000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
EPOCHS = 3
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"

_LETTER = regex.compile(r"\p{L}")
_SPACE = np.zeros(128, bool)
_SPACE[:] = True
_SPACE[ord("a") : ord("z") + 1] = False


def features(piece: K.Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document the n-gram buckets it holds, ascending, and how often."""
    data = K.folded(piece.data)
    starts = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[piece.offsets]
    char = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    char = np.where((char < 128) & _SPACE[np.minimum(char, 127).astype(np.int64)], np.uint64(32), char)
    salts = K.splitmix(len(ORDERS) * 3, 83) | np.uint64(1)
    grams = []
    for n in ORDERS:
        total = np.full(max(0, len(char) - n + 1), np.uint64(n))
        for k in range(n):
            total += char[k : len(char) - n + 1 + k] * salts[3 * (n - 1) + k]
        grams.append((K.mix(total) >> np.uint64(64 - 14)).astype(np.int64))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = np.concatenate([g[a : max(a, b - n + 1)] for g, n in zip(grams, ORDERS, strict=True)])
        count = np.bincount(own, minlength=BUCKETS)
        found = np.flatnonzero(count)
        yield found, count[found]


def has_letter(piece: K.Piece) -> np.ndarray:
    out = K.sums((piece.data | 0x20) - np.uint8(ord("a")) < 26, piece.offsets) > 0
    for i in np.flatnonzero(~out):
        out[i] = bool(_LETTER.search(piece.data[piece.offsets[i] : piece.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def vector(found: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the found buckets: sublinear TF-IDF of unit length."""
    value = (1 + np.log(count)) * idf[found]
    return value / max(np.sqrt((value**2).sum()), 1e-12)


class Ftrl:
    """FTRL-proximal with per-coordinate rates for buckets x classes."""

    def __init__(self, n: int, classes: int):
        self.z, self.n = np.zeros((n, classes)), np.zeros((n, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        logits = values @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[rows]
        new = n + g * g
        self.z[rows] += g - (np.sqrt(new) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = new


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    shift: np.ndarray

    def probabilities(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        rows = np.append(found, BUCKETS)
        values = np.append(vector(found, count, self.idf), 1.0)
        logits = values @ self.weights[rows] / self.temperature + self.shift
        p = np.exp(logits - logits.max())
        return p / p.sum()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the ``texts`` each bucket occurs, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for piece in K.pieces(batch.column(0)):
                for found, _ in features(piece):
                    total[found] += 1
                n += piece.n
        total[BUCKETS] = n
        rows = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(total[rows])], names=["bucket", "df"])

    rows = texts.select("text").mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy()] = rows["df"].to_numpy()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, fold: Column) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with a language for which ``fold`` holds."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(fold & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0, np.zeros(0))
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = max(1, SAMPLE // len(languages))
    # the ids whose hash lies in the lowest part of its range, twice as many as wanted: no language is sorted as a whole
    spark = docs.sparkSession
    parts = spark.createDataFrame([(x, min(1.0, (2 * each + 50) / counts[x])) for x in languages], "lang string, part double")
    low = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(parts), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("part"))
    ids, left = [], dict.fromkeys(languages, each)
    for r in sorted(low.select("h", "doc_id", "lang").distinct().collect()):
        if left[r.lang]:
            left[r.lang] -= 1
            ids.append((r.doc_id,))
    chosen = spark.createDataFrame(ids, "id long")
    sample = one_text_each(known.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("id")).select("doc_id", "text", "lang"))
    number = {x: i for i, x in enumerate(languages)}
    label = np.array([number[x] for x in sample["lang"].to_pylist()], np.int64)
    rows = [f for piece in K.pieces(sample["text"]) for f in features(piece)]
    order = np.random.default_rng(7).permutation([i for i in range(len(label)) if len(rows[i][0])])
    held = order[: len(order) // 5] if len(order) >= 50 else order
    own = order[len(order) // 5 :] if len(order) >= 50 else order
    leader = Ftrl(BUCKETS + 1, len(languages))
    for _ in range(EPOCHS):
        for i in own:
            found, count = rows[i]
            leader.learn(np.append(found, BUCKETS), np.append(vector(found, count, idf), 1.0), label[i])
    weights = leader.weights()
    logits = np.array([np.append(vector(*rows[i], idf), 1.0) @ weights[np.append(rows[i][0], BUCKETS)] for i in held]).reshape(-1, len(languages))

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(held)), label[held]])) if len(held) else 0.0

    temperature = float(min(np.geomspace(0.1, 10, 81), key=loss))
    seen = np.maximum(np.bincount(label[own], minlength=len(languages)), 0.5)
    prior = np.array([counts[x] for x in languages], float)
    del sample, rows, leader
    release()
    return Model(languages, idf, weights, temperature, np.log(prior / prior.sum()) - np.log(seen / seen.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                letters, names, scores = has_letter(piece), [], []
                for some, (found, count) in zip(letters, features(piece), strict=True):
                    if not some or not model.languages:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    p = model.probabilities(found, count)
                    best = int(p.argmax())
                    names.append(model.languages[best])
                    scores.append(float(p[best]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learned where crc32(doc_id) mod 3 is not 1."""
    model = train(docs, remainder(F.col("doc_id"), 3) != 1)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
