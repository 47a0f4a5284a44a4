"""Toxicity by weak supervision.

1. *Voters.* Terms (words, and word beginnings of 4-8 bytes, of folded text) that
   mark labelled toxic texts, ranked by the likelihood-ratio statistic G2 and
   ``MIN_LIFT`` times as frequent there as in clean ones, are
   lexicon voters: each votes on a text that holds its term. Shares of capitals,
   exclamation marks and symbols give pattern voters. The recorded label is no
   voter: it only finds the lexicon and says which of the two classes is toxic.
2. *Label model.* Expectation maximisation of a two-class generative model gives
   each voter's vote rates in both classes. The correlations of voters given
   the class come from what the model leaves unexplained; a voter's evidence is
   divided by its correlated company, and the model is estimated again. All
   silences together weigh no more than that no voter votes.
3. *Classifier.* A linear (logistic) model over term presence and the pattern
   shares learns the posterior labels; it alone scores. So a wrong label costs
   little: its text's voters outvote it (tests compare with raw labels).

The model is fitted on at most ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` labelled
rows, those of least id hash, and at most ``shared.SAMPLE_BYTES`` of their texts,
which bounds what the driver holds; scoring is row-local over every whole text.

Null and empty texts hold no term and get the score of that. An id with several
labels counts as toxic if any says so, one with several texts is learned from
the least of them; repeated rows are scored one by one. A very long text is
scored whole, as a piece of its own. An empty table gives no rows. Other columns
are not read, so their names do not matter. With no labelled row every score is
0; with labels of one class it is that class's.
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

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 3000
PREFIXES = (4, 5, 6, 7, 8)
MIN_DOCS = 3
#: Terms are first counted in this many bits of their code, to drop the rare ones early.
SKIP_BITS = 22
MAX_VOTERS = 400
MIN_G2 = 15.0
#: A voter's share of the toxic texts is at least this many times its share of the clean ones: common words of long texts, or of a
#: language, pass ``MIN_G2`` in large samples, and the label model would find those texts in place of the toxic ones.
MIN_LIFT = 3.0
MAX_FEATURES = 2048
#: The share of either class that is taken to hold no voter's term, if fewer are seen.
MISSED = 0.02
#: Correlation given the class from which voters count as saying the same.
COMPANY = 0.5
PATTERN_CUTS = (0.5, 0.01, 0.02)
SCHEMA = "doc_id long, score double, predicted int"

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@~^")] = True


def terms(piece: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of every word and word beginning, repeats included."""
    data = K.folded(piece.data)
    found = K.letter_runs(data, piece.offsets)
    doc = found.doc
    codes, docs = [found.code], [doc]
    for n in PREFIXES:
        code, at = K.prefix_codes(data, found, n)
        codes.append(code)
        docs.append(doc[at])
    return np.concatenate(codes), np.concatenate(docs)


def patterns(piece: K.Piece) -> np.ndarray:
    """Shares of capitals among letters, and of exclamation marks and symbols among bytes."""
    size = np.maximum(np.diff(piece.offsets), 1)
    capitals = K.sums(_CAPITAL[piece.data], piece.offsets)
    letters = np.maximum(K.sums((piece.data | 0x20) - np.uint8(ord("a")) < 26, piece.offsets), 1)
    return np.stack([capitals / letters, K.sums(piece.data == ord("!"), piece.offsets) / size, K.sums(_SYMBOL[piece.data], piece.offsets) / size], axis=1)


def g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Signed likelihood-ratio statistic of terms in ``a`` of ``n1`` and ``b`` of ``n0`` texts."""
    rate = (a + b) / (n1 + n0)
    part = lambda seen, due: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9))
    value = 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))
    return np.where(a * n0 > b * n1, value, -value)


@dataclass
class LabelModel:
    """Vote rates (voters x classes), each voter's weight, the prior of class 1, and the rates of no vote at all (``MISSED`` at least).

    Silences are no independent evidence either: words of several languages, say, shut each other out. So all of
    them together are worth no more than it is that nobody votes.
    """

    rates: np.ndarray
    weights: np.ndarray
    prior: float
    silent: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.rates), np.log1p(-self.rates)
        quiet = self.weights * (no[:, 1] - no[:, 0])
        if self.silent is not None and quiet.sum() < 0:
            quiet = quiet * np.clip(np.log(self.silent[1] / self.silent[0]) / quiet.sum(), 0, 1)
        evidence = votes @ (self.weights * (yes[:, 1] - yes[:, 0]) - quiet) + quiet.sum() + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """P(vote agrees with the class), a vote meaning class 1 and silence class 0."""
        return self.prior * self.rates[:, 1] + (1 - self.prior) * (1 - self.rates[:, 0])


def fit_label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """The generative model of ``votes`` (texts x voters) and its voters' correlations given the class.

    The vote rates under ``start`` count as much as the texts do, so that the
    classes stay toxic and clean and do not drift to, say, languages.
    """
    both = np.stack([1 - start, start], axis=1)
    anchor = (votes.T @ both + 0.1) / (both.sum(axis=0) + 0.2)
    nobody = votes.sum(axis=1) == 0

    def em(weights: np.ndarray, posterior: np.ndarray) -> tuple[LabelModel, np.ndarray]:
        for _ in range(rounds):
            both = np.stack([1 - posterior, posterior], axis=1)
            sizes = both.sum(axis=0)
            rates = np.clip((votes.T @ both + anchor * sizes) / (2 * sizes + 1e-9), 1e-4, 1 - 1e-4)
            model = LabelModel(rates, weights, prior, np.clip(nobody @ both / (sizes + 1e-9), MISSED, 1))
            posterior = model.posterior(votes)
        return model, posterior

    _, posterior = em(np.full(votes.shape[1], 1 / max(1.0, votes.sum(axis=1).mean())), start)
    both = np.stack([1 - posterior, posterior], axis=1)
    rates = (votes.T @ both) / np.maximum(both.sum(axis=0), 1e-9)
    left = votes - both @ rates.T
    scale = np.sqrt(np.maximum((left**2).sum(axis=0), 1e-9))
    correlations = (left.T @ left) / np.outer(scale, scale)
    weights = 1 / np.maximum(1.0, np.where(correlations > COMPANY, correlations, 0).sum(axis=1))
    model, _ = em(weights, posterior)
    return model, correlations


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 3e-5, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of soft labels ``y``, by Adam on the whole sample."""
    w, first, second = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        g = np.append((p - y).astype(x.dtype) @ x / len(y) + penalty * w[:-1], (p - y).mean())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    codes: np.ndarray
    weights: np.ndarray
    pattern_weights: np.ndarray
    intercept: float
    label_model: LabelModel | None = None

    def scores(self, piece: K.Piece, slots: K.Slots) -> np.ndarray:
        code, doc = terms(piece)
        place = slots.find(code)
        hit = place >= 0
        key = np.unique(doc[hit] * max(1, len(self.codes)) + place[hit])
        total = self.intercept + patterns(piece) @ self.pattern_weights
        if len(key):
            total += np.bincount(key // len(self.codes), self.weights[key % len(self.codes)], minlength=piece.n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(texts: pa.Array, toxic: np.ndarray, toxic_share: float) -> Model:
    """The model of some labelled texts; ``toxic_share`` is the share of toxic rows among all labelled ones."""
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(3), 30.0 if n1 else -30.0)
    least_docs = min(MIN_DOCS, n1)
    held = np.zeros(1 << SKIP_BITS, np.int32)
    short = lambda code: (code >> np.uint64(64 - SKIP_BITS)).astype(np.int64)

    def distinct(piece: K.Piece) -> tuple[np.ndarray, np.ndarray]:
        code, doc = terms(piece)
        _, first = np.unique(K.in_document(code, doc), return_index=True)
        return code[first], doc[first]

    shares, minima = [], []
    salts = K.splitmix(4, 53)
    for piece in K.pieces(texts):
        code, doc = distinct(piece)
        least = np.full((len(salts), piece.n), np.uint64(0xFFFFFFFFFFFFFFFF))
        for row, salt in zip(least, salts, strict=True):
            np.minimum.at(row, doc, K.mix(code ^ salt))
        minima.append(least)
        shares.append(patterns(piece))
        np.add.at(held, short(code), 1)
    release()
    # most terms are in one text alone and can be no voter: a second pass leaves them out
    codes, docs = [], []
    for piece in K.pieces(texts):
        code, doc = distinct(piece)
        often = held[short(code)] >= least_docs
        codes.append(code[often])
        docs.append((doc[often] + piece.lo).astype(np.int32))
    code, doc, share = np.concatenate(codes), np.concatenate(docs), np.concatenate(shares)
    del codes, docs, held
    release()
    vocabulary = np.unique(code)
    term = np.searchsorted(vocabulary, code).astype(np.int32)
    del code
    # near copies would give the terms of one text many voices: texts with the same few MinHash values share one
    alike = np.zeros(len(toxic), np.uint64)
    for least in np.concatenate(minima, axis=1):
        alike = K.mix(alike + least)
    _, same, times = np.unique(alike, return_inverse=True, return_counts=True)
    voice = 1 / times[same]
    a = np.bincount(term, (toxic * voice)[doc], len(vocabulary))
    b = np.bincount(term, ((1 - toxic) * voice)[doc], len(vocabulary))
    rank = g2(a, b, (toxic * voice).sum(), ((1 - toxic) * voice).sum())
    rank[a + b < least_docs] = 0
    # a mark of toxicity, not of length or language
    marks = a * ((1 - toxic) * voice).sum() >= MIN_LIFT * b * (toxic * voice).sum()
    voters = np.argsort(-np.where(marks, rank, 0), kind="stable")[:MAX_VOTERS]
    voters = voters[marks[voters]]
    voters = voters[rank[voters] >= MIN_G2] if (rank[voters] >= MIN_G2).any() else voters[:20][rank[voters[:20]] > 0]
    chosen = np.union1d(np.argsort(-np.abs(rank), kind="stable")[:MAX_FEATURES], voters)
    column = np.full(len(vocabulary), -1)
    column[chosen] = np.arange(len(chosen))
    codes = vocabulary[chosen]
    known = column[term] >= 0
    rows, columns = doc[known], column[term[known]]
    del doc, term, known
    release()
    # term presence, and the pattern shares in the last columns
    x = np.zeros((len(toxic), len(chosen) + len(PATTERN_CUTS)), np.float32)
    x[rows, columns] = 1
    x[:, len(chosen) :] = share
    votes = np.concatenate([x[:, column[voters]], (share > PATTERN_CUTS).astype(np.float32)], axis=1)
    start = np.where(toxic > 0, 0.9, np.where(votes[:, : len(voters)].sum(axis=1) > 1, 0.3, 0.05))
    label_model, _ = fit_label_model(votes, start, n1 / (n1 + n0))
    weights, intercept = fit_logistic(x, label_model.posterior(votes))
    shift = np.log(max(toxic_share, 1e-6) / max(1 - toxic_share, 1e-6)) - np.log(n1 / n0)
    return Model(codes, weights[:-3], weights[-3:], intercept + shift, label_model)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = K.Slots(model.codes)
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                s = model.scores(piece, slots)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, piece.n), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(K.released(run), SCHEMA)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    slots = K.Slots(model.codes)
    return docs.mapInArrow(K.row_filter(lambda piece: model.scores(piece, slots) < 0.5, docs.columns.index(text)), docs.schema)


def train(docs: DataFrame, labels: DataFrame, fold: Column) -> Model:
    """Fits the model on a bounded sample of the rows of ``labels`` for which ``fold`` holds."""
    known = labels.where(fold & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    sample, share = labelled_sample(docs, known.select("doc_id", F.col("toxic").alias("label")), SAMPLE_CLEAN, SAMPLE_TOXIC)
    model = fit(sample["text"], np.asarray(sample["label"], np.int64), share)
    del sample
    release()
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels are learned where crc32(doc_id) mod 5 is not 0."""
    model = train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
