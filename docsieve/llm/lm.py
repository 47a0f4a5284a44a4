"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Words (ASCII lower case, then one end token a text) are events of a
class-factored softmax:

* a *symbol*: the end, one of the most frequent training words, or the class of
  another word (its last two bytes, then how frequent it is). The log-bilinear
  model (Mnih and Hinton, 2007; Mnih and Teh, 2012) predicts a symbol from the
  ``CONTEXT`` before it: position weights scale the vectors of the words there,
  the sum meets every symbol's vector in a matrix product, and a softmax over
  all symbols normalises it;
* the word inside its class: the same sum meets the vectors of the class's
  *trained* words under a second softmax. A word is trained, with vectors of its own as context
  and as target, if it occurs in the training texts at least ``TRAINED`` times,
  or root(tokens) / ``ROOT`` times if that is more: the vocabulary has no
  greatest size, it grows with the corpus about as its root, so it fits a task.
  The number of classes grows with it, and classes of frequent words are small;
* a rare word, in the class of all rare words of its suffix, by the base model's smoothed training
  counts, where one share stands for all unknown words. So a text's
  probabilities are normalised over the same events as the base score's.

Counts cover all training texts. Training starts on the driver from a bounded
sample (``WARM_TEXTS`` texts, ``shared.SAMPLE_BYTES`` at most) and then runs over
*every* training text: each task improves the model on its own tokens, and each
vector is averaged over the tasks that met it, by how often they did, ``ROUNDS``
times. The most frequent ``FREQUENT`` counts, and those of all trained words, are
broadcast; rarer words meet theirs in a join, where no key is hot.

Word identity is a 64-bit code. Null and empty texts are the end alone. Repeated
rows are counted and scored one by one. A very long text is a piece of its own,
read whole. An empty table gives no rows. Other columns are not read. With no
training text every count is 0 and every symbol equally likely.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import one_text_each, release, remainder, stored

HEAD, BUCKETS = 31, 64
DIM = 24
CONTEXT = 4
NOISE, INNER_NOISE = 64, 8
#: Classes for each root of the number of trained words.
CLASSES = 0.67
TRAINED, ROOT = 20, 100
#: Places whose sums over symbols, or words of a class, are taken at once: they stay in a core's own memory.
BLOCK = 512
#: Tokens of one step, and words of a class that share noise draws in it.
BATCH, SHARED = 2048, 16
ROUNDS = 1
WARM_TEXTS, WARM_EPOCHS = 400, 4
RATE = 0.15
FREQUENT = 1 << 18
ALPHA = 0.1
MERGE_AT = 1 << 20


def tokens(piece: K.Piece) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """Code and suffix bucket of every word, and the words."""
    found = K.words(piece, lower=True)
    last = K.LOWER[piece.data[found.end - 1]].astype(np.uint64)
    before = np.where(found.end - found.start > 1, K.LOWER[piece.data[np.maximum(found.end - 2, 0)]], 0).astype(np.uint64)
    return found.code, (K.mix(last + (before << np.uint64(8))) % np.uint64(BUCKETS)).astype(np.int64), found


@dataclass
class Vocabulary:
    """Training counts: of all tokens, end tokens, frequent words, symbols, and by suffix bucket of words that are not trained.

    The first ``HEAD`` codes are symbols, those from there to ``trained`` words with vectors in their class,
    ``word_class``. Inside the classes each event has a row, class by class: the trained words, then one for each
    bucket's rare words, which are a class of their own, ``rare_class``.
    """

    total: int
    distinct: int
    ends: int
    codes: np.ndarray
    counts: np.ndarray
    trained: int
    all_words: bool
    symbol_counts: np.ndarray
    rare_counts: np.ndarray
    rare_distinct: np.ndarray
    rare_class: np.ndarray
    rare_event: np.ndarray
    word_class: np.ndarray
    event: np.ndarray
    event_counts: np.ndarray
    first_event: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def among_rare(self, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.rare_counts[buckets] + ALPHA * (self.rare_distinct[buckets] + 1)))

    @functools.cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, event (-1 for none) and place as context of the end, the trained words, then each bucket's rare words."""
        symbols = 1 + min(HEAD, self.trained)
        out = np.concatenate([np.arange(symbols), 1 + HEAD + self.word_class, 1 + HEAD + self.rare_class])
        event = np.concatenate([np.full(symbols, -1), self.event, self.rare_event])
        return out, event, np.where(event >= 0, 1 + HEAD + event, out)

    @property
    def light(self) -> Vocabulary:
        """What training needs."""
        return replace(self, codes=self.codes[: self.trained], counts=self.counts[: self.trained])


@dataclass
class Stream:
    """Tokens of some texts, ends included.

    ``out`` is each token's symbol, ``event`` its event inside a class (-1 for none). ``source`` holds what
    the tokens are as context, with ``CONTEXT`` ends before each text, and ``at`` each token's place there.
    ``begin`` is where texts begin among the tokens.
    """

    out: np.ndarray
    event: np.ndarray
    source: np.ndarray
    at: np.ndarray
    begin: np.ndarray


def stream(place: np.ndarray, buckets: np.ndarray, first: np.ndarray, words: Vocabulary) -> Stream:
    """The tokens of texts whose words have the ``place`` among the counted words, -1 for none."""
    n = len(first) - 1
    begin = first + np.arange(n + 1)
    word = np.ones(begin[-1], bool)
    word[begin[1:] - 1] = False
    kind = np.zeros(begin[-1], np.int64)
    kind[word] = 1 + np.where((place >= 0) & (place < words.trained), place, words.trained + buckets)
    out, event, context = (k.take(kind) for k in words.kinds)
    at = np.arange(begin[-1]) + np.repeat(CONTEXT * np.arange(1, n + 1), np.diff(begin))
    source = np.zeros(begin[-1] + CONTEXT * n, np.int64)
    source[at] = context
    return Stream(out, event, source, at, begin)


@dataclass
class Noise:
    """Shares of the symbols, and of the events inside each class: ``first[c]`` to ``first[c + 1]`` are those of class c."""

    symbol: np.ndarray
    event: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        self.upto = np.cumsum(self.symbol)
        self.event_upto = np.concatenate([[0.0], np.cumsum(self.event)])
        self.log_symbol = np.log(NOISE * self.symbol).astype(np.float32)
        self.log_event = np.log(INNER_NOISE * self.event).astype(np.float32)
        # where a search among the sums may begin, for several bins an event; each edge is taken a little lower, so no rounding passes it
        bins = 1 << (4 * len(self.event)).bit_length()
        self.bins = bins / self.event_upto[-1]
        self.begin = np.maximum(np.searchsorted(self.event_upto, (np.arange(bins + 1) - 1e-3) / self.bins, "right") - 1, 0).astype(np.int32)
        self.event_end = np.append(self.event_upto[1:-1], np.inf)

    def events(self, at: np.ndarray) -> np.ndarray:
        """The events in whose shares the places ``at`` of the running sum lie."""
        found = self.begin.take((at * self.bins).astype(np.int64), mode="clip").astype(np.int64)
        late = np.flatnonzero(self.event_end.take(found) <= at)
        while len(late):
            found.flat[late] += 1
            late = late[self.event_end.take(found.flat[late]) <= at.flat[late]]
        return found


@dataclass
class Bilinear:
    """Vectors of words as context, position weights, and vectors of symbols and of events inside classes as targets, whose last column is a bias."""

    source: np.ndarray
    target: np.ndarray
    position: np.ndarray
    inner: np.ndarray
    first: np.ndarray
    squares: list[np.ndarray] = field(default_factory=list)
    met: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def fresh(noise: np.ndarray, event: np.ndarray, first: np.ndarray) -> Bilinear:
        """For the shares of the symbols and of the events in their classes."""
        rng = np.random.default_rng(17)
        draw = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        targets = lambda share: np.concatenate([draw(len(share)), np.log(share)[:, None].astype(np.float32)], axis=1)
        return Bilinear(draw(1 + HEAD + len(event)), targets(noise), np.full((CONTEXT, DIM), 0.5, np.float32), targets(event), first)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.source, self.target, self.position, self.inner]

    def copy(self) -> Bilinear:
        return Bilinear(*(p.copy() for p in self.parts), self.first, [s.copy() for s in self.squares])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """For each place the sum of the scaled ``vectors`` before it, and a 1 for the biases."""
        q = np.empty((len(vectors), DIM + 1), np.float32)
        q[:, DIM] = 1
        # whole blocks of factors: numpy is slow at rows as short as a vector
        factors = np.repeat(self.position[:, None], min(BLOCK, len(vectors)), axis=1)
        scaled = np.empty_like(factors[0])
        for a in range(0, len(vectors), BLOCK):
            b = min(a + BLOCK, len(vectors))
            own = np.zeros((b - a, DIM), np.float32)
            for k in range(1, CONTEXT + 1):
                before = vectors[max(a - k, 0) : max(b - k, 0)]
                n = len(before)
                own[b - a - n :] += np.multiply(before, factors[k - 1, :n], out=scaled[:n])
            q[a:b, :DIM] = own
        return q

    def log_probabilities(self, q: np.ndarray, out: np.ndarray, event: np.ndarray | None = None) -> np.ndarray:
        """log10 of the normalised probability, after contexts of the sums ``q``, of each symbol of ``out``, and of its ``event`` inside the class."""
        q = q * np.float32(1 / np.log(2))  # powers of 2 are faster than exponentials
        found = np.einsum("nd,nd->n", q, self.target.take(out, axis=0)).astype(np.float64)
        sizes = np.diff(self.first)
        buffer = np.empty(BLOCK * max(len(self.target), int(sizes.max(initial=0))), np.float32)
        sums = np.empty(len(out), np.float64)
        for at in range(0, len(out), BLOCK):
            sums[at : at + BLOCK] = _log_sums(q[at : at + BLOCK], self.target, buffer)
        found -= sums
        if event is not None:
            rows = np.flatnonzero(event >= 0)
            rows = rows[sizes[out[rows] - 1 - HEAD] > 1]
            rows = rows[_order(out[rows])]
            inside, sums = q.take(rows, axis=0), sums[: len(rows)]
            edges = np.searchsorted(out[rows], 1 + HEAD + np.arange(len(self.first)))
            for c in np.flatnonzero(np.diff(edges)):
                events = self.inner[self.first[c] : self.first[c + 1]]
                for at in range(edges[c], edges[c + 1], BLOCK):
                    some = slice(at, min(at + BLOCK, edges[c + 1]))
                    sums[some] = _log_sums(inside[some], events, buffer)
            found[rows] += np.einsum("nd,nd->n", inside, self.inner.take(event[rows], axis=0)) - sums
        return found * np.log10(2)

    def learn(self, some: Stream, a: int, b: int, noise: Noise, rng: np.random.Generator) -> None:
        """One noise-contrastive step (AdaGrad) on the tokens from ``a`` to ``b``: symbols against draws that serve all of them, words against draws that serve up to ``SHARED`` words of their class."""
        out, event, at = some.out[a:b], some.event[a:b], some.at[a:b]
        ids, at = some.source[at[0] - CONTEXT : at[-1] + 1], at - at[0] + CONTEXT
        # tokens of one symbol, so words of one class, stand together
        order = _order(out)
        out, event, at = out[order], event[order], at[order]
        drawn = np.minimum(np.searchsorted(noise.upto, rng.random(NOISE) * noise.upto[-1]), len(noise.symbol) - 1)
        seen = self.source.take(ids, axis=0)
        q = self.queries(seen).take(at, axis=0)
        wanted, others = self.target.take(out, axis=0), self.target.take(drawn, axis=0)
        g_yes = _slope(np.einsum("nd,nd->n", q, wanted) - noise.log_symbol[out]) - 1
        shifted = others.copy()
        shifted[:, DIM] -= noise.log_symbol[drawn]
        g_no = _slope(q @ shifted.T)
        dq = g_no @ others
        wanted *= g_yes[:, None]
        dq += wanted
        begin = _changes(out)
        d_target, hit = np.zeros_like(self.target), np.zeros(len(self.target), bool)
        d_target[out[begin]] = np.add.reduceat(g_yes[:, None] * q, begin, axis=0)
        np.add.at(d_target, drawn, g_no.T @ q)
        hit[out[begin]] = hit[drawn] = True
        met = np.flatnonzero(hit)
        steps = [(self.target, 1, met, d_target.take(met, axis=0))]
        sizes = np.diff(self.first)
        inside = np.searchsorted(out, 1 + HEAD) + np.flatnonzero(sizes[out[out > HEAD] - 1 - HEAD] > 1)
        if len(inside):
            if inside[-1] - inside[0] < len(inside):  # rare words' classes stand last, so mostly a slice
                inside = slice(inside[0], inside[-1] + 1)
            own = out[inside] - 1 - HEAD
            # groups of up to SHARED words of one class, as rows of a table
            starts = _changes(own)
            rank = np.arange(len(own)) - np.repeat(starts, np.diff(starts, append=len(own)))
            column = rank % SHARED
            leads = column == 0
            place = (np.cumsum(leads) - 1) * SHARED + column
            classes = own[leads]
            first, last = self.first[classes][:, None], self.first[classes + 1][:, None]
            low, high = noise.event_upto[first], noise.event_upto[last]
            others = np.clip(noise.events(low + rng.random((len(classes), INNER_NOISE)) * (high - low)), first, last - 1)
            q_own = q[inside]
            q_in = np.zeros((len(classes), SHARED, DIM + 1), np.float32)
            q_in.reshape(-1, DIM + 1)[place] = q_own
            word = event[inside]
            own_vectors, vectors = self.inner.take(word, axis=0), self.inner.take(others, axis=0)
            s_yes = _slope(np.einsum("nd,nd->n", q_own, own_vectors) - noise.log_event[word]) - 1
            shifted = vectors.copy()
            shifted[:, :, DIM] -= noise.log_event[others]
            s_no = _slope(q_in @ shifted.transpose(0, 2, 1))
            s_no *= q_in[:, :, DIM:]  # nothing stands in the columns that a group leaves free
            own_vectors *= s_yes[:, None]
            own_vectors += (s_no @ vectors).reshape(-1, DIM + 1).take(place, axis=0)
            dq[inside] += own_vectors
            d_inner = np.empty((len(word) + others.size, DIM + 1), np.float32)
            np.multiply(s_yes[:, None], q_own, out=d_inner[: len(word)])
            np.matmul(s_no.transpose(0, 2, 1), q_in, out=d_inner[len(word) :].reshape(len(classes), INNER_NOISE, DIM + 1))
            steps.append((self.inner, 3, *_summed(np.concatenate([word, others.ravel()]), d_inner)))
        spread = np.zeros_like(seen)
        spread[at] = dq[:, :DIM]
        d_seen, d_position = np.zeros_like(seen), np.zeros_like(self.position)
        for k in range(1, CONTEXT + 1):
            d_seen[:-k] += spread[k:] * self.position[k - 1]
            d_position[k - 1] = np.einsum("nd,nd->d", spread[k:], seen[:-k])
        steps += [(self.source, 0, *_summed(ids, d_seen)), (self.position, 2, np.arange(CONTEXT), d_position)]
        if not self.squares:
            self.squares = [np.full_like(p, 1e-4) for p in self.parts]
        if not self.met:
            self.met = [np.zeros(len(p), np.int64) for p in self.parts]
        for part, i, own, g in steps:
            g /= np.float32(len(out))
            self.met[i][own] += 1
            square = self.squares[i].take(own, axis=0)
            square += g * g
            self.squares[i][own] = square
            np.sqrt(square, out=square)
            g /= square
            g *= np.float32(RATE)
            part[own] = np.subtract(part.take(own, axis=0), g, out=g)

    def train(self, some: Stream, noise: Noise, rng: np.random.Generator) -> None:
        """Steps over portions of the tokens as they stand in the texts."""
        for a in range(0, len(some.out), BATCH):
            self.learn(some, a, min(a + BATCH, len(some.out)), noise, rng)


def _slope(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _log_sums(q: np.ndarray, targets: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    """The binary logarithm of each row's sum of powers of 2 over all ``targets``; the products stand in the ``buffer``."""
    logits = np.matmul(q, targets.T, out=buffer[: len(q) * len(targets)].reshape(len(q), len(targets)))
    ones = np.ones(len(targets), np.float32)
    with np.errstate(over="ignore"):
        sums = np.exp2(logits, out=logits) @ ones
    if 1e-30 < sums.min(initial=1) and sums.max(initial=1) < 1e30:
        return np.log2(sums, dtype=np.float64)
    np.matmul(q, targets.T, out=logits)
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    return np.log2(np.exp2(logits, out=logits) @ ones, dtype=np.float64) + top[:, 0]


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and each one's sum of values."""
    order = _order(rows)
    ordered = rows[order]
    begin = _changes(ordered)
    out = values.take(order[begin], axis=0)
    # most rows stand alone: only the others are summed
    size = np.diff(begin, append=len(rows))
    several = np.flatnonzero(size > 1)
    if len(several):
        size = size[several]
        upto = np.cumsum(size)
        places = np.repeat(begin[several] - (upto - size), size) + np.arange(upto[-1])
        out[several] = np.add.reduceat(values.take(order[places], axis=0), upto - size, axis=0)
    return ordered[begin], out


def _order(rows: np.ndarray) -> np.ndarray:
    """The stable order of some numbers from 0 on: numbers that hold their places are sorted faster than places by numbers."""
    bits = len(rows).bit_length()
    if int(rows.max(initial=0)) >> (63 - bits):
        return np.argsort(rows, kind="stable")
    return np.sort(rows.astype(np.int64) << bits | np.arange(len(rows))) & ((1 << bits) - 1)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal codes stand together, and where each run of them begins.

    Codes are sorted by as many of their bits as their places leave free: others may, by a rare chance, split a run.
    """
    bits = np.uint64(len(codes).bit_length())
    order = (np.sort(codes >> bits << bits | np.arange(len(codes), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return order, _changes(codes[order])


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, bucket, n) of words, merged in bounded portions; a code may stand in several rows."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, bucket, n = (np.concatenate(p) for p in zip(*parts, strict=True))
        order, begin = _runs(code)
        first = order[begin]
        return code[first], bucket[first], np.add.reduceat(n[order], begin) if len(begin) else n

    def rows(code: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(K.signed(code)), pa.array(bucket), pa.array(n)], names=["code", "bucket", "n"])

    held = 0
    for batch in batches:
        for piece in K.pieces(batch.column(0)):
            code, bucket, _ = tokens(piece)
            order, begin = _runs(code)
            first = order[begin]
            parts.append((code[first], bucket[first], np.diff(begin, append=len(code))))
            held += len(first)
            if held > MERGE_AT:
                parts = [merged()]
                held = len(parts[0][0])
                if held > MERGE_AT // 2:
                    yield rows(*parts[0])
                    parts, held = [], 0
    if parts:
        yield rows(*merged())


def _frequent(counts: DataFrame, total: int) -> tuple[pa.Table, int]:
    """The words of the greatest counts, ``FREQUENT`` of them or, if those are more, all trained ones, and how many are trained.

    A histogram of the counts says from which one on words are taken, so no task sorts or merges words of others.
    """
    step = F.floor(F.log2("n") * 64)
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least = max(TRAINED, int(np.ceil(total**0.5 / ROOT)))
    held, from_step = 0, None
    for r in histogram:
        if held + r.words > FREQUENT:
            break
        held, from_step = held + r.words, r.step
    taken = (F.col("n") >= least) | (F.lit(False) if from_step is None else step >= from_step)
    top = counts.where(taken).toArrow().sort_by([("n", "descending"), ("code", "ascending")])
    return top, int(np.count_nonzero(top["n"].to_numpy() >= least))


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The counts of the training ``texts``, and the table (code, bucket, n) of all their words."""
    counts = stored(texts.select("text").mapInArrow(_count, "code long, bucket long, n long").groupBy("code").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")), "counts")
    ends = texts.count()
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total += ends
    top, often = _frequent(counts, total)
    codes, n, bucket = top["code"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["bucket"].to_numpy()
    trained = min(len(codes), max(HEAD, often))
    rare, rare_distinct = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        rare[row.bucket] = row.n
        rare_distinct[row.bucket] = row.v
    np.subtract.at(rare, bucket[:trained], n[:trained])
    np.subtract.at(rare_distinct, bucket[:trained], 1)
    # a bucket's trained words, most frequent first, are cut into classes of equal sums of roots of their counts:
    # that makes the classes of frequent words small, and the mean size of a token's class least
    own, weight = bucket[HEAD:trained], n[HEAD:trained] ** 0.5
    mass = np.bincount(own, weight, BUCKETS)
    wanted = max(BUCKETS, CLASSES * len(own) ** 0.5)
    cuts = np.where(mass > 0, np.maximum(1, np.round(wanted * mass / max(mass.sum(), 1e-9))), 0).astype(np.int64)
    order = np.argsort(own, kind="stable")
    upto = np.cumsum(weight[order]) - weight[order] - (np.cumsum(mass) - mass)[own[order]]
    tier = np.clip(upto / mass[own[order]] * cuts[own[order]], 0, cuts[own[order]] - 1).astype(np.int64)
    # tiers that no word begins in are left out
    word_class, event = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    word_class[order] = np.unique(own[order] * (1 + cuts.max(initial=0)) + tier, return_inverse=True)[1]
    event[order] = np.arange(len(own))
    n_classes = int(word_class.max(initial=-1)) + 1
    first_event = np.concatenate([[0], np.cumsum(np.bincount(word_class, minlength=n_classes)), len(own) + np.arange(1, BUCKETS + 1)])
    event_counts = np.concatenate([n[HEAD:trained][order], rare])
    symbol = np.zeros(1 + HEAD + n_classes + BUCKETS)
    symbol[0] = ends
    symbol[1 : 1 + len(n[:HEAD])] = n[:HEAD]
    np.add.at(symbol, 1 + HEAD + word_class, n[HEAD:trained])
    symbol[1 + HEAD + n_classes :] = rare
    return Vocabulary(total, distinct + (ends > 0), ends, codes, n, trained, len(codes) == distinct, symbol, rare, rare_distinct, n_classes + np.arange(BUCKETS), len(own) + np.arange(BUCKETS), word_class, event, event_counts, first_event), counts


def _noise(words: Vocabulary) -> Noise:
    symbol = words.symbol_counts + 0.5
    event = words.event_counts + 0.5
    inside = np.add.reduceat(event, words.first_event[:-1])
    return Noise(symbol / symbol.sum(), event / np.repeat(inside, np.diff(words.first_event)), words.first_event)


def _learn_pieces(model: Bilinear, words: Vocabulary, slots: K.Slots, noise: Noise, rng: np.random.Generator, column: pa.Array | pa.ChunkedArray) -> None:
    for piece in K.pieces(column):
        code, bucket, found = tokens(piece)
        model.train(stream(slots.find(code), bucket, found.first, words), noise, rng)


VECTORS = "part int, row long, met long, value binary"


def _improve(model: Bilinear, words: Vocabulary, noise: Noise):
    """The vectors that each task changed on its own texts, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slots, rng = model.copy(), K.Slots(words.codes), np.random.default_rng(19)
        for batch in batches:
            _learn_pieces(own, words, slots, noise, rng, batch.column(0))
        for i, (p, met) in enumerate(zip(own.parts, own.met, strict=False)):
            rows = np.flatnonzero(met)
            for at in range(0, len(rows), 1 << 16):
                some = rows[at : at + (1 << 16)]
                yield _vectors(np.full(len(some), i), some, met[some], p[some].reshape(len(some), -1))

    return run


def _vectors(part: np.ndarray, row: np.ndarray, met: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    value = np.ascontiguousarray(value, "<f4")
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * value.shape[1]), len(row), [None, pa.py_buffer(value)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(row, pa.int64()), pa.array(met, pa.int64()), raw], names=[f.split()[0] for f in VECTORS.split(", ")])


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of one part."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each vector by how often its tasks met it; all rows of one vector are in one partition."""
    keys: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        part, row, met = (batch.column(i).to_numpy() for i in range(3))
        for i in np.unique(part):
            some = np.flatnonzero(part == i)
            value = _values(batch.column(3).take(pa.array(some))).astype(np.float64)
            value = np.concatenate([value * met[some, None], met[some, None]], axis=1)
            if i in keys:
                keys[i], sums[i] = _summed(np.concatenate([keys[i], row[some]]), np.concatenate([sums[i], value]))
            else:
                keys[i], sums[i] = _summed(row[some], value)
    for i, rows in keys.items():
        yield _vectors(np.full(len(rows), i), rows, sums[i][:, -1], sums[i][:, :-1] / sums[i][:, -1:])


def train(texts: DataFrame, words: Vocabulary) -> Bilinear:
    """The model after a warm start on a bounded sample and ROUNDS passes over all ``texts``."""
    noise, words = _noise(words), words.light
    model, slots, rng = Bilinear.fresh(noise.symbol, noise.event, noise.first), K.Slots(words.codes), np.random.default_rng(18)
    ids = [r.doc_id for r in texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_TEXTS).collect()]
    sample = one_text_each(texts.where(F.col("doc_id").isin(ids)).select("doc_id", "text"))
    for _ in range(WARM_EPOCHS):
        _learn_pieces(model, words, slots, noise, rng, sample["text"])
    for _ in range(ROUNDS):
        rows = texts.select("text").mapInArrow(K.released(_improve(model, words, noise)), VECTORS).repartition("part", "row").mapInArrow(_averaged, VECTORS).toArrow()
        part, row = rows["part"].to_numpy(), rows["row"].to_numpy()
        for i, p in enumerate(model.parts):
            some = np.flatnonzero(part == i)
            if len(some):
                p[row[some]] = _values(rows["value"].take(pa.array(some))).reshape(p[row[some]].shape)
    model.squares, model.met = [], []
    del sample, slots
    release()
    return model


PARTIAL = "row long, doc_id long, n_tokens long, n_known long, base double, model double, tail_code array<long>, tail_bucket array<long>, tail_n array<long>"


def _score(model: Bilinear, words: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context_ = TaskContext.get()
        row = (context_.partitionId() if context_ else 0) << 40
        slots = K.Slots(words.codes)
        base, own_event = words.base(words.counts), np.arange(len(words.codes)) < words.trained
        end = words.base(np.array([words.ends]))[0]
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                code, bucket, found = tokens(piece)
                place = slots.find(code)
                some = stream(place, bucket, found.first, words)
                log_p = model.log_probabilities(model.queries(model.source.take(some.source, axis=0)).take(some.at, axis=0), some.out, some.event)
                known = place >= 0
                extra = np.zeros(len(code))
                inside = known & ~own_event[place] if len(own_event) else np.zeros(len(code), bool)
                extra[inside] = words.among_rare(words.counts[place[inside]], bucket[inside])
                base_known = np.zeros(len(code))
                base_known[known] = base[place[known]]
                fold = lambda v: _fold(v, found.first)
                doc = found.doc[~known]
                key, first, inverse = np.unique(K.in_document(code[~known], doc), return_index=True, return_inverse=True)
                times = np.bincount(inverse, minlength=len(key))
                order = np.lexsort((K.signed(code[~known][first]), doc[first]))
                offsets = pa.array(np.searchsorted(doc[first][order], np.arange(piece.n + 1)), pa.int32())
                tail = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v[first][order], pa.int64()))
                columns = [
                    pa.array(row + np.arange(piece.n)),
                    batch.column(0).slice(piece.lo, piece.n),
                    pa.array(found.count + 1),
                    pa.array(_fold(known.astype(float), found.first).astype(np.int64) + int(words.ends > 0)),
                    pa.array(fold(base_known) + end),
                    pa.array(np.add.reduceat(log_p, some.begin[:-1]) + fold(extra)),
                    tail(K.signed(code[~known])),
                    tail(bucket[~known]),
                    pa.ListArray.from_arrays(offsets, pa.array(times[order], pa.int64())),
                ]
                row += piece.n
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PARTIAL.split(", ")])

    return run


def _fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each document's words, added in order of the words."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some])
    return out


def score(docs: DataFrame, model: Bilinear, words: Vocabulary, counts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``docs``."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    partial = stored(texts.mapInArrow(K.released(_score(model, words)), PARTIAL), "partial")
    tail = partial.select("row", F.explode(F.arrays_zip("tail_code", "tail_bucket", "tail_n")).alias("t")).select("row", F.col("t.tail_code").alias("code"), F.col("t.tail_bucket").alias("bucket"), F.col("t.tail_n").alias("times"))
    if words.all_words:  # the broadcast table holds every count
        found = tail.withColumn("c", F.lit(0).cast("long"))
    else:
        least = int(words.counts[-1])
        rare = counts.where(F.col("n") <= least).select("code", F.col("n").alias("c"))
        found = tail.join(rare, "code", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    size = F.element_at(F.array(*(F.lit(float(n + ALPHA * (v + 1))) for n, v in zip(words.rare_counts, words.rare_distinct, strict=True))), (F.col("bucket") + 1).cast("int"))
    whole = words.total + ALPHA * (words.distinct + 1)
    sums = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + ALPHA) / F.lit(whole))).alias("b"),
        F.sum(F.col("times") * F.log10((F.col("c") + ALPHA) / size)).alias("m"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
    )
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = partial.select("row", "doc_id", "n_tokens", "n_known", "base", "model").join(sums, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + of("k")).alias("n_known"), (F.col("base") + of("b")).alias("base_score"), (F.col("model") + of("m")).alias("score"))


def language_model(docs: DataFrame, fold: Column | None = None) -> tuple[Bilinear, Vocabulary, DataFrame]:
    """Model, vocabulary and counts from the rows of ``docs`` (doc_id, text) for which ``fold`` holds."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    texts = texts if fold is None else texts.where(fold)
    words, counts = vocabulary(texts)
    return train(texts, words), words, counts


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); crc32(doc_id) mod 10 = 0 is held out."""
    held = remainder(F.col("doc_id"), 10) == 0
    model, words, counts = language_model(docs, ~held)
    out = score(docs, model, words, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
