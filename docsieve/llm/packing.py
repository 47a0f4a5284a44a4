"""Packing by lexical retrieval: sharded BM25 over token ids fills each window with neighbours.

1. Documents become token ids (a public BPE, then the end id 1), once, into a
   table in the shared folder.
2. Document frequencies and lengths over *all* documents give BM25 weights; the
   table has a row for each vocabulary entry, so its size is bounded.
3. Documents are range-partitioned by the hash of a salient term (then by id,
   so any number of documents with one term, or copies, spread evenly):
   neighbours tend to share a partition. A partition is worked off in shards
   of at most ``SHARD_TOKENS`` tokens (or one longer document), each with its
   inverted index in memory.
4. In a shard, a seed opens a window; its unused neighbours, best BM25 score
   first, fill it, however many that takes; a document that overflows is cut and
   its rest is the next window's seed. Only where no unused document of the shard
   shares a term with the seed, the next unused one follows. The last window of a
   shard is cut into powers of two, so nothing is padded.

A piece's sequence id holds the partition and a running number. Null and empty
texts are the end id alone. Repeated rows are packed one by one. A very long text
is a shard of its own, so memory follows the longest text. An empty table gives
no pieces. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import stored

WINDOW = 2048
END = 1
SHARD_TOKENS = 2_000_000
PARTITION_TOKENS = 8_000_000
QUERY_TERMS = 12
NEIGHBOURS = 64
ROUTE_TERMS = 4
K1, B = 1.2, 0.75
CACHED_WORDS = 400_000
NEVER = np.iinfo(np.int32).max
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 as itself, the others in order from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(others)}


#: Classes of bytes: white space, letters, numbers, all others, and the byte that ends a text.
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*range(9, 14), 0x20]] = _SPACE
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _NUMBER
_CLASS[0x80:0xFF] = _LETTER
_CLASS[0xFF] = _END
#: Classes of the characters U+0080 to U+00BF, by their second byte.
_CLASS_C2 = np.full(256, _OTHER, np.uint8)
_CLASS_C2[[0x85, 0xA0]] = _SPACE
_CLASS_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_CLASS_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
#: What may stand behind an apostrophe as a word with it: how many letters, by the first two.
_SHORT = np.zeros((256, 256), np.int64)
_SHORT[list(b"stmd")] = 1
for _pair in (b"re", b"ve", b"ll"):
    _SHORT[_pair[0], _pair[1]] = 2


def _low_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the UTF-8 of lower-case texts below U+0250, each closed by a byte 0xFF, which is a word too."""
    kind = _CLASS[data]
    if data.max(initial=0) >= 0x80:
        lead = np.flatnonzero(data == 0xC2)
        kind[lead] = kind[lead + 1] = _CLASS_C2[data[lead + 1]]
        signs = np.flatnonzero(data == 0xC3)
        signs = signs[(data[signs + 1] == 0x97) | (data[signs + 1] == 0xB7)]
        kind[signs] = kind[signs + 1] = _OTHER
    new = np.empty(len(data), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= (kind == _END) | ((kind == _NUMBER) & (data & 0xC0 != 0x80))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))
    first = kind[start]
    quote = np.flatnonzero((data[start] == ord("'")) & (end - start == 1))
    if len(quote):
        # the end of a text stands behind every word of it
        quote = quote[first[quote + 1] == _LETTER]
        at = start[quote + 1]
        taken = _SHORT[data[at], data[at + 1]]
        end[quote] += taken
        start[quote + 1] += taken
    some = np.flatnonzero((first != _SPACE) & (end > start))
    return start[some], end[some]


class WordTable:
    """Ids of words by their 64-bit codes, in two direct-address tables; a word that finds both places taken takes the second."""

    BITS = 21, 17

    def __init__(self):
        self.n = 1
        self.codes = np.zeros(1 << 16, np.uint64)
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.held = np.zeros(1 << 18, np.uint16), 1
        self.ids[0], self.size[0] = END, 1  # row 0 is the end of a text
        self.rows = [np.full(1 << b, -1, np.int32) for b in self.BITS]

    def places(self, code: np.ndarray) -> list[np.ndarray]:
        return [code >> np.uint64(64 - self.BITS[0]), code & np.uint64((1 << self.BITS[1]) - 1)]

    def find(self, code: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """The row of each word, -1 of unknown ones; 0 for those that ``closes`` marks."""
        row = self.rows[0][self.places(code)[0]]
        row[self.codes[row] != code] = -1
        row[closes] = 0
        left = np.flatnonzero(row < 0)
        other = self.rows[1][self.places(code[left])[1]]
        row[left] = np.where(self.codes[other] == code[left], other, -1)
        return row

    def add(self, code: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """New rows for distinct words."""
        grown = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])
        row = self.n + np.arange(len(code), dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u2")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        self.codes, self.first, self.size = (grown(x, self.n + len(code)) for x in (self.codes, self.first, self.size))
        self.ids = grown(self.ids, self.held + len(flat))
        self.codes[row], self.first[row], self.size[row] = code, self.held + np.cumsum(size) - size, size
        self.ids[self.held : self.held + len(flat)] = flat
        self.n, self.held = self.n + len(code), self.held + len(flat)
        place = self.places(code)
        free = np.flatnonzero(self.rows[0][place[0]] < 0)
        self.rows[0][place[0][free]] = row[free]
        late = np.flatnonzero(self.rows[0][place[0]] != row)
        self.rows[1][place[1][late]] = row[late]
        return row

    def joined(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows, and how many there are up to the end of each."""
        size = self.size[row]
        upto = np.cumsum(size)
        at = np.repeat(self.first[row] - (upto - size), size)
        at += np.arange(len(at))
        return self.ids[at], upto


class WordBpe:
    """Ids of the word-end BPE file as little-endian 16-bit bytes, word by word with a bounded cache.

    The file's rules: NFC, white space to one space, small letters, then words by
    the pattern below, each encoded alone; so a word's ids never depend on its
    neighbours. Texts below U+0250 need no normaliser but lower(); many of them are
    cut at once, by the classes of their bytes, and their words found by 64-bit
    codes (``WordTable``). Other texts are cut one by one. Words of up to
    ``TABLE`` bytes that are not in a cache are merged many at a time, a row of
    a table each. Texts that hold a special token's string go through the library.
    """

    _PARTS = r"{letter}+|'(?:s|t|re|ve|m|ll|d)|{number}|[^\t-\r \x85{space}{in_letter}{in_number}]+"
    TABLE = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.letters = _byte_letters()
        self.inner, self.last = (np.array([vocabulary[self.letters[b] + x] for b in range(256)], np.int32) for x in ("", end))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.all = regex.compile(self._PARTS.format(letter=r"\p{L}", number=r"\p{N}", space=r"\p{Z}", in_letter=r"\p{L}", in_number=r"\p{N}"))
        self.high = re.compile("[^\x00-ɏ]")
        self.cache: dict[str, bytes] = {}
        self.table = WordTable()

    def words(self, text: str) -> list[str]:
        return self.all.findall(self.tokenizer.normalizer.normalize_str(text))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When two symbols are merged, NEVER if they are not."""
        key = left.astype(np.int64) << 16 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of some words of similar length: each row merges its best pair, the leftmost first, until none is left."""
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size.max())
        raw = np.zeros((n, width), np.uint8)
        there = np.arange(width) < size[:, None]
        raw[there] = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        out, length, row = np.zeros((n, width), "<u2"), size.copy(), np.arange(n)
        rank = np.where(there[:, 1:], self.rank(symbol[:, :-1], symbol[:, 1:]), NEVER)
        while rank.size:
            best = rank.argmin(axis=1)
            when = rank[np.arange(len(row)), best]
            open_ = when < NEVER
            if not open_.all():
                out[row[~open_], : symbol.shape[1]] = symbol[~open_]
                row, symbol, rank, best, when = row[open_], symbol[open_], rank[open_], best[open_], when[open_]
            # each row loses a symbol, so the table loses a column
            each, n_left, width = np.arange(len(row)), len(row), symbol.shape[1]
            keep = np.ones(symbol.shape, bool)
            keep[each, best + 1] = False
            symbol = symbol[keep].reshape(n_left, width - 1)
            symbol[each, best] = self.merged[when]
            keep = np.ones(rank.shape, bool)
            keep[each, best] = False
            rank = rank[keep].reshape(n_left, width - 2)
            length[row] -= 1
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.rank(symbol[left, best[left] - 1], symbol[left, best[left]])
            right = np.flatnonzero(best < length[row] - 1)
            rank[right, best[right]] = self.rank(symbol[right, best[right]], symbol[right, best[right] + 1])
        out[row, : symbol.shape[1]] = symbol
        ids, step = out.tobytes(), 2 * out.shape[1]
        return [ids[i : i + 2 * k] for i, k in zip(range(0, len(ids), step), length.tolist(), strict=True)]

    def ids(self, raw: list[bytes]) -> list[bytes]:
        """The ids of some words."""
        out: list[bytes] = [b""] * len(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        size = size[order]
        short, at = int(np.searchsorted(size, self.TABLE, "right")), 0
        while at < short:
            upto = min(short, at + 4096, int(np.searchsorted(size, size[at] + 3, "right")))
            some = order[at:upto].tolist()
            for i, own in zip(some, self.merge([raw[i] for i in some]), strict=True):
                out[i] = own
            at = upto
        for i in order[short:].tolist():
            out[i] = np.array([t.id for t in self.tokenizer.model.tokenize(raw[i].decode("latin-1").translate(self.letters))], "<u2").tobytes()
        return out

    def encode_low(self, texts: list[str]) -> list[bytes]:
        """The ids, ends included, of texts in small letters below U+0250."""
        data = np.frombuffer(b"\xff".join([*map(str.encode, texts), b""]), np.uint8)
        start, end = _low_words(data)
        code = K.run_codes(data, start, end)
        closes = data[start] == 0xFF
        row = self.table.find(code, closes)
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new, first, inverse = np.unique(code[missing], return_index=True, return_inverse=True)
            if self.table.n + len(new) > CACHED_WORDS:
                self.table = WordTable()
                row = self.table.find(code, closes)
                missing = np.flatnonzero(row < 0)
                new, first, inverse = np.unique(code[missing], return_index=True, return_inverse=True)
            raw, a, b = data.tobytes(), start[missing[first]].tolist(), end[missing[first]].tolist()
            row[missing] = self.table.add(new, self.ids([raw[i:j] for i, j in zip(a, b, strict=True)]))[inverse]
        ids, upto = self.table.joined(row)
        ids, edges = ids.tobytes(), (2 * upto[closes]).tolist()
        return [ids[i:j] for i, j in zip([0, *edges[:-1]], edges, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        end = struct.pack("<H", END)
        out: list[bytes] = [end] * len(texts)
        low, high = {}, {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.special.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes() + end
            elif (small := text.lower()).isascii() or not self.high.search(small):
                low[i] = small
            else:
                high[i] = self.words(text)
        for i, ids in zip(low, self.encode_low(list(low.values())) if low else [], strict=True):
            out[i] = ids
        if high:
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            new = list(set().union(*high.values()).difference(self.cache))
            self.cache |= zip(new, self.ids(list(map(str.encode, new))), strict=True)
            for i, own in high.items():
                out[i] = b"".join(map(self.cache.__getitem__, own)) + end
        return out


@functools.cache
def _bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)  # a worker keeps it, with its cache, for its next task
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = bpe.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], names=["doc_id", "ids", "n"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each id; under the place after the last id, the number of tokens."""
    total, slot = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            ids = np.frombuffer(raw.as_buffer(), "<u2")
            place = np.arange(len(ids))
            slot[ids] = place  # of an id's places one stands there: that one counts
            total[ids[slot[ids] == place]] += 1
            total[-1] += len(ids)
    terms = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(total[terms])], names=["term", "df"])


@dataclass
class Corpus:
    """BM25's statistics of all documents: idf of each id, and the mean length."""

    idf: np.ndarray
    mean_length: float

    def weights(self, terms: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean_length))


def corpus_statistics(tokens: DataFrame) -> tuple[Corpus, int]:
    """The statistics, and the number of tokens."""
    rows = tokens.select("ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros((1 << 16) + 1)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    # every document holds the end id
    n, total = df[END], int(df[-1])
    return Corpus(np.log1p((n - df[:-1] + 0.5) / (df[:-1] + 0.5)), total / max(n, 1)), total


class Shard:
    """An inverted index of some documents' ids."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus):
        self.n = len(ids)
        length = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(self.n, dtype=np.int64), length)
        key, times = np.unique(doc << 16 | np.concatenate(ids).astype(np.int64), return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        weight = corpus.weights(term, times, length[doc])
        # a document's query: its terms, the weightiest first
        order = np.lexsort((term, -weight, doc))
        first = np.searchsorted(doc[order], np.arange(self.n + 1))
        self.query = [term[order[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange((1 << 16) + 1))
        self.unused = np.ones(self.n, bool)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Each unused document's BM25 score for a query of some terms."""
        scores = np.zeros(self.n)
        for t in terms:
            at = slice(self.first[t], self.first[t + 1])
            scores[self.doc[at]] += self.weight[at]
        scores[~self.unused] = 0
        return scores

    def neighbours(self, seed: int) -> Iterator[int]:
        """The unused documents that share a term with ``seed``, best first, ties by place.

        Those that share one of its ``QUERY_TERMS`` weightiest terms come first, the best ``NEIGHBOURS`` of them (and ties)
        before the others are even sorted; those that share only lighter terms follow. None is left out.
        """
        scores = self.scores(self.query[seed][:QUERY_TERMS])
        least = np.partition(scores, self.n - NEIGHBOURS)[self.n - NEIGHBOURS] if self.n > NEIGHBOURS else 0
        some = np.flatnonzero(scores >= least if least > 0 else scores)
        yield from some[np.lexsort((some, -scores[some]))].tolist()
        scores[some] = 0
        for terms in (None, self.query[seed][QUERY_TERMS:]):
            if terms is not None:
                scores = self.scores(terms)
            rest = np.flatnonzero(scores)
            yield from rest[np.lexsort((rest, -scores[rest]))].tolist()


def window_order(lengths: np.ndarray, shard: Shard) -> list[int]:
    """The documents in the order in which they fill windows."""
    order: list[int] = []
    after, at, n = 0, 0, len(lengths)  # tokens so far, where unused documents may begin

    def take(doc: int) -> None:
        nonlocal after
        shard.unused[doc] = False
        order.append(doc)
        after += int(lengths[doc])

    while True:
        if after % WINDOW == 0 or not order:
            while at < n and not shard.unused[at]:
                at += 1
            if at == n:
                return order
            take(at)
        seed, window = order[-1], after // WINDOW
        if after % WINDOW == 0:
            continue
        for doc in shard.neighbours(seed):
            take(doc)
            if after // WINDOW > window:
                break
        else:
            while at < n and not shard.unused[at]:
                at += 1
            if at == n:
                return order
            take(at)


def cuts(total: int) -> np.ndarray:
    """Where sequences begin in a shard's ``total`` tokens, and its end: whole windows, then powers of two."""
    at = list(range(0, total - total % WINDOW + 1, WINDOW))
    rest = total % WINDOW
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at.append(at[-1] + step)
        rest -= step
    return np.array(at)


def pack_shard(doc_ids: list, ids: list[np.ndarray], corpus: Corpus, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a shard's documents, and how many sequences they make."""
    lengths = np.array([len(x) for x in ids])
    order = np.array(window_order(lengths, Shard(ids, corpus)))
    begin = np.concatenate([[0], np.cumsum(lengths[order])])
    borders = cuts(int(begin[-1]))
    edges = np.union1d(begin, borders)
    place = np.searchsorted(begin, edges[:-1], "right") - 1
    sequence = np.searchsorted(borders, edges[:-1], "right") - 1
    start = edges[:-1] - begin[place]
    length = np.diff(edges)
    crc = [zlib.crc32(ids[order[p]][a : a + n].astype("<u4").tobytes()) for p, a, n in zip(place, start, length, strict=True)]
    docs = order[place]
    columns = [pa.array([doc_ids[d] for d in docs], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[docs]), pa.array(first_sequence + sequence), pa.array(edges[:-1] - borders[sequence])]
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")]), len(borders) - 1


def _routes(corpus: Corpus):
    """Adds each document's route: the least hash of its few weightiest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = K.signed(K.splitmix(1 << 16, 71))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [np.frombuffer(raw, "<u2") for raw in some.column(1).to_pylist()]
                length = np.array([len(x) for x in ids])
                key, times = np.unique(np.repeat(np.arange(len(ids)), length) << 16 | np.concatenate(ids).astype(np.int64), return_counts=True)
                doc, term = key >> 16, key & 0xFFFF
                order = np.lexsort((term, -corpus.weights(term, times, length[doc]), doc))
                place = np.arange(len(order)) - np.searchsorted(doc, doc)
                heavy = order[place < ROUTE_TERMS]
                routes = np.minimum.reduceat(code[term[heavy]], np.searchsorted(doc[heavy], np.arange(len(ids))))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(routes, pa.int64())], names=["doc_id", "ids", "n", "route"])

    return run


def _pack(corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and held + len(raw) // 2 > SHARD_TOKENS:
                    out, n = pack_shard(doc_ids, ids, corpus, sequence)
                    yield out
                    doc_ids, ids, held, sequence = [], [], 0, sequence + n
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, "<u2"))
                held += len(raw) // 2
        if ids:
            yield pack_shard(doc_ids, ids, corpus, sequence)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece of a document in a sequence."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    tokens = stored(texts.mapInArrow(K.released(_tokenise(tokenizer)), "doc_id long, ids binary, n long"), "tokens")
    corpus, total = corpus_statistics(tokens)
    routed = tokens.mapInArrow(_routes(corpus), "doc_id long, ids binary, n long, route long")
    parts = max(1, -(-total // PARTITION_TOKENS))
    near = routed.repartitionByRange(parts, "route", "doc_id").sortWithinPartitions("route", "doc_id", "n")
    return near.select("doc_id", "ids").mapInArrow(K.released(_pack(corpus)), SCHEMA)
