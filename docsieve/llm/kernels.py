"""Vectorised text kernels shared by the operators.

Every kernel works on the UTF-8 bytes of an Arrow string column, whole
documents at a time and in pieces of a quarter of a megabyte, so a Python worker holds
a bounded working set however large its partition is (one document is never
split: memory also follows the longest single text).

A *word* is a maximal run of bytes other than space and 0x09-0x0D, that is
``[^\\x20\\x09-\\x0D]+``; bytes of a multi-byte character are never separators,
so byte and character splitting agree.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18


def release() -> None:
    """Gives memory that is done with back to the system, where the C library can: else a process keeps its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run):
    """``run`` over batches, and its memory given back at the end: workers wait for their next task beside others at work."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers (the SplitMix64 sequence)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection that spreads every bit."""
    z = np.asarray(z, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """``LOWER[data]``, by arithmetic: numpy widens every byte of a large index."""
    capital = (data - np.uint8(ord("A"))) < np.uint8(26)
    return data | (capital.view(np.uint8) << np.uint8(5))


def in_word(data: np.ndarray) -> np.ndarray:
    """``~SEPARATOR[data]``, by arithmetic."""
    return (data != np.uint8(0x20)) & ((data - np.uint8(9)) > np.uint8(4))


@dataclass
class Piece:
    """Some whole documents: ``data[offsets[i]:offsets[i + 1]]`` are the bytes of row ``lo + i``."""

    lo: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The column's texts in pieces of about ``limit`` bytes; null is the empty text."""
    done = 0
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        if not len(array):
            continue
        raw = array.buffers()
        ends = np.frombuffer(raw[1], np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(array):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
            yield Piece(done + lo, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            lo = hi
        done += len(array)


@dataclass
class Words:
    """Words of a piece in order: 64-bit code, byte span, and for document ``i`` the slice ``first[i]:first[i + 1]``."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that cross no document border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    borders = offsets[:-1][offsets[:-1] < len(inside)]
    before[borders] = False
    after[borders[borders > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


#: Byte masks of the first 0-8 bytes of a little-endian block, and starting values by a run's length.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_RUN = 64
_LENGTHS = splitmix(LONG_RUN + 1, 11)


def run_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each byte run; equal runs have equal codes.

    Runs of one length up to 8 bytes never share a code. Up to ``LONG_RUN`` bytes,
    blocks of 8 are mixed in one after the other, each spread before it meets the
    rest, so no pattern of bytes cancels as in a polynomial; longer runs take
    BLAKE2b.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    block = np.zeros((len(data) + 23) // 8, np.uint64)
    block.view(np.uint8)[: len(data)] = data

    def blocks(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        shift = ((at & 7) << 3).astype(np.uint64)
        low = block[at >> 3] >> shift
        high = (block[(at >> 3) + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (low | high) & _MASKS[np.minimum(size, 8)]

    size = end - start
    out = mix(blocks(start, size) ^ _LENGTHS[np.minimum(size, LONG_RUN)])
    left = np.flatnonzero((size > 8) & (size <= LONG_RUN))
    at = 8
    while len(left):
        out[left] = mix(out[left] ^ mix(blocks(start[left] + at, size[left] - at) + np.uint64(0x9E3779B97F4A7C15)))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def words(piece: Piece, lower: bool = False) -> Words:
    data = lowered(piece.data) if lower else piece.data
    start, end = spans(in_word(data), piece.offsets)
    return Words(run_codes(data, start, end), start, end, np.searchsorted(start, piece.offsets))


def windows(codes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all ``n``-word windows inside a document, each document's slice as in Words, and each window's first word."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(splitmix(n, 23) | np.uint64(1)):
        total += codes[at + k] * factor
    return mix(total), begin, at


def signed(codes: np.ndarray) -> np.ndarray:
    return np.asarray(codes, np.uint64).view(np.int64)


def in_document(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Codes that are equal only for equal codes of the same document."""
    return mix(codes ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's slice."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals U+00C0-U+00DE made small."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capitals = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[capitals] += 0x20
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters (a-z and all bytes of other scripts) of folded text as words."""
    start, end = spans(_LETTER[data], offsets)
    return Words(run_codes(data, start, end), start, end, np.searchsorted(start, offsets))


def prefix_codes(data: np.ndarray, found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the first ``n`` bytes of the words longer than that, and those words' places."""
    longer = np.flatnonzero(found.end - found.start > n)
    return mix(run_codes(data, found.start[longer], found.start[longer] + n) + np.uint64(n)), longer


class Slots:
    """Places of some 64-bit codes, looked up through a direct-address table."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.asarray(codes, np.uint64)
        self.bits = max(8, int(2 * len(self.codes)).bit_length() + 3)
        self.table = np.full(1 << self.bits, -1, np.int32)
        place = (self.codes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table[place[::-1]] = np.arange(len(place), dtype=np.int32)[::-1]
        late = np.flatnonzero(self.table[place] != np.arange(len(place)))
        self.rest = dict(zip(self.codes[late].tolist(), late.tolist(), strict=True))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for others."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        place = self.table[codes >> np.uint64(64 - self.bits)]
        hit = (place >= 0) & (self.codes[place] == codes)
        if self.rest:
            for i in np.flatnonzero(~hit & (place >= 0)):
                place[i] = self.rest.get(int(codes[i]), -1)
                hit[i] = place[i] >= 0
        return np.where(hit, place, -1)


def row_filter(verdict, text_at: int):
    """For mapInArrow: whole rows for which ``verdict(piece)``, a mask over a piece's documents, holds."""

    def run(batches):
        for batch in batches:
            masks = [verdict(piece) for piece in pieces(batch.column(text_at))]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return released(run)
