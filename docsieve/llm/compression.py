"""Quality rules: compression bands.

A text that zstandard shrinks far more than prose of its length repeats itself;
one that it hardly shrinks is noise. A document is kept if it passes the base
rules (at least 50 words; at most half of the words in repeated three-word
windows) and

* its whole-text ratio (compressed bytes / UTF-8 bytes) lies inside the limits
  for its length, and
* at most ``BAD_CHUNKS`` of its chunks lie outside the chunk limits, so a text
  cannot hide a repetitive or random part behind good prose. Texts under
  ``SHORT`` bytes are cut into smaller chunks.

Limits come from the ratios of all documents that pass the base rules, each
distinct text once: in a class of lengths (a quarter of an octave) they are the
median less ``BELOW`` and plus ``ABOVE`` interquartile ranges, which a minority
of junk hardly moves; chunks have limits of their own. A class of fewer than
``LEAST`` texts takes the looser limits of its neighbours (ratios fall with
length: the upper one of the next shorter class, the lower one of the next
longer), and where there is none ``BANDS``.

Null and empty texts have no words, fail the base rules and get ratio null.
Repeated rows are judged alike, each on its own. Texts are compressed once; what
is shuffled is a few codes of each distinct text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import stored

LEVEL = 3
CHUNK, SHORT_CHUNK = 2048, 512
SHORT = 2 * CHUNK
BAD_CHUNKS = 0.05
LEAST = 30
BELOW, ABOVE = 2.2, 2.5
#: (least bytes, least ratio, greatest ratio) where too few texts are of a length.
BANDS = ((0, 0.36, 1.00), (256, 0.32, 0.78), (512, 0.28, 0.70), (724, 0.28, 0.66), (1024, 0.25, 0.61), (1448, 0.25, 0.58), (2048, 0.22, 0.56), (4096, 0.20, 0.52), (16384, 0.16, 0.46))
#: Least ratio of a chunk there; the greatest is that of a text as long.
CHUNK_LOW = 0.22
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"
MEASURED = SCHEMA.replace("kept boolean, ", "").replace("bad_chunks double", "n_bytes long, codes array<int>, text_code long")
CLASSES, BINS = 256, 4096

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def chunks(text: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks; a last one of under half the size joins the one before."""
    n = max(1, (len(text) + size // 2) // size)
    return [text[i * size : (i + 1) * size if i < n - 1 else None] for i in range(n)]


def length_class(n_bytes: int) -> int:
    return int(4 * np.log2(n_bytes))


def code(chunk: bool, n_bytes: int, ratio: float) -> int:
    """Kind, class of length and thousandths of the ratio as one number."""
    return (chunk * CLASSES + length_class(n_bytes)) * BINS + min(BINS - 1, int(1000 * ratio))


def ratios(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[int]]:
    """Whole-text ratio, and the codes of the text and of its chunks."""
    whole = len(compressor.compress(text)) / len(text)
    parts = chunks(text, CHUNK if len(text) >= SHORT else SHORT_CHUNK)
    return whole, [code(False, len(text), whole), *(code(True, len(x), len(compressor.compress(x)) / len(x)) for x in parts)]


def limits(counts: dict[int, int]) -> np.ndarray:
    """(kind, class of length, 2) lower and upper limits, from how many distinct texts have each code."""
    table = np.zeros((2, CLASSES, BINS), np.int64)
    for k, n in counts.items():
        table.ravel()[k] = n
    out = np.empty((2, CLASSES, 2))
    for chunk in range(2):
        fitted = np.flatnonzero(table[chunk].sum(axis=1) >= LEAST)
        own = {}
        for c in fitted:
            upto = np.cumsum(table[chunk, c])
            low, middle, high = ((np.searchsorted(upto, share * upto[-1]) + 0.5) / 1000 for share in (0.25, 0.5, 0.75))
            own[c] = middle - BELOW * (high - low), middle + ABOVE * (high - low)
        for c in range(CLASSES):
            low, high = band(int(2 ** (c / 4) + 1e-6))
            shorter, longer = fitted[fitted <= c], fitted[fitted >= c]
            out[chunk, c, 0] = own[longer[0]][0] if len(longer) else CHUNK_LOW if chunk else low
            out[chunk, c, 1] = own[shorter[-1]][1] if len(shorter) else high
    return out


def base_counts(piece: K.Piece) -> dict[str, np.ndarray]:
    found = K.words(piece)
    inside = ~K.SEPARATOR[piece.data]
    start, end = K.spans(piece.data != 10, piece.offsets)
    has_word = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end = start[has_word], end[has_word]
    line_doc = np.searchsorted(piece.offsets, start, "right") - 1
    _, firsts = np.unique(K.in_document(K.run_codes(piece.data, start, end), line_doc), return_index=True)
    n_dup = np.bincount(line_doc, minlength=piece.n) - np.bincount(line_doc[firsts], minlength=piece.n)
    codes, begin, at = K.windows(found.code, found.first, 3)
    _, inverse, times = np.unique(K.in_document(codes, np.repeat(np.arange(piece.n), np.diff(begin))), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1] if len(at) else at
    repeated = np.zeros(len(found.code), bool)
    for k in range(3):
        repeated[again + k] = True
    return {
        "n_words": found.count,
        "word_chars": K.sums(inside & ((piece.data & 0xC0) != 0x80), piece.offsets),
        "n_symbols": K.sums(_SYMBOL[piece.data], piece.offsets),
        "n_dup_lines": n_dup,
        "n_repeat_words": K.sums(repeated, found.first),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for piece in K.pieces(batch.column(1)):
            out = {k: v.astype(np.int64) for k, v in base_counts(piece).items()}
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            raw = piece.data.tobytes()
            whole, codes = zip(*(ratios(raw[a:b], compressor) if b > a else (None, []) for a, b in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)), strict=True)
            ids, text_code = (batch.column(i).slice(piece.lo, piece.n) for i in (0, 2))
            columns = [ids, *(pa.array(v) for v in out.values()), pa.array(failed), pa.array(whole, pa.float64()), pa.array(np.diff(piece.offsets), pa.int64()), pa.array(codes, pa.list_(pa.int32())), text_code]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out, "base_failed", "ratio", "n_bytes", "codes", "text_code"])


def _judge(bounds: np.ndarray):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    flat = bounds.reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = ~batch["base_failed"].to_numpy(zero_copy_only=False)
            bad = np.zeros(len(kept))
            for i, (n, whole, codes) in enumerate(zip(batch["n_bytes"].to_pylist(), batch["ratio"].to_pylist(), batch["codes"], strict=True)):
                if not n:
                    continue
                place, ratio = np.divmod(codes.values.to_numpy()[1:], BINS)
                ratio = (ratio + 0.5) / 1000
                bad[i] = ((ratio < flat[place, 0]) | (ratio > flat[place, 1])).mean()
                low, high = bounds[0, length_class(n)]
                kept[i] &= low <= whole <= high and bad[i] <= BAD_CHUNKS
            own = {"kept": pa.array(kept), "bad_chunks": pa.array(bad)}
            yield pa.RecordBatch.from_arrays([own[x] if x in own else batch[x] for x in names], names=names)

    return run


def compression_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts, ratios and the verdict ``kept`` for every row of ``docs``."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = stored(texts.withColumn("text_code", F.xxhash64("text")).mapInArrow(_measure, MEASURED), "ratios")
    distinct = rows.where("NOT base_failed").select("text_code", "codes").dropDuplicates(["text_code"])
    counts = distinct.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    return rows.mapInArrow(_judge(limits({r.code: r.n for r in counts})), SCHEMA)
