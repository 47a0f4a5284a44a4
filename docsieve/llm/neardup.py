"""MinHash near-duplicate groups with odd sketches.

A document's set holds the 64-bit codes of its distinct five-word shingles
(ASCII lower case; fewer words: the whole sequence as one shingle). Documents
link where 100 * |A & B| >= 75 * |A | B|; groups are the connected components.

1. One pass makes each document's set digest, 128 MinHash values in 32 bands of
   4, and an *odd sketch* (Mitzenmacher, Pagh and Pham, WWW 2014): each MinHash
   value flips one of 512 bits, so the population count of two sketches' XOR
   estimates the number of differing values, most precisely where similarity is
   high. Two sets of similarity 0.75 share no band with probability 5e-6.
2. Documents with equal sets form one class, whose least id stands for it: a
   group of exact copies costs one node, whatever its size.
3. Every band bucket links its members to a hub (its least node); only pairs
   whose sketches allow a similarity of 0.75 (within five standard deviations)
   remain, and the full sets, recomputed from the full texts, confirm or refuse
   each.
   Then, in buckets whose other members are not all in one component, every
   member outside the largest one is compared with every member: first with
   sketches, which give each its few closest of other components to confirm;
   a member that had more candidates than those meets all full sets of its
   bucket, which yields links only. Buckets are dealt in blocks of bounded
   size, none is capped, and no step writes a row for each pair.
4. Components come from components.py.

Null or empty texts have no shingles and link with nothing. Rows that share an
id are one document and fall into one component; rows without an id take no
part (component null, kept). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import stored

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_LONGS = 8
#: Most differing sketch bits of a pair that is still confirmed on full sets: at similarity 0.75 they are 57, with deviation 9.
MOST_BITS = 100
PERCENT = 75
TRIED = 3
BLOCK = 1024

_N = BANDS * ROWS
_XOR, _FACTOR = K.splitmix(_N, 41), K.splitmix(_N, 42) | np.uint64(1)
_NO_VALUE = np.uint64(0xFFFFFFFFFFFFFFFF)
SIGNATURE = f"doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, {', '.join(f's{i} long' for i in range(SKETCH_LONGS))}"


def shingle_sets(piece: K.Piece) -> list[np.ndarray]:
    """Each document's sorted distinct shingle codes."""
    found = K.words(piece, lower=True)
    codes, begin, _ = K.windows(found.code, found.first, SHINGLE)
    sets = []
    for i, n in enumerate(found.count):
        if n >= SHINGLE:
            sets.append(np.unique(codes[begin[i] : begin[i + 1]]))
        elif n:
            own = found.code[found.first[i] : found.first[i + 1]]
            sets.append(K.mix(np.atleast_1d((own * (K.splitmix(n, 29) | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(n))))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minhashes(codes: np.ndarray) -> np.ndarray:
    least = np.full(_N, _NO_VALUE)
    for at in range(0, len(codes), 512):
        np.minimum(least, ((codes[at : at + 512, None] ^ _XOR) * _FACTOR).min(axis=0), out=least)
    return least


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x longs) of MinHash values (documents x hashes)."""
    bits = 64 * SKETCH_LONGS
    place = (K.mix(values + K.splitmix(_N, 43)) % np.uint64(bits)).astype(np.int64) + bits * np.arange(len(values))[:, None]
    odd = (np.bincount(place.ravel(), minlength=bits * len(values)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(values), bits), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.pieces(batch.column(1)):
            sets = shingle_sets(piece)
            values = np.stack([minhashes(s) for s in sets])
            bands = K.mix((values.reshape(-1, BANDS, ROWS) * (K.splitmix(ROWS, 44) | np.uint64(1))).sum(axis=2, dtype=np.uint64) + K.splitmix(BANDS, 45))
            sketches = odd_sketches(values)
            # sums of spread codes: equal for equal sets, in whatever order
            digests = [np.array([K.mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (1 << 40, 1 << 41)]
            columns = [
                batch.column(0).slice(piece.lo, piece.n),
                pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(K.signed(d)) for d in digests),
                pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(K.signed(bands.ravel()))),
                *(pa.array(sketches[:, i]) for i in range(SKETCH_LONGS)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "bands", *(f"s{i}" for i in range(SKETCH_LONGS))])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, text_u, text_v), the (u, v) whose full sets are similar enough."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for piece in K.pieces(column):
            yield from shingle_sets(piece)

    for batch in batches:
        good = []
        for a, b in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
            both = np.intersect1d(a, b, assume_unique=True).size
            good.append(100 * both >= PERCENT * (a.size + b.size - both))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _close(left: str, right: str):
    """The sketches of two aliased rows differ in few enough bits."""
    return sum((F.bit_count(F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))) for i in range(SKETCH_LONGS)), F.lit(0)) <= MOST_BITS


class _Groups:
    """The steps over one table; every table that a later step reads is in the shared folder."""

    def __init__(self, texts: DataFrame, signatures: DataFrame):
        self.classes = stored(signatures.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
        own = signatures.join(self.classes.withColumnRenamed("node", "doc_id"), ["doc_id", "d1", "d2"], "left_semi")
        self.sketches = own.select(F.col("doc_id").alias("node"), *(f"s{i}" for i in range(SKETCH_LONGS)))
        rows = own.select(F.explode("bands").alias("band"), F.col("doc_id").alias("node"))
        shared = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("hub < last").select("band", "hub", "size")
        self.buckets = stored(rows.join(shared, "band"), "buckets")
        # only texts that share a band are ever compared: they move once
        nodes = self.buckets.select("node").distinct()
        self.texts = stored(texts.where("doc_id IS NOT NULL").join(nodes.hint("merge"), texts.doc_id == nodes.node, "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
        self.labels = None

    def labelled(self, nodes: DataFrame, key: str, label: str) -> DataFrame:
        """``nodes`` with the component so far of the node in column ``key``."""
        if self.labels is None:
            return nodes.withColumn(label, F.col(key))
        own = self.labels.select(F.col("node").alias(key), F.col("component").alias(label))
        return nodes.join(own, key, "left").withColumn(label, F.coalesce(label, key))

    def connect(self, links: DataFrame) -> None:
        """Brings the components up to date."""
        self.labels = components(links if self.labels is None else self.labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links))

    def confirm(self, pairs: DataFrame) -> None:
        """Connects those of ``pairs`` (u, v) whose full sets are similar enough."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        texts = self.texts.hint("merge")
        whole = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
        self.connect(stored(whole.select("u", "v", "text_u", "text_v").mapInArrow(_confirm, "u long, v long"), "links"))

    def star(self) -> None:
        """Compares the members of each bucket with its hub."""
        pairs = self.buckets.where("node <> hub").select("hub", "node").distinct().alias("p")
        both = pairs.join(self.sketches.alias("a"), F.col("p.hub") == F.col("a.node")).join(self.sketches.alias("b"), F.col("p.node") == F.col("b.node"))
        self.confirm(both.where(_close("a", "b")).select(F.col("p.hub").alias("u"), F.col("p.node").alias("v")))

    def left(self) -> DataFrame:
        """Members of buckets where all but the hub are in several components; those outside the largest ask."""
        rest = self.labelled(self.buckets.where("node <> hub").select("band", "node"), "node", "label")
        by_label = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = by_label.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("band", "main")
        return stored(rest.join(mixed, "band").select("band", "node", "label", (F.col("label") != F.col("main")).alias("asks")), "left")

    def nearby(self) -> None:
        """In the buckets that are left, confirms every asking member's few closest members of other components; then, of those that had more, every one."""
        members = self.left()
        found = stored(_dealt(members).join(self.sketches, "node").groupBy(*_DEAL).applyInPandas(_closest, "band long, u long, v long, more boolean"), "closest")
        self.confirm(found.select("u", "v"))
        more = found.where("more").select("band", F.col("u").alias("node")).distinct().withColumn("asks", F.lit(True))
        if more.isEmpty():
            return
        rest = members.select("band", "node").join(more.select("band").distinct(), "band", "left_semi").join(more, ["band", "node"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        open_ = stored(self.labelled(rest, "node", "label").select("band", "node", "label", "asks"), "open")
        self.connect(stored(_dealt(open_).join(self.texts.hint("merge"), "node").groupBy(*_DEAL).applyInPandas(_all_links, "u long, v long"), "links"))


_DEAL = ("large", "deal", "block", "part")


def _dealt(members: DataFrame) -> DataFrame:
    """Members (band, node, label, asks) in groups of bounded size where each asking member meets each member of its bucket once.

    Small buckets share a group; of a large one, every block of members meets every part of the asking ones.
    """
    rows = members.count()
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.greatest(F.lit(1).cast("long"), F.ceil(F.count_if("asks") / BLOCK).cast("long")).alias("parts"))
    one = F.lit(1).cast("long")
    large = (F.col("blocks") > 1) | (F.col("parts") > 1)
    placed = members.join(sizes, "band").withColumn("large", large).withColumn("deal", F.when(large, F.col("band")).otherwise(F.pmod("band", F.lit(1 + rows // (4 * BLOCK)))))
    spread = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    whole = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - one))
    own = ["large", "deal", "band", "node", "label"]
    fixed = placed.select(*own, spread(F.col("blocks"), 1).alias("block"), whole(F.col("parts")).alias("part"), F.lit(False).alias("asks"))
    asking = placed.where("asks").select(*own, whole(F.col("blocks")).alias("block"), spread(F.col("parts"), 2).alias("part"), F.lit(True).alias("asks"))
    return fixed.union(asking)


def _by_band(group: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame]]:
    """Each band of a group with its asking and its fixed members."""
    for band, rows in group.groupby("band", sort=True):
        asking = rows[rows.asks]
        if len(asking):
            yield band, asking, rows[~rows.asks]


def _closest(group: pd.DataFrame) -> pd.DataFrame:
    """Each asking member's TRIED closest members of other components, as far as their sketches are close, and whether there are more."""
    out = []
    names = [f"s{i}" for i in range(SKETCH_LONGS)]
    for band, asking, fixed in _by_band(group):
        bits, label, node = (fixed[names].to_numpy(np.int64).view(np.uint64), fixed.label.to_numpy(), fixed.node.to_numpy())
        for own, mine, u in zip(asking[names].to_numpy(np.int64).view(np.uint64), asking.label, asking.node, strict=True):
            far = np.where(label == mine, MOST_BITS + 1, np.bitwise_count(bits ^ own).sum(axis=1))
            near = np.flatnonzero(far <= MOST_BITS)
            best = near[np.lexsort((node[near], far[near]))][:TRIED]
            out += [(band, u, node[v], len(near) > TRIED) for v in best]
    return pd.DataFrame(out, columns=["band", "u", "v", "more"]).astype({"band": "int64", "u": "int64", "v": "int64", "more": "bool"})


def _all_links(group: pd.DataFrame) -> pd.DataFrame:
    """For each asking member one link, if there is any, to each other component among the fixed members."""
    out = []
    for _, asking, fixed in _by_band(group):
        sets = [s for piece in K.pieces(pa.array(fixed.text, pa.large_string())) for s in shingle_sets(piece)]
        size = np.array([len(s) for s in sets])
        codes, place = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        label, node = fixed.label.to_numpy(), fixed.node.to_numpy()
        asked = (s for piece in K.pieces(pa.array(asking.text, pa.large_string())) for s in shingle_sets(piece))
        for u, mine, own in zip(asking.node, asking.label, asked, strict=True):
            both = np.add.reduceat(np.isin(codes, own, assume_unique=True)[place].astype(np.int64), begin)
            linked = np.flatnonzero((label != mine) & (100 * both >= PERCENT * (size + len(own) - both)))
            _, first = np.unique(label[linked], return_index=True)
            out += [(u, node[v]) for v in linked[first]]
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; kept marks the least id of a component."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    signatures = stored(texts.mapInArrow(K.released(_signatures), SIGNATURE), "signatures")
    groups = _Groups(texts, signatures)
    groups.star()
    groups.nearby()
    classes = groups.labelled(groups.classes, "node", "component")
    own = signatures.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "component"), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return own.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
