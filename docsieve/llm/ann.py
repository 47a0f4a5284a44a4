"""Approximate nearest neighbours: the inverted multi-index (Babenko and Lempitsky, 2012).

Both halves of the vectors have a codebook of their own (k-means on a bounded
sample); a pair of centroids is a cell, and every row is indexed in its cell.
A query visits the centroid pairs by the sum of its two distances, which a heap
yields in order (the multi-sequence algorithm), until the visited cells hold
the probed share of all rows; all entries of those cells are then reranked by
the exact distance. That share is measured on the sample: of ``TRIALS`` rows of
it, the share that a query had to visit to meet ``WANTED`` of the true nearest
ones. Where vectors cluster it is small; where all are about equally far apart,
no index of cells can do with little, and it is about half of the rows.

Equal vectors of a cell are one entry with the ``K + 1`` least distinct ids: no further
copy can be among a query's ``K`` nearest, because those copies are as near and
come first. Repeated rows of an id and a vector count once everywhere. Entries are dealt by first-half centroid into blocks of bounded
size, queries likewise, and each pair of blocks is one task's matrix product;
it returns a few rows a query. So neither a hot cell, nor copies, nor the number
of queries grows what a task holds.

Vectors that are null, empty, zero, hold a null or non-finite component, or are
not as long as most of the sample take no part, as rows or as queries. Rows
that share an id are one row of several vectors, the nearest counts; the least
of them asks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SAMPLE = 16_384
ROUNDS = 8
TRIALS, WANTED = 256, 0.96
ENTRIES, QUERIES = 8192, 2048
#: Queries whose cells one task looks up.
VISITED = 64
EVERY = 100


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = assign(x, centres)[0]
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distances to all."""
    far = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
    return far.argmin(axis=1), np.maximum(far, 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Cells (first, second) as a mask, by ascending sum of distances until they hold ``wanted`` rows."""
    first, second = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[first].tolist(), d2[second].tolist()
    size = sizes[np.ix_(first, second)].tolist()
    taken = np.zeros(sizes.shape, bool)
    row_next = [0] * len(a)  # in each row, cells before this one are done
    heap = [(a[0] + b[0], 0, 0)]
    held = 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        row_next[i] = j + 1
        if size[i][j]:
            held += size[i][j]
            taken[first[i], second[j]] = True
        # a cell enters once the cells before it in its row and its column are done
        if j + 1 < len(b) and (i == 0 or row_next[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and row_next[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return taken


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]


def fit(vectors: list[list[float]], n: int) -> tuple[Codebooks, float] | None:
    """Codebooks from sampled vectors, for an index of ``n`` rows (a few rows a cell, 256 centroids at most), and the share to probe."""
    if not vectors:
        return None
    lengths = [len(v) for v in vectors]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    x = np.array([v for v in vectors if len(v) == dim], float)
    k = int(np.clip(2 ** round(np.log2(max(1.0, (n / 2) ** 0.5))), 2, 256))
    half = (dim + 1) // 2
    books = Codebooks(kmeans(x[:, :half], k, 1), kmeans(x[:, half:], k, 2) if dim > half else np.zeros((1, 0)))
    return books, probe(x, books)


def probe(x: np.ndarray, books: Codebooks) -> float:
    """The share of the rows that a query visits, cell by cell, until it has met ``WANTED`` of its nearest among ``x``."""
    a, b = books.halves(x)
    c1, c2 = assign(a, books.first)[0], assign(b, books.second)[0]
    square = (x**2).sum(axis=1)
    shares = []
    for i in range(0, len(x), max(1, len(x) // TRIALS)):
        d1, d2 = assign(a[i : i + 1], books.first)[1][0], assign(b[i : i + 1], books.second)[1][0]
        way = d1[c1] + d2[c2]
        far = square - 2 * x @ x[i]
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(K, len(x) - 1)]
        shares += [np.count_nonzero(way <= w) / len(x) for w in way[near]]
    return float(np.quantile(shares, WANTED)) if shares else 1.0


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector can take part, in double precision."""
    v = vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def _cells(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, books.dim)
            a, b = books.halves(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(assign(a, books.first)[0], pa.int32()), pa.array(assign(b, books.second)[0], pa.int32())], names=["vec_id", "v", "c1", "c2"])

    return run


def _visits(books: Codebooks, sizes: np.ndarray, wanted: int):
    """For each query and first-half centroid with visited cells, those cells' second-half centroids as bytes 0 or 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, books.dim)
            a, b = books.halves(x)
            d1, d2 = assign(a, books.first)[1], assign(b, books.second)[1]
            row, c1, seconds = [], [], []
            for i in range(len(x)):
                taken = multi_sequence(d1[i], d2[i], sizes, wanted)
                for c in np.flatnonzero(taken.any(axis=1)):
                    row.append(i)
                    c1.append(c)
                    seconds.append(taken[c].tobytes())
            some = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(c1, pa.int32()), pa.array(seconds, pa.binary())], names=["vec_id", "v", "c1", "seconds"])

    return run


def _rerank(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Each query's nearest ids among the visited entries of a block."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    if not len(entries) or not len(queries):
        return none
    x, c2 = np.stack(entries.v.to_numpy()).astype(float), entries.c2.to_numpy()
    ids = entries.ids.to_numpy()
    square = (x**2).sum(axis=1)
    out = []
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        q = np.stack(some.v.to_numpy()).astype(float)
        seen = np.stack([np.frombuffer(s, np.uint8) for s in some.seconds])[:, c2].astype(bool)
        far = np.where(seen, (q**2).sum(axis=1)[:, None] + square - 2 * q @ x.T, np.inf)
        n = min(K + 1, len(x))
        bound = np.partition(far, n - 1, axis=1)[:, n - 1]
        for i, query in enumerate(some.vec_id):
            # all that rounding could bring among the nearest, with exact distances
            wanted, limit = n, bound[i]
            while True:
                near = np.flatnonzero((far[i] <= limit + 1e-9 * (1 + abs(limit))) & seen[i])
                exact = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
                best: dict[int, float] = {}
                for d, v in sorted((d, v) for d, e in zip(exact, near, strict=True) for v in ids[e] if v != query):
                    best.setdefault(v, d)
                if len(best) >= K or wanted == len(x) or limit == np.inf:
                    break
                # several vectors of one id are among the nearest entries: look further
                wanted = min(4 * wanted, len(x))
                limit = np.partition(far[i], wanted - 1)[wanted - 1]
            out += [(query, v, d) for v, d in list(best.items())[:K]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else none


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the K nearest of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    one = F.xxhash64("vec_id", "v").alias("row")
    n = rows.select(one).distinct().count()
    sample = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    fitted = fit(sample, n)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books, share = fitted
    rows = rows.where(F.size("v") == books.dim)
    cells = rows.mapInArrow(_cells(books), "vec_id long, v array<double>, c1 int, c2 int")
    copy = F.dense_rank().over(Window.partitionBy("c1", "c2", "v").orderBy("vec_id"))
    entries = cells.withColumn("copy", copy).where(F.col("copy") <= K + 1).groupBy("c1", "c2", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    sizes = np.zeros((len(books.first), len(books.second)), np.int64)
    by_cell = cells.select("c1", "c2", one).distinct().groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 256 x 256 rows
    for r in by_cell:
        sizes[r.c1, r.c2] = r.n
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.repartition(max(1, -(-n // (every * VISITED))), "vec_id")
    visits = asked.mapInArrow(_visits(books, sizes, int(np.ceil(n * share))), "vec_id long, v array<double>, c1 int, seconds binary")
    of_first = F.element_at(F.array(*(F.lit(int(max(1, -(-s // ENTRIES)))) for s in sizes.sum(axis=1))), F.col("c1") + 1)
    parts = max(1, -(-n // (every * QUERIES)))
    whole = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("c2", "v"), of_first).cast("int")).withColumn("part", whole(F.lit(parts)))
    asking = visits.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", whole(of_first))
    keys = ["c1", "block", "part"]
    found = dealt.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(_rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
