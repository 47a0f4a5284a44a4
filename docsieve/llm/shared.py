"""Tables, hold-outs and shared scratch tables of the operators' queries."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import release as release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text mod ``n``; -1 (so in no held-out fold) where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docsieve-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or f"file://{_own_folder()}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/docsieve-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session has ended first: the folder's owner clears it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of text that a sample for the driver holds.
SAMPLE_BYTES = 32 << 20


def one_text_each(rows: DataFrame, limit: int = SAMPLE_BYTES) -> pa.Table:
    """The ``rows`` (doc_id, text, ...) of a sample, sorted by id: the least text of an id, and at most ``limit`` bytes of whole texts, those of least id hash.

    The rows go through a table in the shared folder, so texts that are left out never reach the driver.
    """
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    found = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text"), *(F.min(c).alias(c) for c in others)), "sample")
    sizes = found.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").toArrow()
    upto = np.cumsum(sizes["n"].fill_null(0).to_numpy())
    if len(upto) and upto[-1] > limit:
        found = found.where(F.col("doc_id").isin(sizes["doc_id"].to_numpy()[: max(1, int(np.searchsorted(upto, limit, "right")))].tolist()))
    return found.toArrow().sort_by([("doc_id", "ascending")])


def labelled_sample(docs: DataFrame, known: DataFrame, n0: int, n1: int) -> tuple[pa.Table, float]:
    """Texts and labels of at most ``n0`` and ``n1`` rows of label 0 and 1, and the share of label 1 among all.

    ``known`` (doc_id, label) is reduced to the ids of least hash before it meets
    the texts, so the driver gets no more rows than asked for, sorted by id. An id with several
    labels has the greatest, one with several texts the least of them; in all, at most ``SAMPLE_BYTES`` of texts.
    """
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    count, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    ids = []
    for label, n in ((0, n0), (1, n1)):
        ids += [(r.doc_id, label) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "id long, label int")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), texts.doc_id == chosen.id).select("doc_id", "text", "label")
    return one_text_each(found), (ones or 0) / max(1, count)
