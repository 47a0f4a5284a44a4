"""Scan jobs as a stream of landed files (STM-01 to STM-08, SNK-04, SNK-06).

A file lands as ``<job id>.<suffix>`` by write-then-rename; the checkpointed
source gives each file to exactly one committed batch (claim), the stateless
scan judges it, and the sink's folder of the batch is its publication: written
under the batch's number and replaced as a whole when a batch is repeated.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.preflight import is_job_id, upload_suffix
from ..functions.verdict import result_json
from ..operators.rendered import Adapters
from ..operators.rules import LimitExceeded
from ..plans.contract import Limits
from ..sources.files import bounded, plain_path, scan_bounded

SOURCE = "path string, modificationTime timestamp, length long, content binary"


def create(folder: str, filename: str, content: bytes, limits: Limits | None = None) -> str:
    """STM-01: lands a job's file, whole and flushed to disk before it can be seen; returns its id. More than the upload bound is refused."""
    if len(content) > (limits or Limits()).upload_bytes:
        raise LimitExceeded
    ending = os.path.splitext(filename)[1].lower()
    job = uuid.uuid4().hex
    hidden = os.path.join(folder, f".{job}")
    with open(hidden, "xb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.rename(hidden, os.path.join(folder, job + (ending or ".unsupported")))
    return job


def jobs(landed: DataFrame) -> DataFrame:
    """(job_id, name, content) of landed files whose name is a job's (FLT-03, FLT-04)."""
    base = F.element_at(F.split(plain_path(F.col("path")), "/"), -1)
    job = F.regexp_extract(base, r"^([^.]*)", 1)
    return landed.select(job.alias("job_id"), F.concat(job, upload_suffix(base)).alias("name"), "content", "length").where(is_job_id(F.col("job_id")))


def judged(landed: DataFrame, limits: Limits | None = None, adapters: Adapters | None = None) -> DataFrame:
    """STM-04: the published row of each job; a job that fails or is too large to be read is a quarantined row, not a failed query."""
    limits = limits or Limits()
    out = scan_bounded(jobs(bounded(landed, limits)), limits, adapters)
    return out.select("job_id", result_json(F.col("result")).alias("result"), F.col("result.risk_level").alias("risk_level"), "derivative")


def run(spark: SparkSession, folder: str, sink: str, checkpoint: str, once: bool = True, maximum: int | None = None, limits: Limits | None = None, adapters: Adapters | None = None) -> StreamingQuery:
    """STM-02 to STM-07: processes landed jobs, all present ones (``once``) or every half second."""
    source = spark.readStream.format("binaryFile").schema(SOURCE)
    if maximum:
        source = source.option("maxFilesPerTrigger", maximum)

    def publish(batch: DataFrame, number: int) -> None:
        rows = judged(batch, limits, adapters)
        # a derivative is published with a low result only, whatever a scan says
        rows.withColumn("derivative", F.when(F.col("risk_level") == "low", F.col("derivative"))).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = source.load(folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="500 milliseconds").start()


PUBLISHED = "job_id string, result string, risk_level string, derivative string, batch int"


def published(spark: SparkSession, sink: str) -> DataFrame:
    """All published rows; none before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], PUBLISHED)
    return spark.read.schema(PUBLISHED).parquet(sink)


def status(spark: SparkSession, folder: str, sink: str) -> DataFrame:
    """STM-08: (job_id, status) of every landed job."""
    landed = jobs(spark.read.format("binaryFile").schema(SOURCE).load(folder)).select("job_id")
    done = published(spark, sink).select("job_id").distinct().withColumn("done", F.lit(True))
    return landed.join(done, "job_id", "left").select("job_id", F.when(F.col("done"), "complete").otherwise("pending").alias("status"))


def processed(spark: SparkSession, sink: str) -> int:
    """AGG-09: how many jobs have been published."""
    return published(spark, sink).select("job_id").distinct().count()


def lookup(spark: SparkSession, sink: str, job_id: str) -> DataFrame:
    """SNK-06: a job's result, and its derivative where it has one."""
    return published(spark, sink).where(F.col("job_id") == job_id).select("job_id", "result", "derivative")
