"""The text scan over a table as a stream: the batch plan, micro-batch by micro-batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset, a temporary one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(folder or 'file://' + tempfile.mkdtemp(prefix='docsieve-')).rstrip('/')}/docsieve-{name}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, path: str, schema, plan, name: str) -> DataFrame:
    """Runs ``plan`` over all Parquet files at ``path`` as a stream, to the end, into the scratch folder; returns what it wrote."""
    source = spark.readStream.schema(schema).parquet(path)
    out = scratch(spark, name)
    rows = plan(source)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/_progress").outputMode("append").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
