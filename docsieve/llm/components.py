"""Connected components of a distributed edge list, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Edges never reach the driver: a round is two aggregations and two joins, its
result is written to the shared folder, and only a row count and a checksum
tell whether it changed anything. Minima are pre-aggregated before a shuffle;
the joins leave hub nodes to the adaptive skew-join split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import drop, new_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the least of them; here v < u in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) can reach, for nodes that are not it."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before, old = None, None
    while True:
        path = new_path(spark, "stars")
        seen = Observation()
        edges = _small_star(_large_star(now) if before else now)
        edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        if old:
            drop(spark, old)
        summary, old = seen.get, path
        if summary == before or not summary["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = summary
