"""Files as rows: a manifest that loses none, contents only of those that may be read (SRC-01, SRC-02, SRC-20)."""

from __future__ import annotations

import os
import stat
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.preflight import with_preflight
from ..functions.verdict import verdict
from ..operators.rendered import Adapters
from ..plans.contract import Limits
from ..plans.scan import scan, unreadable

MANIFEST = "path string, name string, size long, regular boolean, missing boolean"


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What lstat says of each path, links not followed."""
    rows = []
    for path in paths:
        try:
            info = os.lstat(path)
            rows.append((os.path.abspath(path), os.path.basename(path), info.st_size, stat.S_ISREG(info.st_mode), False))
        except OSError:
            rows.append((os.path.abspath(path), os.path.basename(path), 0, False, True))
    return spark.createDataFrame(rows, MANIFEST)


def contents(spark: SparkSession, folder: str, limits: Limits | None = None) -> DataFrame:
    """(path, name, content, length) of all of a folder's files; of one over the upload bound the content is null and never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return bounded(files, limits or Limits()).select(plain_path(F.col("path")).alias("path"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def bounded(files: DataFrame, limits: Limits) -> DataFrame:
    """Rows of the binary file source: those over the upload bound come from a read without the column of contents."""
    over = F.col("length") > limits.upload_bytes
    small = files.where(~over)
    return small.unionByName(files.drop("content").where(over).withColumn("content", F.lit(None).cast("binary")).select(small.columns))


def scan_folder(spark: SparkSession, folder: str, limits: Limits | None = None, adapters: Adapters | None = None) -> DataFrame:
    """(path, name, result, derivative) of all files under ``folder``; one over the upload bound is quarantined."""
    limits = limits or Limits()
    return scan_bounded(contents(spark, folder, limits), limits, adapters).select("path", "name", "result", "derivative")


def scan_bounded(files: DataFrame, limits: Limits, adapters: Adapters | None = None) -> DataFrame:
    """The scan of ``files`` (name, content, length), where a length over the bound is a finding of its own."""
    over = F.col("length") > limits.upload_bytes
    out = scan(files, limits, adapters)
    refused = verdict(unreadable("RESOURCE_LIMIT_EXCEEDED"))
    return out.withColumns({"result": F.when(over, refused).otherwise(F.col("result")), "derivative": F.when(~over, F.col("derivative"))})


def plain_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/*", "/")


def confined(path: Column, root: str) -> Column:
    """SRC-20: whether a path, without dot segments, lies under ``root``."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(?:^|/)\.{1,2}(?:/|$)")


def scan_paths(spark: SparkSession, paths: list[str], limits: Limits | None = None, adapters: Adapters | None = None) -> DataFrame:
    """Verdict of every path: one that is missing, no regular file or too large is quarantined, none is lost."""
    limits = limits or Limits()
    listed = manifest(spark, paths)
    may_read = [p for p in paths if os.path.isfile(p) and not os.path.islink(p) and os.path.getsize(p) <= limits.upload_bytes]
    refused = listed.where(~F.col("regular") | (F.col("size") > limits.upload_bytes))
    code = F.when(F.col("missing"), F.lit(0)).otherwise(F.lit(1))
    findings = F.when(code == 0, unreadable()).otherwise(unreadable("RESOURCE_LIMIT_EXCEEDED"))
    out = refused.select("path", "name", verdict(findings).alias("result"), F.lit(None).cast("string").alias("derivative"))
    if not may_read:
        return out
    # Spark's file sources pass over names that begin with _ or . : those are opened by path
    skipped = [p for p in may_read if os.path.basename(p)[0] in "_."]
    parts = []
    if seen := [f"file://{os.path.abspath(p)}" for p in may_read if p not in skipped]:
        parts.append(spark.read.format("binaryFile").load(seen).select(plain_path(F.col("path")).alias("path"), "content"))
    if skipped:
        parts.append(spark.createDataFrame([(os.path.abspath(p),) for p in skipped], "path string").select("path", _bytes("path").alias("content")))
    named = reduce(DataFrame.unionByName, parts).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return scan(named, limits, adapters).select("path", "name", "result", "derivative").unionByName(out)


def _bytes(path: str) -> Column:
    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: Path(p).read_bytes())

    return read(path)


def inspect(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """SRC-02: preflight reports of (name, content), nothing parsed."""
    return with_preflight(files, "name", "content", limits or Limits())
