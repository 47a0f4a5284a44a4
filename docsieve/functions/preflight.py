"""Preflight of file contents as Columns (SRC-04 to SRC-08, SRC-11, SRC-12, FLT-03, FLT-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.parse import deep_kind
from ..plans.contract import EXTENSIONS, QUARANTINE, UPLOAD_SUFFIXES, Limits
from .stage import once
from .verdict import finding, no_findings

UTF16_MARKS = ("fffe", "feff")


def _starts(content: Column, *heads: str) -> Column:
    out = F.lit(False)
    for head in heads:
        out = out | content.startswith(F.unhex(F.lit(head)))
    return out


def content_hash(content: Column) -> Column:
    """SRC-04."""
    return F.sha2(content, 256)


def signature(content: Column) -> Column:
    """SRC-05: the format that the first bytes say."""
    return (
        F.when(_starts(content, "255044462d"), F.lit("PDF"))
        .when(_starts(content, "89504e470d0a1a0a"), F.lit("PNG"))
        .when(_starts(content, "ffd8ff"), F.lit("JPEG"))
        .when(_starts(content, "504b0304", "504b0506", "504b0708"), F.lit("ZIP"))
        .otherwise(F.lit("UNKNOWN"))
    )


def is_utf16(content: Column) -> Column:
    return _starts(content, *UTF16_MARKS)


def text_of(content: Column) -> Column:
    """SRC-06: strict UTF-8 without one leading mark; null for anything else."""
    text = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    return F.regexp_replace(text, "\\A\\ufeff", "")


def suffix(name: Column) -> Column:
    """The last suffix of a file name, dot included; empty for none or for a name that only begins with a dot."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_extract(F.regexp_replace(base, r"\A\.+", ""), r".(\.[^./]+)\z", 1)


def extension_matches(document_format: Column, ending: Column) -> Column:
    """SRC-07."""
    out = F.lit(False)
    for name, endings in EXTENSIONS.items():
        out = out | ((document_format == name) & ending.isin(*endings))
    return out


def with_preflight(files: DataFrame, name: str, content: str, limits: Limits) -> DataFrame:
    """SRC-08: ``files`` with ``preflight`` (format, sha256, size, findings); null content as empty.

    Contents over the size bound are not looked into. Containers and UTF-16 need
    a closer look in Python; all other rows pass null to it.
    """
    size = F.octet_length("_content").cast("long")
    fits = size <= limits.upload_bytes
    rows = once(files, {"_content": F.coalesce(F.col(content), F.lit(b"")), "_suffix": F.lower(suffix(F.col(name)))})
    rows = once(rows, {"_fits": fits, "_kind": F.when(fits, signature(F.col("_content")))})
    closer = (F.col("_kind") == "ZIP") | (F.col("_fits") & is_utf16(F.col("_content")))
    rows = rows.withColumn("_deep", deep_kind(F.when(closer, F.col("_content")), limits))
    is_text = (F.col("_kind") == "UNKNOWN") & F.is_valid_utf8(F.col("_content").cast("string"))
    rows = once(rows, {"_format": F.coalesce(F.col("_deep.format"), F.when(is_text, F.lit("TEXT")).otherwise(F.col("_kind")), F.lit("UNKNOWN"))})
    fits, found, evidence = F.col("_fits"), F.col("_format"), F.col("_deep.evidence")
    undecoded = (F.col("_kind") == "UNKNOWN") & (found == "UNKNOWN")
    code = (
        F.when(~fits, F.lit("RESOURCE_LIMIT_EXCEEDED"))
        .when(evidence.isNotNull(), evidence)
        .when(undecoded | ~extension_matches(found, F.col("_suffix")), F.lit("CORRUPT_DOCUMENT"))
        .when(found == "ZIP", F.lit("UNSUPPORTED_FORMAT"))
    )
    rows = once(rows, {"_code": code, "_unread": ~fits | undecoded})
    report = F.struct(
        F.when(F.col("_unread"), F.lit("UNKNOWN")).otherwise(found).alias("format"),
        F.when(F.col("_unread"), F.lit("")).otherwise(content_hash(F.col("_content"))).alias("sha256"),
        size.alias("size"),
        F.when(F.col("_code").isNotNull(), F.array(finding(QUARANTINE, "", "file:structure").withField("evidence", F.col("_code")))).otherwise(no_findings()).alias("findings"),
    )
    own = [c for c in rows.columns if c.startswith("_") and c not in files.columns]
    return rows.withColumn("preflight", report).drop(*own)


def upload_suffix(name: Column) -> Column:
    """FLT-03."""
    ending = F.lower(suffix(name))
    return F.when(ending.isin(*UPLOAD_SUFFIXES), ending).otherwise(F.lit(".unsupported"))


def is_job_id(job: Column) -> Column:
    """FLT-04."""
    return job.rlike(r"\A[a-f0-9]{32}\z")


def member_depth(name: Column) -> Column:
    """SRC-12."""
    return F.size(F.split(name, "/"))


def member_is_canonical(name: Column) -> Column:
    """SRC-11: whether a member's name is accepted."""
    bad = name.contains("\\") | name.contains("\0") | name.rlike("^[A-Za-z]:") | F.regexp_replace(name, "/$", "").rlike(r"^$|^/|//|/$|(?:^|/)\.{1,2}(?:/|$)")
    return ~bad
