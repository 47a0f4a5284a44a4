"""The scan: from documents to findings, verdicts and derivatives in one pass without a shuffle.

Formats that have to be walked, plain text among them, go through one Arrow
operator; a file that preflight refuses is judged by Columns alone and reaches
no Python worker. Findings stay an array a document, so the verdict is a
projection; explode them only where a table of findings is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.preflight import suffix, with_preflight
from ..functions.stage import once
from ..functions.verdict import completed, derivative, finding, verdict
from ..operators.parse import parsed, text_parsed
from ..operators.rendered import Adapters
from .contract import QUARANTINE, Limits


def scan_text_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``parsed`` of its texts, scanned as plain text; null text as empty."""
    return docs.withColumn("parsed", text_parsed(F.coalesce(F.col(text).cast("string"), F.lit("")), Limits()))


def with_verdict(parsed_rows: DataFrame, classifier: Column | None = None) -> DataFrame:
    """Adds ``findings``, ``result`` and ``derivative`` for a column ``parsed``; a classifier's rank can only raise the risk."""
    p = F.col("parsed")
    out = once(parsed_rows, {"findings": completed(p["findings"], p["required"], p["completed"])})
    out = once(out, {"result": verdict(F.col("findings"), classifier)})
    return out.withColumn("derivative", derivative(F.col("result"), p["visible_text"]))


def scan(files: DataFrame, limits: Limits | None = None, adapters: Adapters | None = None, name: str = "name", content: str = "content") -> DataFrame:
    """``files`` with ``preflight``, ``findings``, ``result`` and ``derivative``; a preflight finding ends a scan (FLT-01)."""
    limits = limits or Limits()
    rows = with_preflight(files, name, content, limits)
    body = F.coalesce(F.col(content), F.lit(b""))
    rows = once(rows, {"_passed": F.size("preflight.findings") == 0, "_ending": F.lower(suffix(F.col(name)))})
    rows = rows.withColumn("_parsed", parsed(F.when(F.col("_passed"), F.col("_ending")), F.when(F.col("_passed"), body), limits, adapters))
    p = F.col("_parsed")
    rows = once(rows, {"findings": F.when(F.col("_passed"), completed(p["findings"], p["required"], p["completed"])).otherwise(F.col("preflight.findings"))})
    rows = once(rows, {"result": verdict(F.col("findings"))})
    rows = rows.withColumn("derivative", F.when(F.col("_passed"), derivative(F.col("result"), p["visible_text"])))
    return rows.drop("_passed", "_ending", "_parsed")


def findings_table(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row a finding."""
    return scanned.select(*keys, F.inline("findings"))


def unreadable(kind_evidence: str = "SCANNER_DEPENDENCY_UNAVAILABLE") -> Column:
    """Findings of a file that is not there or may not be opened."""
    return F.array(finding(QUARANTINE, kind_evidence, "file:structure"))
