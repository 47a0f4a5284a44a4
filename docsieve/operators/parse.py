"""Which parser reads a document, and those parsers as one Arrow operator."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drop_controls, stable
from ..plans.contract import PARSED, Limits
from . import office, rendered
from .containers import members, zip_format
from .markdown import markdown_findings
from .markup import CHECK as HTML_CHECK
from .markup import html_page
from .rules import Clock, Parsed, decode_text, failed, guarded, normalise, plain_text, run_risk

TEXT_CHECK = "text-patterns"


def parse(suffix: str, content: bytes, limits: Limits | None = None, adapters: rendered.Adapters | None = None) -> Parsed:
    """FLT-02: the parse of content that preflight has passed, by its suffix."""
    limits, adapters = limits or Limits(), adapters or rendered.Adapters()
    clock = Clock(limits)
    if suffix in (".txt", ".md", ".markdown"):
        more = partial(markdown_findings, clock=clock) if suffix != ".txt" else None
        return guarded(lambda: plain_text(decode_text(content), clock, more), [TEXT_CHECK])
    if suffix in (".html", ".htm"):
        return guarded(lambda: html_page(decode_text(content), clock), [HTML_CHECK])
    if suffix == ".docx":
        return guarded(lambda: office.docx(content, limits, clock), [office.DOCX_CHECK])
    if suffix == ".xlsx":
        return guarded(lambda: office.xlsx(content, limits, clock), [office.XLSX_CHECK])
    if suffix == ".pptx":
        return guarded(lambda: rendered.pptx(content, limits, clock, adapters), office.PPTX_CHECKS)
    if suffix == ".pdf":
        return guarded(lambda: rendered.pdf(content, limits, clock, adapters), rendered.PDF_CHECKS)
    if suffix in (".png", ".jpg", ".jpeg"):
        return guarded(lambda: rendered.image(content, "PNG" if suffix == ".png" else "JPEG", limits, clock, adapters), rendered.IMAGE_CHECKS)
    return failed("PARSER", [])


def parsed(suffix: Column, content: Column, limits: Limits, adapters: rendered.Adapters | None = None) -> Column:
    """The parse of each row as a struct; null where ``suffix`` is, so rows that Spark itself can judge cost nothing here."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = PARSED.fieldNames()
        for suffixes, contents in batches:
            rows = [dict.fromkeys(names) if s is None else parse(s, bytes(c), limits, adapters).row() for s, c in zip(suffixes, contents, strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return run(suffix, content)


def text_parsed(text: Column, limits: Limits) -> Column:
    """TXT-09 of texts that are strings already, a parse each."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [guarded(partial(plain_text, t, Clock(limits)), [TEXT_CHECK]).row() for t in texts]
            yield pd.DataFrame(rows, columns=PARSED.fieldNames())

    return run(text)


def normalised(text: Column) -> Column:
    """TXT-02: NFKC without controls; only texts of an unstable alphabet leave the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalise, na_action="ignore")

    is_stable = stable(text)
    return F.when(is_stable, drop_controls(text)).otherwise(run(F.when(~is_stable, text)))


def run_rank(run: Column, rank: Column) -> Column:
    """TXT-07: a run's ``run_risk``, with the rank of runs that decode beyond the stable alphabet; only those leave the JVM."""

    @F.pandas_udf("int")
    def ranks(runs: pd.Series) -> pd.Series:
        return runs.map(run_risk, na_action="ignore").astype("Int32")

    return F.when(rank == -1, ranks(F.when(rank == -1, run))).otherwise(rank)


def deep_kind(content: Column, limits: Limits) -> Column:
    """SRC-14, and strict UTF-16, as a struct (format, evidence); null for null content."""

    def kind(data: bytes) -> tuple[str, str | None]:
        if data[:2] == b"PK":
            return zip_format(data, limits, Clock(limits))
        try:
            decode_text(data)
            return "TEXT", None
        except UnicodeDecodeError:
            return "UNKNOWN", "CORRUPT_DOCUMENT"

    @F.pandas_udf("format string, evidence string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield pd.DataFrame([(None, None) if c is None else kind(bytes(c)) for c in contents], columns=["format", "evidence"])

    return run(content)


def member_rows(files: DataFrame, key: str, content: str, limits: Limits) -> DataFrame:
    """SRC-10: one row a member (key, name, usize, csize, is_dir); containers that fail their checks have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, data in zip(batch[key], batch[content], strict=True):
                try:
                    rows += [(k, m.name, m.usize, m.csize, m.is_dir) for m in members(bytes(data or b""), limits, Clock(limits))]
                except (ValueError, MemoryError, TimeoutError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "name", "usize", "csize", "is_dir"])

    return files.select(key, content).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, name string, usize long, csize long, is_dir boolean")
