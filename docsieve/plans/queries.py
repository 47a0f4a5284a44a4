"""The engine's registered queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import preflight as P
from ..functions import text as X
from ..functions import verdict as V
from ..operators import office
from ..operators.guard import EVENT, raw_read_denied
from ..operators.parse import member_rows, normalised, parsed, run_rank
from ..operators.rendered import Span, span_anomaly
from ..operators.rules import IntegrityError, guarded
from ..streaming.tables import streamed
from . import overlay as O
from .contract import EVIDENCE, LOCATION, MARKER, Limits
from .samples import sample_package
from .scan import findings_table, scan, scan_text_rows, with_verdict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t): documents with the overlay."""
    return table(spark, sf_dir, "documents").select("doc_id", O.overlaid(F.col("doc_id"), F.col("text")).alias("t"))


ATTACKED = f"SELECT doc_id, {O.sql_overlaid()} AS t FROM documents"
LONG = "long"


def csv(array: Column) -> Column:
    return F.array_join(array, ",")


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(part) AS BIGINT) AS n_chars FROM ({O.sql_lines('d')})")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attacked(spark, sf_dir).select("doc_id", F.posexplode(X.lines(F.col("t"))).alias("i", "part"))
    return rows.select("doc_id", (F.col("i") + 1).cast(LONG).alias("line"), F.length("part").cast(LONG).alias("n_chars"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, md5(regexp_replace(t, '{O.BIDI_SQL}|{O.ZERO_SQL}', '', 'g')) AS digest FROM d")
def strip_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attacked(spark, sf_dir).select("doc_id", F.md5(X.strip_controls(F.col("t"))).alias("digest"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, md5({O.sql_plain('t')}) AS digest FROM d")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02 of all documents, NFKC included. The SQL knows of NFKC only what it does to the overlay's characters; tests/test_normalise.py has others."""
    return attacked(spark, sf_dir).select("doc_id", F.md5(normalised(F.col("t"))).alias("digest"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, regexp_matches(t, '{O.BIDI_SQL}') AS bidi, regexp_matches(t, '{O.ZERO_SQL}') AS zero_width FROM d")
def unicode_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = X.anomalies(F.col("t"))
    return attacked(spark, sf_dir).select("doc_id", F.array_contains(codes, "BIDI_CONTROL_CHARACTERS").alias("bidi"), F.array_contains(codes, "ZERO_WIDTH_CHARACTERS").alias("zero_width"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, {O.sql_disallowed('t')} AS disallowed FROM d")
def disallowed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attacked(spark, sf_dir).select("doc_id", X.has_disallowed(F.col("t")).alias("disallowed"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, CAST(line AS BIGINT) AS line FROM ({O.sql_lines('d')}) WHERE {O.sql_is_instruction('part')}")
def instruction_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.regexp_replace(F.col("t"), X.BREAKS, "\n")
    rows = attacked(spark, sf_dir).where(X.is_instruction(joined)).select("doc_id", F.posexplode(X.lines(F.col("t"))).alias("i", "part"))
    return rows.where(X.is_instruction(F.col("part"))).select("doc_id", (F.col("i") + 1).cast(LONG).alias("line"))


_TALK = f"SELECT conv_id, turn, {O.sql_overlaid('(conv_id + turn)')} AS t FROM conversations"


@query(f"WITH d AS ({_TALK}) SELECT conv_id, count(*) AS turns, count(*) FILTER ({O.sql_is_instruction('t')}) AS attacks FROM d GROUP BY conv_id")
def instruction_findings_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", O.overlaid(F.col("conv_id") + F.col("turn"), F.col("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(X.is_instruction(F.col("t"))).alias("attacks"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS payload FROM ({O.sql_runs('d')}) GROUP BY doc_id")
def encoded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attacked(spark, sf_dir).select("doc_id", F.explode(X.runs(F.col("t"))).alias("run")).withColumn("n", X.payload(F.col("run")))
    return rows.where(F.col("n") >= X.RUN_LEAST).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n").cast(LONG).alias("payload"))


@query(f"WITH d AS ({ATTACKED}) SELECT doc_id, CAST(rank AS INTEGER) AS risk, count(*) AS n FROM ({O.sql_runs('d')}) WHERE rank IS NOT NULL GROUP BY ALL")
def encoded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = F.transform(X.runs(F.col("t")), lambda run: F.struct(run.alias("run"), X.run_risk(run).alias("risk")))
    rows = attacked(spark, sf_dir).select("doc_id", F.explode(F.filter(risks, lambda x: x.risk.isNotNull())).alias("x"))
    return rows.select("doc_id", run_rank(F.col("x.run"), F.col("x.risk")).alias("risk")).groupBy("doc_id", "risk").agg(F.count(F.lit(1)).alias("n"))


_ENCODED = ["aGVsbG8", "aGVsbG8=", "aGVs bG8", "a", "_w", "-_-_", "w6k", "/w==", "aGVsbG8h", ""]


@query(
    "WITH v(s) AS (VALUES " + ", ".join(f"('{s}')" for s in _ENCODED) + "), c AS (SELECT s, translate(replace(s, ' ', ''), '-_', '+/') AS c FROM v), b AS (SELECT s, length(c) AS m, c || repeat('=', CAST((4 - length(c) % 4) % 4 AS INTEGER)) AS b FROM c)"
    " SELECT s, CASE WHEN m % 4 <> 1 AND regexp_matches(b, '^[A-Za-z0-9+/]*={0,2}$') THEN try(decode(from_base64(b))) END AS decoded FROM b"
)
def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in _ENCODED], "s string").select("s", X.decode_block(F.col("s")).alias("decoded"))


# A document's findings as the plain-text scan makes them.
_FINDINGS = f"""
WITH d AS ({ATTACKED}), lines AS (SELECT * FROM ({O.sql_lines('d')})), runs AS (SELECT doc_id, rank FROM ({O.sql_runs('d')}) WHERE rank IS NOT NULL),
f AS (
  SELECT doc_id, 1 AS risk, 'VISIBLE_EXTRACTED_TEXT_MISMATCH' AS evidence, 'text:line=1' AS location, NULL AS anomaly FROM d WHERE {O.sql_disallowed('t')}
  UNION ALL SELECT doc_id, 1, 'VISIBLE_EXTRACTED_TEXT_MISMATCH', 'text:line=' || line, 'BIDI_CONTROL_CHARACTERS' FROM lines WHERE regexp_matches(part, '{O.BIDI_SQL}')
  UNION ALL SELECT doc_id, 1, 'VISIBLE_EXTRACTED_TEXT_MISMATCH', 'text:line=' || line, 'ZERO_WIDTH_CHARACTERS' FROM lines WHERE regexp_matches(part, '{O.ZERO_SQL}')
  UNION ALL SELECT doc_id, 1, 'VISIBLE_INSTRUCTION_PATTERN', 'text:line=' || line, NULL FROM lines WHERE {O.sql_is_instruction('part')}
  UNION ALL SELECT doc_id, rank, 'ENCODED_INSTRUCTION_PATTERN', 'text:line=1', 'LONG_ENCODED_BLOCK' FROM runs
),
v AS (
  SELECT d.doc_id, coalesce(max(f.risk), 0) AS rank, coalesce(string_agg(DISTINCT evidence, ',' ORDER BY evidence), '') AS evidence,
    coalesce(string_agg(DISTINCT location, ',' ORDER BY location), '') AS location, coalesce(string_agg(DISTINCT anomaly, ',' ORDER BY anomaly), '') AS anomalies
  FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
),
w AS (SELECT doc_id, rank, ['low', 'review', 'quarantine'][rank + 1] AS risk_level, evidence, location, anomalies FROM v)
"""


def scanned_texts(spark: SparkSession, sf_dir: str, classifier: Column | None = None) -> DataFrame:
    return with_verdict(scan_text_rows(attacked(spark, sf_dir), "t"), classifier)


def flat(rows: DataFrame, *keys: str) -> DataFrame:
    r = F.col("result")
    return rows.select(*keys, r["risk_level"].alias("risk_level"), csv(r["evidence"]).alias("evidence"), csv(r["location"]).alias("location"), csv(r["structural_anomalies"]).alias("anomalies"))


@query(_FINDINGS + "SELECT DISTINCT doc_id, CAST(risk AS INTEGER) AS risk, evidence, location, anomaly FROM f")
def scan_text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_table(scanned_texts(spark, sf_dir), "doc_id").distinct()


@query(_FINDINGS + "SELECT doc_id, risk_level, evidence, location, anomalies FROM w")
def scan_text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(scanned_texts(spark, sf_dir), "doc_id")


@query(_FINDINGS + "SELECT doc_id, risk_level, evidence, location, anomalies FROM w WHERE rank > 0")
def verdict_from_exploded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.verdict_rows(findings_table(scanned_texts(spark, sf_dir), "doc_id"), "doc_id")
    return rows.select("doc_id", "risk_level", csv(F.col("evidence")).alias("evidence"), csv(F.col("location")).alias("location"), csv(F.col("structural_anomalies")).alias("anomalies"))


@query(_FINDINGS + f"SELECT doc_id, md5({O.sql_text(MARKER)} || rtrim({O.sql_plain('t')}, chr(10)) || chr(10)) AS digest FROM w JOIN d USING (doc_id) WHERE rank = 0")
def scan_text_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_texts(spark, sf_dir).where(F.col("derivative").isNotNull()).select("doc_id", F.md5("derivative").alias("digest"))


_QUOTED = "'[' || CASE WHEN {0} = '' THEN '' ELSE '\"' || replace({0}, ',', '\",\"') || '\"' END || ']'"


@query(
    _FINDINGS
    + "SELECT doc_id, '{\"risk_level\":\"' || risk_level || '\",\"evidence\":' || "
    + " || ".join([_QUOTED.format("evidence"), "',\"location\":'", _QUOTED.format("location"), "',\"structural_anomalies\":'", _QUOTED.format("anomalies"), "'}' || chr(10)"])
    + " AS json FROM w"
)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_texts(spark, sf_dir).select("doc_id", V.result_json(F.col("result")).alias("json"))


@query(_FINDINGS + "SELECT doc_id, risk_level FROM w WHERE rank >= 1")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gate(scanned_texts(spark, sf_dir).select("doc_id", "result.risk_level"), "review")


@query(_FINDINGS + "SELECT w.doc_id, ['low', 'review', 'quarantine'][greatest(rank, coalesce(2 * toxic, 0)) + 1] AS risk_level FROM w LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def raise_to_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg((2 * F.max("toxic")).alias("raised"))
    rows = scan_text_rows(attacked(spark, sf_dir), "t").join(toxic, "doc_id", "left")
    return with_verdict(rows, F.col("raised")).select("doc_id", "result.risk_level")


@query(
    _FINDINGS
    + ", x AS (SELECT d.lang, d.source, w.risk_level FROM w JOIN documents d USING (doc_id)) SELECT lang, source, count(*) AS documents, count(*) FILTER (risk_level = 'low') AS low, count(*) FILTER (risk_level = 'review') AS review, count(*) FILTER (risk_level = 'quarantine') AS quarantine FROM x GROUP BY CUBE (lang, source)"
)
def verdict_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a corpus report, one aggregation over the verdicts."""
    docs = table(spark, sf_dir, "documents").withColumn("t", O.overlaid(F.col("doc_id"), F.col("text")))
    level = F.col("result.risk_level")
    counts = [F.count_if(level == r).alias(r) for r in ("low", "review", "quarantine")]
    return with_verdict(scan_text_rows(docs, "t")).cube("lang", "source").agg(F.count(F.lit(1)).alias("documents"), *counts)


_CHECKS = "CASE doc_id % 3 WHEN 0 THEN ['ocr', 'structure'] WHEN 1 THEN ['structure'] ELSE [] END"


@query(f"SELECT doc_id, CASE WHEN len(list_filter(['ocr', 'structure'], lambda x: NOT list_contains({_CHECKS}, x))) > 0 THEN 'quarantine' ELSE 'low' END AS risk_level FROM documents")
def required_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    done = F.when(k == 0, F.array(F.lit("ocr"), F.lit("structure"))).when(k == 1, F.array(F.lit("structure"))).otherwise(F.array().cast("array<string>"))
    findings = V.completed(V.no_findings(), F.array(F.lit("ocr"), F.lit("structure")), done)
    return table(spark, sf_dir, "documents").select("doc_id", V.verdict(findings)["risk_level"].alias("risk_level"))


#: What a parse may raise, and the evidence that the contract asks for.
_RAISED = {
    "ValueError": (ValueError, "PARSER_FAILURE"),
    "EOFError": (EOFError, "PARSER_FAILURE"),
    "TimeoutError": (TimeoutError, "RESOURCE_LIMIT_EXCEEDED"),
    "MemoryError": (MemoryError, "RESOURCE_LIMIT_EXCEEDED"),
    "FileNotFoundError": (FileNotFoundError, "SCANNER_DEPENDENCY_UNAVAILABLE"),
    "ModuleNotFoundError": (ModuleNotFoundError, "SCANNER_DEPENDENCY_UNAVAILABLE"),
    "IntegrityError": (IntegrityError, "RESULT_INTEGRITY_FAILURE"),
    "KeyError": (KeyError, "PARSER_FAILURE"),
}


@query("SELECT doc_id, v.name, v.evidence FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{e}')" for i, (k, (_, e)) in enumerate(_RAISED.items())) + f") AS v(k, name, evidence) ON doc_id % {len(_RAISED)} = v.k")
def failure_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10: a parse of each document that raises one of these errors, by way of the parsers' own guard."""

    @F.pandas_udf("string")
    def fail(names: pd.Series) -> pd.Series:
        def evidence(name: str) -> str:
            def parse():
                raise _RAISED[name][0]

            return guarded(parse, ["check"]).findings[0][1]

        return names.map(evidence)

    names = F.array(*(F.lit(k) for k in _RAISED))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % len(_RAISED) + 1).cast("int")).alias("name"))
    return rows.select("doc_id", "name", fail("name").alias("evidence"))


_LEAST_RISK = "CASE v.evidence WHEN 'PARSER_FAILURE' THEN 'quarantine' WHEN 'RESOURCE_LIMIT_EXCEEDED' THEN 'quarantine' WHEN 'RESULT_INTEGRITY_FAILURE' THEN 'quarantine' WHEN 'SCANNER_DEPENDENCY_UNAVAILABLE' THEN 'review' ELSE 'low' END"


@query("SELECT doc_id, v.evidence, " + _LEAST_RISK + " AS risk_level FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(EVIDENCE)) + f") AS v(k, evidence) ON doc_id % {len(EVIDENCE)} = v.k")
def evidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09: the verdict of one low finding with each code."""
    code = F.element_at(F.array(*(F.lit(e) for e in EVIDENCE)), (F.col("doc_id") % len(EVIDENCE) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", code.alias("evidence"))
    findings = F.array(V.finding(0, "x", "file:structure").withField("evidence", F.col("evidence")))
    return rows.select("doc_id", "evidence", V.verdict(findings)["risk_level"].alias("risk_level"))


_NAMES = {0: ".txt", 1: ".md", 2: ".pdf", 3: ".HTML", 4: ".csv", 5: "", 6: ".png"}
_NAME_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN 'd' || doc_id || '{v}'" for k, v in _NAMES.items()) + " END"
_HEADS = {0: "", 1: "255044462d", 2: "89504e470d0a1a0a", 3: "ffd8ff", 4: "504b0304", 5: "ff", 6: "efbbbf"}
_BYTES_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN unhex('{v}') || encode(text)" for k, v in _HEADS.items()) + " END"


def named_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, content): texts under names and heads of several formats."""
    pick = lambda kinds, make: reduce(lambda out, kv: F.when(F.col("doc_id") % 7 == kv[0], make(kv[1])).otherwise(out), kinds.items(), F.lit(None))
    name = pick(_NAMES, lambda end: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(end)))
    content = pick(_HEADS, lambda head: F.concat(F.unhex(F.lit(head)), F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", name.alias("name"), content.alias("content"))


@query(f"SELECT doc_id, sha256({_BYTES_SQL}) AS sha256 FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_bytes(spark, sf_dir).select("doc_id", P.content_hash(F.col("content")).alias("sha256"))


_FORMAT_SQL = "CASE doc_id % 7 WHEN 1 THEN 'PDF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'JPEG' WHEN 4 THEN 'ZIP' ELSE 'UNKNOWN' END"


@query(f"SELECT doc_id, {_FORMAT_SQL} AS format FROM documents WHERE text IS NOT NULL")
def magic_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_bytes(spark, sf_dir).select("doc_id", P.signature(F.col("content")).alias("format"))


@query("SELECT doc_id, f.format, f.format = 'TEXT' AND doc_id % 7 IN (0, 1, 3) OR f.format = 'PDF' AND doc_id % 7 = 2 OR f.format = 'PNG' AND doc_id % 7 = 6 AS matches FROM documents, (VALUES ('TEXT'), ('PDF'), ('PNG'), ('ZIP')) AS f(format)")
def extension_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = F.array(*(F.lit(x) for x in ("TEXT", "PDF", "PNG", "ZIP")))
    name = reduce(lambda out, kv: F.when(F.col("doc_id") % 7 == kv[0], F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(kv[1]))).otherwise(out), _NAMES.items(), F.lit(None))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.explode(formats).alias("format"))
    return rows.select("doc_id", "format", P.extension_matches(F.col("format"), F.lower(P.suffix(F.col("name")))).alias("matches"))


@query(
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'TEXT' WHEN 6 THEN 'TEXT' WHEN 1 THEN 'PDF' WHEN 2 THEN 'PNG' WHEN 3 THEN 'JPEG' ELSE 'UNKNOWN' END AS format,"
    f" CASE WHEN doc_id % 7 = 5 THEN '' ELSE sha256({_BYTES_SQL}) END AS sha256, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'CORRUPT_DOCUMENT' END AS evidence FROM documents WHERE text IS NOT NULL"
)
def text_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_preflight(named_bytes(spark, sf_dir), "name", "content", Limits())
    return rows.select("doc_id", "preflight.format", "preflight.sha256", csv(F.transform("preflight.findings", lambda f: f["evidence"])).alias("evidence"))


_MEMBERS = {"word/document.xml": True, "/abs": False, "a/../b": False, "a\\b": False, "C:x": False, "dir/": True, "a//b": False, "": False, "a/./b": False, "..hidden": True, "/": False}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', {str(ok).lower()}, CAST({m.count('/') + 1} AS INTEGER))" for m, ok in _MEMBERS.items()) + ") AS v(name, canonical, depth)")
def zip_member_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m in _MEMBERS], "name string")
    return rows.select("name", P.member_is_canonical(F.col("name")).alias("canonical"), P.member_depth(F.col("name")).alias("depth"))


@query("SELECT l_linenumber AS line, chr(CAST(64 + l_linenumber AS INTEGER)) || 'B' AS letters, CAST(l_linenumber * 26 + 2 AS BIGINT) AS n FROM lineitem GROUP BY l_linenumber")
def column_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XL-02, the workbook parser's own."""

    @F.pandas_udf("long")
    def number(letters: pd.Series) -> pd.Series:
        return letters.map(office.column_number)

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line")).distinct().withColumn("letters", F.concat(F.chr(64 + F.col("line")), F.lit("B")))
    return rows.select("line", "letters", number("letters").alias("n"))


@query("SELECT l_orderkey AS row_number, string_agg(CASE WHEN q IS NULL THEN '' ELSE q END, chr(9) ORDER BY c) AS line FROM (SELECT o.l_orderkey, c, max(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) FILTER (l_linenumber * 2 = c) AS q FROM (SELECT l_orderkey, 2 * max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey) o, LATERAL (SELECT unnest(range(1, m + 1)) AS c) LEFT JOIN lineitem l ON l.l_orderkey = o.l_orderkey AND l_linenumber * 2 = c GROUP BY ALL) GROUP BY l_orderkey")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05: cells (row, column, value) as lines between tabs, gaps empty, by the workbook parser's own rule."""

    @F.pandas_udf("string")
    def line(cells: pd.Series) -> pd.Series:
        return cells.map(lambda own: office.sheet_lines({1: {int(c["c"]): c["value"] for c in own}})[0])

    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_number"), (2 * F.col("l_linenumber")).cast("int").alias("c"), F.col("l_quantity").cast(LONG).cast("string").alias("value"))
    one = cells.groupBy("row_number", "c").agg(F.max("value").alias("value"))
    rows = one.groupBy("row_number").agg(F.collect_list(F.struct("c", "value")).alias("cells"))
    return rows.select("row_number", line("cells").alias("line"))


_SPAN = "CASE WHEN l_quantity / 4 < 4 THEN 'TINY_TEXT' WHEN (l_partkey * 7919) % 16777216 >= 16448250 THEN 'WHITE_ON_WHITE_TEXT' WHEN NOT (least(612, x + 10) > greatest(0, x) AND least(792, y + 10) > greatest(0, y)) THEN 'OFF_CANVAS_TEXT' END"


@query(f"SELECT {_SPAN} AS anomaly, count(*) AS n FROM (SELECT *, CAST(l_suppkey % 700 AS DOUBLE) AS x, CAST(l_partkey % 900 AS DOUBLE) AS y FROM lineitem) GROUP BY ALL")
def pdf_span_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PD-02 of made spans, by the page parser's own rule."""

    @F.pandas_udf("string")
    def anomaly(size: pd.Series, colour: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        page = (0.0, 0.0, 612.0, 792.0)
        return pd.Series([span_anomaly(Span(s, c, (a, b, a + 10, b + 10), ""), page) for s, c, a, b in zip(size, colour, x, y, strict=True)])

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 4).cast("double"), (F.col("l_partkey").cast(LONG) * 7919) % 16777216, (F.col("l_suppkey") % 700).cast("double"), (F.col("l_partkey") % 900).cast("double"))
    return rows.groupBy(anomaly(*rows.columns).alias("anomaly")).agg(F.count(F.lit(1)).alias("n"))


_UPLOADS = {"a.TXT": ".txt", "b.docx": ".docx", "c.exe": ".unsupported", "noext": ".unsupported", ".md": ".unsupported", "d.tar.html": ".html"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _UPLOADS.items()) + ") AS v(name, suffix)")
def upload_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _UPLOADS], "name string").select("name", P.upload_suffix(F.col("name")).alias("suffix"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.md5(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", P.is_job_id(F.when(F.col("doc_id") % 2 == 0, job).otherwise(F.upper(F.concat(job, F.lit("g"))))).alias("valid"))


_PATHS = {"read /tmp/a.pdf now": True, "cat notes.md": True, "ls -la": False, "x.pdfx": False, '"b.HTML"': True, "=c.jpeg;": True, "http://h/d.docx": True, "md": False}

@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, v in _PATHS.items()) + ") AS v(command, denied)")
def raw_read_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05: commands that name a document and so may not run, as the guard decides."""
    rows = spark.createDataFrame([(k,) for k in _PATHS], "command string")
    call = F.to_json(F.struct(F.lit(EVENT).alias("hook_event_name"), F.lit("Bash").alias("tool_name"), F.struct("command").alias("tool_input")))
    return rows.select("command", raw_read_denied(call).alias("denied"))


#: Calls by id mod 8; the whole text of a document is in each of them. True and False: denied or not, whatever the text.
_CALLS = {0: None, 1: False, 2: False, 3: True, 4: True, 5: True, 6: True, 7: None}
_GUARD_SQL = r"(?i)(?:^|[\t-\r\x1c-\x20\x{85}\p{Z}''\"=:/])[^\t-\r\x1c-\x20\x{85}\p{Z}''\"=]*\.(?:txt|md|markdown|html?|docx|pptx|xlsx|pdf|png|jpe?g)(?:$|[\t-\r\x1c-\x20\x{85}\p{Z}''\";,)])"


@query("SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {str(v).lower()}" for k, v in _CALLS.items() if v is not None) + f" ELSE regexp_matches(coalesce(text, ''), '{_GUARD_SQL}') END AS denied FROM documents")
def raw_read_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05 as a whole: tool calls with whole texts in nested strings, of scanner tools and commands, of a wrong event and malformed."""
    text = F.coalesce("text", F.lit(""))

    def call(tool: str, given: Column, event: str = EVENT) -> Column:
        return F.to_json(F.struct(F.lit(event).alias("hook_event_name"), F.lit(tool).alias("tool_name"), given.alias("tool_input")))

    calls = {
        0: call("Read", F.struct(text.alias("file_path"))),
        1: call("Bash", F.struct(F.concat(F.lit("document-firewall a.pdf "), text).alias("command"))),
        2: call("mcp__document-injection-firewall__inspect_file", F.struct(F.concat(text, F.lit(" a.pdf")).alias("path"))),
        3: call("Edit", F.struct(F.array(F.struct(F.array(F.lit("x"), F.concat(text, F.lit(" a.pdf "))).alias("new"))).alias("edits"))),
        4: call("Read", F.struct(text.alias("note")), "PostToolUse"),
        5: text,
        6: call("Bash", F.struct(F.lit(1).alias("n"), F.concat(text, F.lit(" b.HTML;")).alias("command"))),
        7: call("Grep", F.struct(F.lit(True).alias("all"), F.array(text).alias("patterns"))),
    }
    payload = reduce(lambda out, kv: F.when(F.col("doc_id") % 8 == kv[0], kv[1]).otherwise(out), calls.items(), F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", raw_read_denied(payload).alias("denied"))


_PLACES = {"text:line=1": True, "text:line=0": False, "pdf:page=3:object=1": True, "docx:part=core.xml": True, "docx:part=a/b": False, "xlsx:sheet=1:row=2:column=1234567": False, "file:structure": True, "file:other": False}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{k if v else 'file:structure'}')" for k, v in _PLACES.items()) + ") AS v(location, safe)")
def safe_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    assert LOCATION
    return spark.createDataFrame([(k,) for k in _PLACES], "location string").select("location", V.safe_location(F.col("location")).alias("safe"))


_STYLES = {0: 'style="display:none"', 1: "hidden", 2: 'style="color: #0000"', 3: 'style="color:red"', 4: "", 5: 'onclick="x()"', 6: 'title="you are now"'}
_HTML_RISK = {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 2, 6: 2}


@query("SELECT doc_id, ['low', 'review', 'quarantine'][CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _HTML_RISK.items()) + " END + 1] AS risk_level FROM documents")
def scan_html_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-20 over well-formed pages, one a document, with attributes that hide, run or tell."""
    style = reduce(lambda out, kv: F.when(F.col("doc_id") % 7 == kv[0], F.lit(kv[1])).otherwise(out), _STYLES.items(), F.lit(""))
    html = F.concat(F.lit("<!doctype html><p>Report "), F.col("doc_id").cast("string"), F.lit("</p><div "), style, F.lit(">body</div>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parsed(F.lit(".html"), F.encode(html, "UTF-8"), Limits()).alias("parsed"))
    return with_verdict(rows).select("doc_id", "result.risk_level")


@query("SELECT page_id, 'quarantine' AS risk_level, 'PARSER_FAILURE,SCANNER_DEPENDENCY_UNAVAILABLE' AS evidence, 'file:structure' AS location, '' AS anomalies FROM pages")
def scan_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages nest badly, so each must fail as a whole (a weak check)."""
    rows = table(spark, sf_dir, "pages").select("page_id", parsed(F.lit(".html"), F.encode(F.coalesce("html", F.lit("")), "UTF-8"), Limits()).alias("parsed"))
    return flat(with_verdict(rows), "page_id")


_LINKS = {0: "[a](javascript:x)", 1: "[a](http://x.example/)", 2: "[a](local.md)", 3: "a < b", 4: "[a][r]\n\n[r]: //x.example/", 5: "[a][none]", 6: "plain"}
_LINK_CODES = {
    0: ("quarantine", "ACTIVE_CONTENT_PRESENT"),
    1: ("review", "EXTERNAL_REFERENCE_PRESENT"),
    2: ("low", ""),
    3: ("review", "VISIBLE_EXTRACTED_TEXT_MISMATCH"),
    4: ("review", "EXTERNAL_REFERENCE_PRESENT"),
    5: ("review", "VISIBLE_EXTRACTED_TEXT_MISMATCH"),
    6: ("low", ""),
}


@query("SELECT doc_id, v.risk_level, v.evidence FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in _LINK_CODES.items()) + ") AS v(k, risk_level, evidence) ON doc_id % 7 = v.k")
def markdown_links_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD-10 over Markdown made from ids."""
    link = reduce(lambda out, kv: F.when(F.col("doc_id") % 7 == kv[0], F.lit(kv[1])).otherwise(out), _LINKS.items(), F.lit(""))
    text = F.concat(F.lit("# Note "), F.col("doc_id").cast("string"), F.lit("\n"), link, F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parsed(F.lit(".md"), F.encode(text, "UTF-8"), Limits()).alias("parsed"))
    return flat(with_verdict(rows), "doc_id").select("doc_id", "risk_level", "evidence")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'low' ELSE 'quarantine' END AS risk_level, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'CORRUPT_DOCUMENT' END AS evidence FROM documents WHERE text IS NOT NULL"
)
def scan_files_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over named bytes: only .txt with text passes preflight; clean prose is low."""
    clean = named_bytes(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.encode(F.lit("ordinary report"), "UTF-8")).otherwise(F.col("content")))
    return flat(scan(clean), "doc_id").select("doc_id", "risk_level", "evidence")


@query(_FINDINGS + "SELECT doc_id, risk_level, evidence, location, anomalies FROM w")
def scan_files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over every document's whole attacked text as a .txt file, null texts included."""
    files = attacked(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("t", "UTF-8").alias("content"))
    return flat(scan(files), "doc_id")


@query(_FINDINGS + "SELECT doc_id, risk_level, evidence, location, anomalies FROM w")
def stream_text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04 over the documents as a stream; the same plan and the same rows as the batch."""
    schema = table(spark, sf_dir, "documents").schema

    def plan(docs: DataFrame) -> DataFrame:
        return flat(with_verdict(scan_text_rows(docs.select("doc_id", O.overlaid(F.col("doc_id"), F.col("text")).alias("t")), "t")), "doc_id")

    return streamed(spark, f"{sf_dir}/documents.parquet*", schema, plan, "text-verdict")


def packages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(doc_id, name, content): a made Office file a document, in one of five variants by id."""

    @F.pandas_udf("binary")
    def make(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: sample_package(kind, int(i)))

    ids = table(spark, sf_dir, "documents").select("doc_id")
    return ids.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("name"), make("doc_id").alias("content"))


_OFFICE_SQL = "SELECT doc_id, v.risk_level, v.anomalies FROM documents JOIN (VALUES (0, 'low', ''), (1, 'quarantine', '{hidden}'), (2, 'quarantine', 'MACRO_CONTENT'), (3, 'quarantine', ''), (4, 'review', 'EXTERNAL_RELATIONSHIP')) AS v(k, risk_level, anomalies) ON doc_id % 5 = v.k"


@query(_OFFICE_SQL.format(hidden="DOM_HIDDEN_CONTENT,HIDDEN_XML_TEXT"))
def scan_docx_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DX-03, OX-01, OX-02, SRC-10 to SRC-15: plain, hidden run, macro, broken part, external link."""
    return flat(scan(packages(spark, sf_dir, "docx")), "doc_id").select("doc_id", "risk_level", "anomalies")


@query(_OFFICE_SQL.format(hidden="DOM_HIDDEN_CONTENT,HIDDEN_ROW"))
def scan_xlsx_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XL-03 on the same variants."""
    return flat(scan(packages(spark, sf_dir, "xlsx")), "doc_id").select("doc_id", "risk_level", "anomalies")


@query("SELECT doc_id, CAST(CASE doc_id % 5 WHEN 2 THEN 3 WHEN 4 THEN 3 ELSE 2 END AS BIGINT) AS members, CAST(CASE doc_id % 5 WHEN 4 THEN 3 ELSE 2 END AS INTEGER) AS depth FROM documents")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10 and AGG-04: central-directory members as rows, counted and measured in SQL operators."""
    rows = member_rows(packages(spark, sf_dir, "docx"), "doc_id", "content", Limits())
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("members"), F.max(P.member_depth(F.col("name"))).alias("depth"))
