"""From findings to verdicts and outputs, as Columns over an array of findings: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.contract import FAILURES, FINDING, FLOORS, LOCATION, MARKER, QUARANTINE, RISKS


def finding(risk: int | Column, evidence: str, location: str | Column, anomaly: str | Column | None = None) -> Column:
    of = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(of(risk, "int").alias("risk"), F.lit(evidence).alias("evidence"), of(location, "string").alias("location"), of(anomaly, "string").alias("anomaly"))


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING.simpleString()}>")


def some(condition: Column, one: Column) -> Column:
    """An array of the finding, or none."""
    return F.when(condition, F.array(one)).otherwise(no_findings())


def floor(evidence: Column) -> Column:
    """JN-09: least rank of an evidence code."""
    out = F.lit(0)
    for code, rank in FLOORS.items():
        out = F.when(evidence == code, F.lit(rank)).otherwise(out)
    return out


def failure_evidence(kind: Column) -> Column:
    """JN-10: the evidence code of a kind of failure."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in FAILURES.items() for x in kv)), kind)


def safe_location(location: Column) -> Column:
    """A location of the grammar, or the whole file."""
    return F.when(location.rlike(LOCATION), location).otherwise(F.lit("file:structure"))


def completed(findings: Column, required: Column, done: Column) -> Column:
    """AGG-03: findings, and one more if a required check was not completed."""
    missing = F.size(F.array_except(required, done)) > 0
    return F.concat(findings, some(missing, finding(QUARANTINE, FAILURES["DEPENDENCY"], "file:structure")))


def rank(findings: Column) -> Column:
    """AGG-01: the highest of the findings' risks and of their evidence's floors."""
    return F.coalesce(F.array_max(F.transform(findings, lambda f: F.greatest(f["risk"], floor(f["evidence"])))), F.lit(0))


def _codes(findings: Column, name: str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(findings, lambda f: f[name]))))


def verdict(findings: Column, raised_to: Column | None = None) -> Column:
    """AGG-01/02: risk level and sorted distinct codes; a classifier's rank can only raise it."""
    own = rank(findings) if raised_to is None else F.greatest(rank(findings), F.coalesce(raised_to, F.lit(0)))
    return F.struct(
        F.element_at(F.array(*(F.lit(r) for r in RISKS)), own + 1).alias("risk_level"),
        _codes(findings, "evidence").alias("evidence"),
        _codes(findings, "location").alias("location"),
        _codes(findings, "anomaly").alias("structural_anomalies"),
    )


def verdict_rows(findings: DataFrame, key: str) -> DataFrame:
    """AGG-01 over exploded findings: one aggregation, with partial sets before the shuffle."""
    codes = lambda c: F.array_sort(F.collect_set(c))
    out = findings.groupBy(key).agg(F.max(F.greatest("risk", floor(F.col("evidence")))).alias("rank"), codes("evidence").alias("evidence"), codes("location").alias("location"), codes("anomaly").alias("structural_anomalies"))
    return out.select(key, F.element_at(F.array(*(F.lit(r) for r in RISKS)), F.col("rank") + 1).alias("risk_level"), "evidence", "location", "structural_anomalies")


def result_json(result: Column) -> Column:
    """SNK-01: the four public fields as compact JSON and a line feed."""
    names = ("risk_level", "evidence", "location", "structural_anomalies")
    return F.concat(F.to_json(F.struct(*(result[n].alias(n) for n in names)), {"ignoreNullFields": "false"}), F.lit("\n"))


def derivative(result: Column, visible_text: Column) -> Column:
    """SNK-02: the marked text of a low result, else null."""
    return F.when(result["risk_level"] == "low", F.concat(F.lit(MARKER), F.regexp_replace(visible_text, r"\n+\z", ""), F.lit("\n")))


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in RISKS)), level).cast("int") - 1


def gate(verdicts: DataFrame, fail_on: str) -> DataFrame:
    """SNK-08: the rows that fail a threshold; the gate is open if there are none."""
    return verdicts.where(risk_rank(F.col("risk_level")) >= RISKS.index(fail_on))


def floor_violations(verdicts: DataFrame) -> DataFrame:
    """FLT-06: rows whose risk is under the floor of one of their evidence codes."""
    least = F.coalesce(F.array_max(F.transform("evidence", floor)), F.lit(0))
    return verdicts.where(risk_rank(F.col("risk_level")) < least)
