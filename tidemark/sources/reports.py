"""Sinks: report documents in parts, and evidence snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as E

PARTS = ("score", "check", "page", "evidence", "capability", "rejection", "finding")


def report_rows(scores: DataFrame, results: DataFrame, pages: DataFrame, evidence: DataFrame, capabilities: DataFrame) -> DataFrame:
    """site, part, ord, body (JSON): a report of each site, one row by score, check, page, evidence row, capability, rejection and finding.

    A report is a table of parts, not one document, so a site with many rows is
    no single value. pages as captures.summaries; capabilities: site, cap_id,
    name, description, accepted, rule. Findings are of injection evidence.
    """

    def part(name: str, rows: DataFrame, order: Column, *fields: str) -> DataFrame:
        return rows.select("site", F.lit(name).alias("part"), order.cast("string").alias("ord"), F.to_json(F.struct(*fields)).alias("body"))

    found = E.injection_findings(evidence, "site", "ord")
    return (
        part("score", scores, F.lit("0"), "total", "max_possible", "percentage", "band", "confidence", "reason")
        .unionByName(part("check", results, F.col("check_id"), "axis", "check_id", "label", "points", "max_points", "suppressed", "reason", "evidence_refs"))
        .unionByName(part("page", pages, F.col("url"), "url", "final_url", "status_code", "robots_blocked", "degraded", "pre_js_chars", "post_js_chars", "fetch_error"))
        .unionByName(part("evidence", evidence, F.col("ord"), "id", "kind", "source_url", "selector", "raw", "phase"))
        .unionByName(part("capability", capabilities.where("accepted"), F.col("cap_id"), "cap_id", "name", "description"))
        .unionByName(part("rejection", capabilities.where("not accepted"), F.col("cap_id"), "cap_id", "name", "rule"))
        .unionByName(part("finding", found, F.col("ord"), "id", "category", "severity", "description"))
    )


def write_reports(reports: DataFrame, at: str) -> None:
    """Rows of reports as JSON lines, a folder for each part."""
    reports.write.partitionBy("part").json(at)


def write_snapshot(rows: DataFrame, at: str) -> None:
    """Evidence for generated tools, as JSON lines."""
    E.snapshot(rows).select("id", "source_url", "kind", "selector", "content").write.json(at)
