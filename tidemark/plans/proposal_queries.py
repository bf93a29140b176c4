"""Queries on requests, proposals, tool schemas and reports, with their DuckDB counterparts."""

import uuid

from pyspark.sql import functions as F

from ..operators import proposals, rubric
from ..sources import captures, reports
from .derived_queries import _EV, _RES, _AGG, _evidence, _inputs
from .fixtures import derived, table
from .stages import shared_dir

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


BODY_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '{"url": "https://s.example/' || CAST(o_custkey AS STRING) || '"}' WHEN 1 THEN '{"url": "http://s.example"}' WHEN 2 THEN '{"fixture": "f' || CAST(o_custkey AS STRING) || '", "url": "https://s.example"}'
  WHEN 3 THEN '{"acknowledge_generation": true}' WHEN 4 THEN '{"url": "https://s.example", "x": 1}' WHEN 5 THEN '[1]' WHEN 6 THEN '{"url": 5}' ELSE '{"url": null, "fixture": "g", "acknowledge_generation": false}' END AS body FROM orders"""


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, o_custkey AS c FROM orders)
SELECT id, CASE WHEN k IN (0, 2, 7) THEN 202 ELSE 422 END AS status, CASE k WHEN 0 THEN 'live' WHEN 2 THEN 'fixture' WHEN 7 THEN 'fixture' END AS source,
  CASE k WHEN 0 THEN 'https://s.example/' || c WHEN 2 THEN 'f' || c WHEN 7 THEN 'g' END AS target,
  CASE k WHEN 1 THEN 'not_https' WHEN 3 THEN 'nothing_to_scan' WHEN 4 THEN 'unknown_key' WHEN 5 THEN 'not_an_object' WHEN 6 THEN 'wrong_type' END AS reason FROM r""")
def scan_requests(spark, sf):
    """Bodies of scan requests: each is taken with its target or refused with a reason."""
    return proposals.requests(derived(spark, sf, BODY_SQL, "orders")).select("id", "status", "source", "target", "reason")


ANSWER_SQL = """
SELECT CAST(c_custkey AS STRING) AS site, CASE WHEN c_custkey % 9 = 0 THEN 'I cannot help.' ELSE 'Sure: {"capabilities": [{"name": " Find-Room ' || CAST(c_custkey AS STRING) || '", "verb": "Find", "noun": "Room", "evidence_ids": ["' || CAST(c_custkey % 3 AS STRING) || '", "e9", ""]}, "text", {"name": "", "evidence_ids": ["1"]}, {"name": "b", "evidence_ids": ["' || CAST(c_custkey % 7 AS STRING) || '"], "state_changing": ' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '},]}' END AS answer FROM customer"""


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 > 0), s AS (SELECT * FROM (VALUES ('0'), ('1'), ('2')) t(id)),
e AS (
  SELECT k, 0 AS place, 'find_room_' || k AS name, 'find' AS verb, CAST(k % 3 AS VARCHAR) AS kept, 'e9' AS lost, NULL AS reason, false AS state_changing FROM c
  UNION ALL SELECT k, 1, '', '', '', '', 'not_an_object', false FROM c
  UNION ALL SELECT k, 2, '', '', '1', '', 'no_name', false FROM c
  UNION ALL SELECT k, 3, 'b', '', CASE WHEN k % 7 < 3 THEN CAST(k % 7 AS VARCHAR) ELSE '' END, CASE WHEN k % 7 < 3 THEN '' ELSE CAST(k % 7 AS VARCHAR) END, CASE WHEN k % 7 < 3 THEN NULL ELSE 'ungrounded' END, k % 2 = 0 FROM c)
SELECT k::VARCHAR AS site, place::INTEGER AS place, name, verb, kept AS evidence_ids, lost AS hallucinated, state_changing, reason FROM e""")
def proposed_capabilities(spark, sf):
    """Entries of recorded answers: those that stand, and those that are refused, with what they made up."""
    sites = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("site"))
    shown = sites.select("site", F.explode(F.array(*map(F.lit, "012"))).alias("id"))
    out = proposals.proposed(derived(spark, sf, ANSWER_SQL, "customer"), shown)
    return out.select("site", "place", "name", "verb", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("hallucinated", ",").alias("hallucinated"), "state_changing", "reason")


TOOL_SQL = """
SELECT o_orderkey AS cap_id, CASE o_orderkey % 5 WHEN 0 THEN '{"tool": {"name": " t' || CAST(o_custkey AS STRING) || ' ", "description": " d ", "parameters": {"q": {"type": "string", "description": "x", "maxLength": 900}, "n": {"type": "integer", "maximum": 7}, "free": {"type": "string"}, "odd": 5}, "returns": "r"}}'
  WHEN 1 THEN '{"tool": {"parameters": [1]}}' WHEN 2 THEN '{"tool": "x"}' WHEN 3 THEN 'sorry' END AS answer FROM orders WHERE o_orderkey % 5 < 4"""
TOOL_CAPS = "SELECT o_orderkey AS cap_id, 'www.s' || CAST(o_custkey % 9 AS STRING) || '.com' AS domain, 'n' AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'book' ELSE 'find' END AS verb, 'room' AS noun, false AS state_changing FROM orders"


@query("""
WITH o AS (SELECT o_orderkey AS cap_id, o_orderkey % 3 = 0 AS changes, o_orderkey % 5 AS k, o_custkey AS c FROM orders),
r AS (SELECT *, CASE WHEN changes THEN 'state_changing' WHEN k = 4 THEN 'no_answer' WHEN k IN (2, 3) THEN 'no_tool' ELSE 'tool' END AS outcome FROM o)
SELECT cap_id, outcome, CASE WHEN outcome = 'tool' THEN CASE k WHEN 0 THEN 't' || c ELSE 's' || (c % 9) || '_find_room' END END AS tool, CASE WHEN outcome = 'tool' AND k = 0 THEN 'free,n,q' WHEN outcome = 'tool' THEN '' END AS parameters,
  CASE WHEN outcome = 'tool' AND k = 0 THEN 500::INTEGER END AS q_length, CASE WHEN outcome = 'tool' AND k = 0 THEN 7::INTEGER END AS n_maximum, CASE WHEN outcome = 'tool' AND k = 0 THEN 'free,odd' WHEN outcome = 'tool' THEN '' END AS offenders FROM r""")
def synthesized_tools(spark, sf):
    """Capabilities with the tool that a recorded answer gives them, its parameters bounded; one outcome each."""
    out = proposals.synthesized(derived(spark, sf, TOOL_CAPS, "orders"), derived(spark, sf, TOOL_SQL, "orders"))
    of = lambda name, field: F.try_element_at("tool.parameters", F.lit(name))[field]
    return out.select("cap_id", "outcome", F.col("tool.name").alias("tool"), F.array_join(F.array_sort(F.map_keys("tool.parameters")), ",").alias("parameters"), of("q", "max_length").alias("q_length"), of("n", "maximum").alias("n_maximum"), F.array_join("offenders", ",").alias("offenders"))


@query(f"""
WITH {_EV}, {_AGG}, {_RES}, c AS (SELECT o_custkey::VARCHAR AS site, o_orderkey % 2 = 0 AS accepted FROM orders)
SELECT site, 'score' AS part, 1::BIGINT AS n FROM inp UNION ALL SELECT site, 'check', count(*) FROM res GROUP BY site UNION ALL SELECT site, 'evidence', count(*) FROM ev GROUP BY site
UNION ALL SELECT site, 'finding', count(*) FROM ev WHERE kind = 'injection' AND selector <> 'injection#clean' GROUP BY site UNION ALL SELECT s_suppkey::VARCHAR, 'page', 1 FROM supplier
UNION ALL SELECT site, CASE WHEN accepted THEN 'capability' ELSE 'rejection' END, count(*) FROM c GROUP BY site, accepted""")
def report_parts(spark, sf):
    """Reports of all sites written as JSON lines by part and read again: rows of each part."""
    at = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"

    def staged(name, rows):
        """Parts of a report read what others have read: it is made once."""
        rows.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    rows, inputs = staged("evidence", _evidence(spark, sf)), _inputs(spark, sf)
    results = staged("results", rubric.check_results(rows, inputs))
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example/")).alias("url"), F.lit("").alias("html"))
    pages = captures.summaries(captures.from_pages(pages)).withColumn("site", F.regexp_extract("url", "s([0-9]+)", 1))
    caps = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("site"), F.col("o_orderkey").alias("cap_id"), F.lit("n").alias("name"), F.lit("d").alias("description"), (F.col("o_orderkey") % 2 == 0).alias("accepted"), F.lit("evidence_mismatch").alias("rule"))
    reports.write_reports(reports.report_rows(rubric.site_scores(results, inputs), results, pages, rows, caps), f"{at}/reports")
    back = spark.read.schema("site string, ord string, body string, part string").json(f"{at}/reports")
    return back.where(F.try_parse_json("body").isNotNull()).groupBy("site", "part").agg(F.count("*").alias("n"))
