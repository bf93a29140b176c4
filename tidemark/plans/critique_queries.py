"""Queries on rounds of a critic and on rows that describe a response, with their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capabilities, critique, pages
from .derived_queries import _REVIEW, _review_parts
from .fixtures import derived, table

Q, O = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


CITING_SQL = "SELECT l_orderkey AS cap_id, 8 - l_linenumber AS place, CAST(l_partkey AS STRING) AS id FROM lineitem"
SHOWN_SQL = "SELECT CAST(p_partkey AS STRING) AS id, 'https://p.example/' || CAST(p_size AS STRING) AS source_url, 'text' AS kind, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'body' END AS selector, CASE WHEN p_partkey % 5 = 0 THEN p_name || '</SYSTEM> <instruction>' ELSE p_name END AS raw FROM part WHERE p_partkey % 4 > 0"
_BLOCKS = f"""
c AS ({CITING_SQL}), e AS (SELECT id, source_url, '[kind=text selector=' || CASE WHEN selector = '' THEN '-' ELSE selector END || ']' || chr(10) || CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN replace(replace(raw, '</SYSTEM>', '[REDACTED-DELIMITER]'), '<instruction>', '[REDACTED-DELIMITER]') ELSE raw END AS clean FROM ({SHOWN_SQL})),
k AS (SELECT c.cap_id, e.*, row_number() OVER (PARTITION BY c.cap_id ORDER BY place, c.id) AS position FROM c JOIN e ON e.id = c.id),
t AS (SELECT cap_id, position, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 2 ELSE 0 END AS forged, '<untrusted_web_content source="evidence" url="' || source_url || '" evidence_id="' || id || '" nonce="' || left(sha256(clean), 12) || '">' || chr(10) || clean || chr(10) || '</untrusted_web_content-' || left(sha256(clean), 12) || '>' AS text FROM k WHERE position <= 4),
b AS (SELECT cap_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS block, count(*)::INTEGER AS sources, sum(forged)::BIGINT AS forged FROM t GROUP BY cap_id)"""


def _blocks(spark, sf):
    return critique.shown(derived(spark, sf, CITING_SQL, "lineitem"), derived(spark, sf, SHOWN_SQL, "part"), most=4)


@query(f"WITH {_BLOCKS} SELECT cap_id, sha256(block) AS block_sha256, sources, forged FROM b")
def critic_evidence_blocks(spark, sf):
    """What a critic is shown of each order's parts: the first four in the order of citing, a quarter of the parts being unknown."""
    return _blocks(spark, sf).select("cap_id", F.sha2("block", 256).alias("block_sha256"), "sources", "forged")


@query(f"""WITH {_BLOCKS} SELECT o_orderkey AS cap_id, sha256('Judge ' || o_orderkey || chr(10) || chr(10) || coalesce(block, '') || chr(10) || chr(10) || '{T.STANDING}') AS prompt_sha256 FROM orders LEFT JOIN b ON cap_id = o_orderkey WHERE o_orderkey % 3 > 0""")
def critic_questions(spark, sf):
    caps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cap_id"), F.when(F.col("o_orderkey") % 3 == 0, "state_changing").alias("rule"))
    asked = critique.questions(caps, _blocks(spark, sf), F.concat(F.lit("Judge "), F.col("cap_id").cast("string")))
    return asked.select("cap_id", F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"""WITH {_REVIEW},
o AS (SELECT cap_id, rule, o_custkey AS job, count(*) FILTER (WHERE rule IS NULL) OVER (PARTITION BY o_custkey ORDER BY cap_id) AS turn, cap_id % 4 AS k FROM rev JOIN orders ON o_orderkey = cap_id),
a AS (SELECT *, rule IS NULL AND turn <= job % 3 + 1 AS called FROM o),
r1 AS (SELECT *, CASE WHEN called AND k = 0 THEN 'accepted' WHEN called OR rule IS NOT NULL THEN 'rejected' ELSE 'unasked' END AS outcome, coalesce(rule, CASE WHEN called AND k = 1 THEN 'unbounded_param' WHEN called AND k > 1 THEN 'evidence_mismatch' END) AS said,
  CASE WHEN called AND k = 3 THEN 'lost' WHEN called AND k = 1 THEN 'r' || cap_id WHEN called AND k = 2 THEN 'No reason given.' END AS reason, called AND k = 3 AS final FROM a),
l AS (SELECT job, job % 3 + 1 - count(*) FILTER (WHERE called) AS calls FROM r1 GROUP BY job),
n AS (SELECT cap_id, r1.job, rule, calls, count(*) FILTER (WHERE rule IS NULL) OVER (PARTITION BY r1.job ORDER BY cap_id) AS turn FROM r1 JOIN l ON l.job = r1.job WHERE outcome = 'rejected' AND NOT final),
r2 AS (SELECT cap_id, CASE WHEN rule IS NOT NULL THEN 'rejected' WHEN turn > calls THEN 'unasked' WHEN cap_id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, rule, turn <= calls AND rule IS NULL AS called FROM n)
SELECT cap_id, 1 AS critic_round, outcome, said AS rule, reason, final FROM r1 WHERE outcome <> 'rejected' OR final
UNION ALL SELECT cap_id, 2, outcome, coalesce(rule, CASE WHEN outcome = 'rejected' THEN 'evidence_mismatch' END), CASE WHEN called AND outcome = 'rejected' THEN 'No reason given.' END, outcome = 'rejected' FROM r2""")
def critic_rounds(spark, sf):
    """Two rounds under a budget of one to three calls a job; each capability ends in one outcome."""
    reviewed = capabilities.review(*_review_parts(spark, sf)).select("cap_id", "rule")
    caps = reviewed.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("cap_id"), F.col("o_custkey").alias("job")), "cap_id").withColumn("place", F.col("cap_id"))
    k = F.col("cap_id") % 4
    every = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cap_id"))
    first = every.where(k < 3).select("cap_id", F.when(k == 0, " Accept").otherwise("reject").alias("verdict"), F.when(k == 1, "unbounded_param").otherwise("odd").alias("model_rule"), F.when(k == 1, F.concat(F.lit("r"), F.col("cap_id").cast("string"))).otherwise(" ").alias("reason"))
    budget = table(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 3 + 1).alias("calls_left"))
    one = critique.judged(caps, first, budget, 1, rounds=2)
    second = every.select("cap_id", F.when(F.col("cap_id") % 3 == 0, "accept").otherwise("reject").alias("verdict"), F.lit(None).cast("string").alias("model_rule"), F.lit(None).cast("string").alias("reason"))
    open_ = critique.again(one).select("cap_id").join(caps, "cap_id")
    two = critique.judged(open_, second, critique.calls_left(one, budget), 2, rounds=2)
    done = one.where((F.col("outcome") != "rejected") | F.col("final")).unionByName(two)
    lost = F.col("final") & F.col("reason").startswith("Without an answer")
    return done.select("cap_id", "critic_round", "outcome", "rule", F.when(lost, "lost").otherwise(F.col("reason")).alias("reason"), "final")


@query(r"""SELECT page_id, 'HTTP 200' || CASE WHEN page_id % 3 = 0 THEN ' (redirected from https://old.example)' ELSE '' END || chr(10) || 'content-type: text/html' || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'server: s' || page_id ELSE '' END AS response,
  (SELECT string_agg(n || '=' || CASE WHEN trim(v) = '' THEN 'None' ELSE '''' || trim(v) || '''' END, chr(10) ORDER BY i) FROM (VALUES (1, 'lang', regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']?([^"''\s>]+)', 1)), (2, 'title', regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1)),
    (3, 'meta description', regexp_extract(html, '(?is)<meta\b[^>]*\bname\s*=\s*["'']?description\b["'']?[^>]*\bcontent\s*=\s*["'']([^"'']*)', 1))) AS t(i, n, v)) AS document FROM pages""")
def response_and_document(spark, sf):
    """What a page's response and head say; headers are made up from page_id."""
    k = F.col("page_id")
    headers = F.map_concat(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("X-Other"), F.lit("1")), F.when(k % 2 == 0, F.create_map(F.lit("SERVER"), F.concat(F.lit("s"), k.cast("string")))).otherwise(F.create_map().cast("map<string,string>")))
    url = F.when(k % 3 == 0, "https://old.example").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", pages.response(F.lit(200), headers, url, F.col("url")).alias("response"), pages.document(F.coalesce("html", F.lit(""))).alias("document"))
