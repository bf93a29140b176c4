"""Queries on what reports are made of: references, findings, proposals, metrics against specs, page summaries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capabilities, evidence, metrics, robots
from ..sources import captures
from .derived_queries import _GOLD, _STATE, CAPS_SQL, METRIC_SQL, ROBOTS_SQL, _golden
from .fixtures import derived, table

Q, O = {}, {}


def query(sql: str):
    def add(f):
        Q[f.__name__], O[f.__name__] = f, sql
        return f

    return add


REF_SQL = "SELECT CAST(l_suppkey AS STRING) AS site, CAST(l_orderkey % 27 AS INT) AS `check`, CAST(l_linenumber AS INT) AS place, CAST(l_partkey % 60 AS STRING) AS id FROM lineitem"
_REF = REF_SQL.replace("`", '"')


@query(f"""WITH r AS ({_REF}), f AS (SELECT site, id, min("check" * 100 + place) AS f FROM r GROUP BY site, id)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY f.f, f.id)::INTEGER AS position, id FROM f""")
def evidence_references(spark, sf):
    return evidence.ordered_references(derived(spark, sf, REF_SQL, "lineitem"))


STORE_SQL = "SELECT CAST(p_size AS STRING) AS site, CAST(p_partkey % 60 AS STRING) AS id, 'text' AS kind, p_name AS raw FROM part"


@query(f"""WITH r AS ({_REF}), s AS (SELECT DISTINCT site, id, kind FROM ({STORE_SQL})) SELECT r.site, r."check", r.place, r.id, s.kind FROM r JOIN s ON s.site = r.site AND s.id = r.id""")
def evidence_drawer(spark, sf):
    rows = derived(spark, sf, STORE_SQL, "part").select("site", "id", "kind").distinct()
    return evidence.drawer(derived(spark, sf, REF_SQL, "lineitem"), rows)


FIND_SQL = """
SELECT event_id AS id, CASE WHEN event_id % 5 = 4 THEN 'text' ELSE 'injection' END AS kind, CASE WHEN event_id % 4 = 0 THEN 'injection#clean' ELSE 'injection#p#visible_text' END AS selector,
  CASE event_id % 3 WHEN 0 THEN 'category: agent_directive' || chr(10) || 'found (severity high)' || chr(10) || event_type || chr(10) WHEN 1 THEN 'category: exfiltration (severity odd)' || chr(10) || 'x' ELSE 'nothing' END AS raw FROM events"""


@query(f"""SELECT id, CASE id % 3 WHEN 0 THEN 'agent_directive' WHEN 1 THEN 'exfiltration (severity odd)' ELSE 'unknown' END AS category, CASE id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity,
  CASE id % 3 WHEN 0 THEN string_split(raw, chr(10))[3] WHEN 1 THEN 'x' ELSE 'nothing' END AS description FROM ({FIND_SQL}) WHERE kind = 'injection' AND selector <> 'injection#clean'""")
def injection_findings(spark, sf):
    return evidence.injection_findings(derived(spark, sf, FIND_SQL, "events"))


@query("""WITH m AS (SELECT doc_id, text, instr(text, 'an') - 1 AS a FROM documents WHERE contains(text, 'an')),
b AS (SELECT doc_id, text, greatest(a - 53, 0) AS i, least(a + 2 + 80, length(text)) AS j FROM m)
SELECT doc_id, CASE WHEN i > 0 THEN '…' ELSE '' END || array_to_string(list_filter(string_split_regex(substr(text, i + 1, j - i), '\\s+'), lambda x: x <> ''), ' ') || CASE WHEN j < length(text) THEN '…' ELSE '' END AS snippet FROM b""")
def match_snippets(spark, sf):
    at = F.instr("text", "an") - 1
    return table(spark, sf, "documents").where(at >= 0).select("doc_id", T.snippet(F.col("text"), at, at + 2).alias("snippet"))


@query(f"""WITH c AS (SELECT * FROM ({CAPS_SQL}) WHERE cap_id % 3 = 0 AND cap_id % 4 > 0), n AS (SELECT count(*) AS tools, count(*) FILTER (WHERE {_STATE}) AS changing FROM c)
SELECT tools, changing, CASE WHEN tools = 0 THEN 0.0 ELSE changing / tools END::DOUBLE AS rate FROM n""")
def state_changing_rate(spark, sf):
    caps = derived(spark, sf, CAPS_SQL, "orders")
    return capabilities.state_changing_rate(caps.withColumns({"accepted": F.col("cap_id") % 3 == 0, "has_tool": F.col("cap_id") % 4 > 0}))


PLACES_SQL = "SELECT p_partkey AS id, p_size * 1000 + p_partkey % 7 AS ord FROM part"


@query(f"""WITH c AS (SELECT DISTINCT l_orderkey AS cap_id, l_partkey AS id FROM lineitem), j AS (SELECT c.cap_id, c.id, row_number() OVER (PARTITION BY c.cap_id ORDER BY f.ord, c.id) AS position FROM c JOIN ({PLACES_SQL}) f ON f.id = c.id)
SELECT cap_id, position::INTEGER AS position, id FROM j WHERE position <= 3""")
def cited_evidence_rows(spark, sf):
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cap_id"), F.col("l_partkey").alias("id"))
    return capabilities.cited_rows(cited, derived(spark, sf, PLACES_SQL, "part"), most=3)


PROPOSED_SQL = "SELECT CAST(o_custkey AS STRING) AS site, o_orderkey AS place, CAST(o_orderkey % 9 AS STRING) || ',' || CAST(o_custkey % 5 AS STRING) || ',' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS ids FROM orders"


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place) AS i FROM ({PROPOSED_SQL})), g AS (SELECT site, place, list_filter(string_split(ids, ','), lambda x: x <> '') AS ids FROM p WHERE i <= 12),
s AS (SELECT DISTINCT c_custkey::VARCHAR AS site, (c_custkey % 6)::VARCHAR AS a, (c_custkey % 4)::VARCHAR AS b FROM customer),
k AS (SELECT g.site, place, list_filter(ids, lambda x: x = coalesce(a, '-') OR x = coalesce(b, '-')) AS kept, list_filter(ids, lambda x: NOT (x = coalesce(a, '-') OR x = coalesce(b, '-'))) AS lost FROM g LEFT JOIN s ON s.site = g.site)
SELECT site, place, array_to_string(kept, ',') AS kept, array_to_string(lost, ',') AS hallucinated, CASE WHEN len(kept) = 0 THEN 'dropped' WHEN len(lost) > 0 THEN 'reported' ELSE 'ok' END AS status FROM k""")
def induced_proposals(spark, sf):
    c = F.col("c_custkey")
    shown = table(spark, sf, "customer").select(c.cast("string").alias("site"), F.explode(F.array((c % 6).cast("string"), (c % 4).cast("string"))).alias("id"))
    proposals = derived(spark, sf, PROPOSED_SQL, "orders").select("site", "place", F.split("ids", ",").alias("evidence_ids"))
    out = capabilities.induced(proposals, shown)
    return out.select("site", "place", F.array_join("kept", ",").alias("kept"), F.array_join("hallucinated", ",").alias("hallucinated"), "status")


_STATUS = """CASE WHEN value IS NULL THEN 'BLOCKED' WHEN class = 'tuning' AND samples < 10 THEN 'THIN' WHEN target IS NULL OR comparison = 'info' THEN 'PASS'
  WHEN comparison = '>=' AND value >= target OR comparison = '<=' AND value <= target OR comparison = '==' AND abs(value - target) < 1e-9 THEN 'PASS' WHEN class = 'gate' THEN 'FAIL' ELSE 'BELOW' END"""


@query(f"SELECT id % 9 AS run, coalesce(bool_and(s = 'PASS') FILTER (WHERE class = 'gate'), true) AS gates_pass, count(*) FILTER (WHERE s = 'THIN') AS thin, count(*) FILTER (WHERE s = 'BLOCKED') AS blocked FROM (SELECT *, {_STATUS} AS s FROM ({METRIC_SQL})) GROUP BY 1")
def eval_gates(spark, sf):
    m = derived(spark, sf, METRIC_SQL, "customer")
    status = metrics.metric_status(*(F.col(c) for c in ("value", "samples", "class", "target", "comparison")))
    return metrics.gates(m.withColumns({"run": F.col("id") % 9, "status": status}))


SPEC_SQL = """SELECT n_nationkey AS n, CASE n_nationkey % 4 WHEN 0 THEN 'a_seconds' WHEN 1 THEN 'b_usd' WHEN 2 THEN 'c_delta' ELSE 'd' END || CAST(n_nationkey AS STRING) AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'gate' ELSE 'tuning' END AS class,
  CASE WHEN n_nationkey % 6 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 0.5 ELSE CAST(n_nationkey AS DOUBLE) END AS target, CASE n_nationkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '==' ELSE 'info' END AS comparison FROM nation WHERE n_nationkey < 20"""
_VALUE = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) / 8 END"
RESULT_SQL = f"SELECT c_custkey AS id, c_nationkey AS n, {_VALUE} AS value, CAST(c_custkey % 23 AS INT) AS samples FROM customer"


@query(f"""WITH s AS ({SPEC_SQL}), r AS ({RESULT_SQL}) SELECT id, {_STATUS} AS status, CASE WHEN value IS NULL THEN '—' ELSE printf('%.3f', value) END AS value_text,
  CASE WHEN target IS NULL OR comparison = 'info' THEN '—' ELSE comparison || CASE WHEN target = floor(target) THEN target::BIGINT::VARCHAR ELSE target::VARCHAR END END AS target_text FROM r JOIN s ON s.n = r.n""")
def eval_specs(spark, sf):
    specs = derived(spark, sf, SPEC_SQL, "nation")
    results = derived(spark, sf, RESULT_SQL, "customer").join(F.broadcast(specs.select("n", "key")), "n").drop("n")
    return metrics.with_specs(results, specs.drop("n")).select("id", "status", "value_text", "target_text")


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE c_custkey % 4 > 0 AND c_custkey % 3 > 0) AS labelled FROM customer")
def label_status(spark, sf):
    k = F.col("c_custkey")
    band = F.when(k % 4 == 1, "Readable").when(k % 4 > 1, "Emerging").when(k % 8 == 0, "")
    return metrics.label_status(table(spark, sf, "customer").select(band.alias("expected_band"), F.when(k % 3 == 1, F.array(F.lit("a"))).when(k % 3 == 2, F.array(F.lit("b"), F.lit("c"))).when(k % 6 == 0, F.array().cast("array<string>")).alias("capabilities")))


@query(f"WITH {_GOLD} SELECT name, row_number() OVER (ORDER BY recall DESC, name)::INTEGER AS position FROM ps")
def eval_sites_by_recall(spark, sf):
    """Sites of an evaluation by falling recall: some dozens, numbered in one window."""
    from pyspark.sql import Window

    return _golden(spark, sf).select("name", F.row_number().over(Window.orderBy(F.desc("recall"), "name")).alias("position"))


@query("SELECT page_id, length(coalesce(html, ''))::INTEGER AS pre_js_chars, 0 AS post_js_chars, 200 AS status_code, true AS degraded, false AS robots_blocked FROM pages")
def page_summaries(spark, sf):
    found = captures.summaries(captures.from_pages(table(spark, sf, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))))
    return found.select(F.substring_index("url", "#", -1).cast("long").alias("page_id"), "pre_js_chars", "post_js_chars", "status_code", "degraded", "robots_blocked")


@query(f"SELECT id, id % 5 NOT IN (0, 1) AS allowed FROM ({ROBOTS_SQL})")
def robots_allowed(spark, sf):
    r = derived(spark, sf, ROBOTS_SQL, "supplier")
    pairs = r.select("id", F.col("raw").alias("robots"), F.lit("https://s.example/cart/1").alias("url"))
    return robots.allowed(pairs, "GPTBot").select("id", "allowed")


FILES_SQL = """
SELECT n_nationkey AS id, 'Disallow: /lost' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /x' || chr(10) || 'Disallow: /o' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || chr(10) || 'User-Agent: gptbot # ours' || chr(10) || 'user-agent: Other' || chr(10) || 'Allow: /o/1' || chr(10)
  || 'Disallow: /o/' || CAST(n_nationkey % 7 AS STRING) || '?k=%41' || chr(10) || 'crawl-delay: 3' || chr(10) || 'Disallow: /o/2' || chr(10) || 'Disallow:' ELSE '' END AS robots
FROM nation"""
URL_SQL = "SELECT o_orderkey AS id, o_custkey % 26 AS file, 'https://s.example' || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/o/' || CAST(o_orderkey % 9 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '?k=A' ELSE '#' END END AS url FROM orders"


@query(f"""
WITH u AS ({URL_SQL}), p AS (SELECT id, file, CASE WHEN length(url) = 17 THEN '/' ELSE rtrim(substr(url, 18), '#') END AS path FROM u)
SELECT id, CASE WHEN file = 25 THEN true WHEN file % 2 = 1 THEN NOT (starts_with(path, '/x') OR starts_with(path, '/o'))
  WHEN starts_with(path, '/o/1') THEN true WHEN starts_with(path, '/o/' || (file % 7) || '?k=A') OR starts_with(path, '/o/2') THEN false ELSE true END AS allowed FROM p""")
def robots_first_match(spark, sf):
    """Answers of the files of 25 sites to the URLs of orders; site 25 has no file."""
    files = derived(spark, sf, FILES_SQL, "nation").withColumnRenamed("id", "file")
    return robots.allowed(derived(spark, sf, URL_SQL, "orders").join(files, "file", "left"), "GPTBot/1.0").select("id", "allowed")


@query("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '+/o/1 -/o/' || (n_nationkey % 7) || '%3Fk%3DA -/o/2 +' ELSE '-/x -/o' END AS rules FROM nation""")
def robots_rule_table(spark, sf):
    """The rules that count for an agent, of every file, in order: + allows, - refuses."""
    files = derived(spark, sf, FILES_SQL, "nation").select(F.col("id").alias("file"), F.col("robots").alias("text"))
    shown = F.array_join(F.transform("rules", lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["path"])), " ")
    return robots.rules(files, "GPTBot").select(F.col("file").alias("id"), shown.alias("rules"))


@query("SELECT s_suppkey AS id, s_suppkey % 101 AS maximum, CASE WHEN s_suppkey % 101 = 0 THEN 100 ELSE least(s_suppkey % 101, 100) END AS number, CASE WHEN s_suppkey % 3 = 0 THEN 500 ELSE least(s_suppkey % 3 * 400, 500) END AS length FROM supplier")
def parameter_bounds(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), (k % 101).alias("maximum"), T.bounded_number(k % 101).alias("number"), T.bounded_length(F.when(k % 3 > 0, k % 3 * 400)).alias("length"))
