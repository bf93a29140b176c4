"""Queries over rows derived from the star tables: site files, structured data, rubric, review, metrics, queues."""

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import capabilities, evidence, metrics, policy, queueing, rubric, sites, structured
from ..sources import captures
from ..streaming import events as streams
from .fixtures import EVIDENCE_SQL, INPUTS_SQL, derived, evidence_rows, table

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


# --- site files -------------------------------------------------------------------
ROBOTS_SQL = """
SELECT s_suppkey AS id, CASE s_suppkey % 5
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /cart' || chr(10) || 'Sitemap: https://s' || CAST(s_suppkey AS STRING) || '.example/sitemap.xml'
  WHEN 1 THEN 'user-agent: GPTBot # ai' || chr(10) || 'Disallow: /' || chr(10) || 'User-Agent: ClaudeBot' || chr(10) || 'Allow: /' || chr(10) || 'User-agent: GPTBot'
  WHEN 2 THEN 'User-agent: Bingbot' || chr(10) || 'Crawl-delay: 5' || chr(10) || 'sitemap: https://a.example/1.xml' || chr(10) || 'Sitemap: https://a.example/1.xml'
  WHEN 3 THEN '' ELSE s_name END AS raw FROM supplier"""
_ORDERED = "list_filter(a, lambda x, i: list_position(a, x) = i)"
_AI = " OR ".join(f"contains(lower(x), '{t}')" for t in sites.AI_AGENTS)


@query(f"""
WITH r AS ({ROBOTS_SQL}), x AS (SELECT id, list_transform(regexp_extract_all(raw, '(?im)^[ \\t]*user-agent[ \\t]*:[ \\t]*([^#\\r\\n]*[^#\\s])', 1), lambda x: trim(x)) AS a FROM r), o AS (SELECT id, {_ORDERED} AS agents FROM x)
SELECT id, array_to_string(agents, ',') AS agents, array_to_string(list_filter(agents, lambda x: {_AI}), ',') AS ai FROM o""")
def robots_agents(spark, sf):
    r = derived(spark, sf, ROBOTS_SQL, "supplier")
    return r.select("id", F.array_join(sites.robots_agents(F.col("raw")), ",").alias("agents"), F.array_join(sites.ai_agents(F.col("raw")), ",").alias("ai"))


@query(f"""
WITH r AS ({ROBOTS_SQL}), x AS (SELECT id, regexp_extract_all(raw, '(?im)^[ \\t]*sitemap[ \\t]*:[ \\t]*(\\S+)', 1) AS a FROM r)
SELECT id, unnest({_ORDERED}) AS sitemap FROM x""")
def robots_sitemaps(spark, sf):
    return derived(spark, sf, ROBOTS_SQL, "supplier").select("id", F.explode(sites.robots_sitemaps(F.col("raw"))).alias("sitemap"))


@query(f"""
WITH r AS ({ROBOTS_SQL})
SELECT id, CASE id % 5 WHEN 1 THEN 'User-agent: ClaudeBot' || chr(10) || 'Allow: /' ELSE 'User-agent: ClaudeBot' END AS stanza FROM r""")
def robots_stanza(spark, sf):
    return derived(spark, sf, ROBOTS_SQL, "supplier").select("id", sites.stanza(F.col("raw"), F.lit("ClaudeBot")).alias("stanza"))


FILES_SQL = """
SELECT s_suppkey AS id, s_suppkey % 6 < 5 AS found, 'https://s.example' || CASE s_suppkey % 3 WHEN 0 THEN '/.well-known/mcp.json' WHEN 1 THEN '/.well-known/agent.json' ELSE '/.well-known/security.txt' END AS url,
  CASE s_suppkey % 6 WHEN 0 THEN '# ' || s_name || chr(10) || 'text' WHEN 1 THEN '<!doctype html><html># x</html>' WHEN 2 THEN 'see [a](https://a) and [b](https://b)' WHEN 3 THEN '{"Tools": [1], "name": "' || s_name || '"}' WHEN 4 THEN '{"name": "x"}' ELSE 'nothing' END AS body FROM supplier"""


@query(f"""
WITH f AS ({FILES_SQL})
SELECT id, CASE WHEN NOT found THEN 'llms.txt#absent' WHEN NOT regexp_matches(left(body, 2000), '<\\s*(html|!doctype|head|body|script)\\b', 'i') AND (regexp_matches(body, '(?m)^[ \\t]{{0,3}}#[ \\t]+\\S') OR len(regexp_extract_all(body, '\\[[^\\]]+\\]\\([^)]+\\)')) >= 2) THEN 'llms.txt#present' ELSE 'llms.txt#not-markdown' END AS selector FROM f""")
def llms_txt_classify(spark, sf):
    f = derived(spark, sf, FILES_SQL, "supplier")
    return f.select("id", sites.llms_txt(F.col("found"), F.col("body")).alias("selector"))


@query(f"""
WITH f AS ({FILES_SQL}), k AS (SELECT *, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' THEN list_transform(json_keys(CASE WHEN json_valid(body) THEN body END), lambda x: lower(x)) ELSE [] END AS keys, regexp_extract(url, '^https://[^/]*(.*)$', 1) AS path FROM f)
SELECT id, 'wellknown' || path || CASE WHEN ends_with(url, 'security.txt') THEN '' WHEN NOT regexp_matches(left(body, 500), '<\\s*(html|!doctype|head|body)\\b', 'i') AND list_has_any(keys, {list(sites.MANIFEST_KEYS)}) THEN '#manifest' ELSE '#not-a-manifest' END AS selector FROM k""")
def wellknown_classify(spark, sf):
    f = derived(spark, sf, FILES_SQL, "supplier")
    return f.select("id", sites.wellknown(F.col("url"), F.col("body")).alias("selector"))


SPECS_SQL = """
SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN '{"openapi": "3.0", "paths": {"/a": {"get": {}, "post": {}}, "/b": {"delete": {}}}}' WHEN 1 THEN '{"swagger": "2.0", "paths": {}}' WHEN 2 THEN 'openapi: 3.1' || chr(10) || 'paths:' || chr(10) || '  /x:' WHEN 3 THEN '<html>' || n_name ELSE '{"info": "' || n_name || '"}' END AS body FROM nation"""


@query(f"""
WITH s AS ({SPECS_SQL}), k AS (SELECT id, body, starts_with(body, '{{') AND json_valid(body) AS j FROM s), m AS (SELECT *, CASE WHEN j THEN body END AS b FROM k)
SELECT id, CASE WHEN j AND (json_exists(b, '$.openapi') OR json_exists(b, '$.swagger')) OR NOT starts_with(body, '{{') AND regexp_matches(body, '(?im)^\\s*(openapi|swagger)\\s*:\\s*["'']?[0-9]') AND regexp_matches(body, '(?m)^\\s*paths\\s*:') THEN 'openapi#spec' ELSE 'openapi#not-a-spec' END AS selector,
  CASE WHEN j AND json_exists(b, '$.paths') THEN len(json_keys(b, '$.paths')) ELSE 0 END::INTEGER AS n_paths, CASE WHEN j AND json_exists(b, '$.paths') THEN len(regexp_extract_all(json_extract(b, '$.paths')::VARCHAR, '"(get|post|put|patch|delete)":')) ELSE 0 END::INTEGER AS n_operations FROM m""")
def openapi_classify(spark, sf):
    return derived(spark, sf, SPECS_SQL, "nation").select("id", sites.openapi(F.col("body")).alias("o")).select("id", "o.selector", "o.n_paths", "o.n_operations")


MAPS_SQL = """
SELECT n_nationkey AS id, n_nationkey % 4 < 3 AS found, CASE WHEN n_nationkey % 2 = 0 THEN '<sitemapindex>' ELSE '<urlset>' END || '<url><loc> https://a.example/' || n_name || '</loc><lastmod>2026-01-01</lastmod></url><url><LOC>https://a.example/b</LOC></url>' AS body FROM nation"""


@query(f"""
WITH m AS ({MAPS_SQL}), u AS (SELECT *, regexp_extract_all(body, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1, 'i') AS urls FROM m)
SELECT id, CASE WHEN found THEN 'sitemap#present' ELSE 'sitemap#unreachable' END AS selector, contains(lower(body), '<sitemapindex') AS is_index, len(urls)::INTEGER AS n_urls, len(regexp_extract_all(body, '<lastmod>\\s*[^<\\s]+\\s*</lastmod>', 0, 'i'))::INTEGER AS n_lastmod, array_to_string(urls[1:20], ' ') AS first_urls FROM u""")
def sitemap_urls(spark, sf):
    s = sites.sitemap(F.col("found"), F.col("body"))
    return derived(spark, sf, MAPS_SQL, "nation").select("id", s.alias("s")).select("id", "s.selector", "s.is_index", "s.n_urls", "s.n_lastmod", F.array_join("s.first_urls", " ").alias("first_urls"))


HEADERS_SQL = """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Retry-After' ELSE 'Server' END AS h1, CAST(s_suppkey AS STRING) AS v1, CASE WHEN s_suppkey % 4 = 0 THEN 'X-RateLimit-Limit' ELSE 'Vary' END AS h2, s_name AS v2 FROM supplier"""
_RATES = ", ".join(f"CASE WHEN lower(h1) = '{h}' THEN '{h}: ' || v1 WHEN lower(h2) = '{h}' THEN '{h}: ' || v2 END" for h in P.RATE_LIMIT_HEADERS)


@query(f"WITH h AS ({HEADERS_SQL}) SELECT id, array_to_string(list_filter([{_RATES}], lambda x: x IS NOT NULL), '; ') AS observed FROM h")
def rate_limit_headers(spark, sf):
    from ..operators.pages import named_headers

    h = derived(spark, sf, HEADERS_SQL, "supplier").select("id", F.create_map("h1", "v1", "h2", "v2").alias("headers"))
    return h.select("id", F.array_join(named_headers(F.col("headers"), P.RATE_LIMIT_HEADERS), "; ").alias("observed"))


# --- structured data ---------------------------------------------------------------
ENTITY_SQL = """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Offer' WHEN 2 THEN 'LocalBusiness' WHEN 3 THEN 'Event' WHEN 4 THEN 'Question' ELSE 'Thing' END AS type,
  '{"@type": "' || CASE p_partkey % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Offer' WHEN 2 THEN 'LocalBusiness' WHEN 3 THEN 'Event' WHEN 4 THEN 'Question' ELSE 'Thing' END || '"'
  || CASE WHEN p_partkey % 4 > 0 THEN ', "name": "' || p_name || '"' ELSE '' END || CASE WHEN p_partkey % 5 > 1 THEN ', "sku": "S' || CAST(p_partkey AS STRING) || '"' ELSE '' END
  || CASE WHEN p_partkey % 7 > 2 THEN ', "price": "' || CAST(p_size AS STRING) || '"' ELSE ', "price": ""' END || CASE WHEN p_partkey % 3 > 0 THEN ', "priceCurrency": "AED"' ELSE '' END
  || CASE WHEN p_partkey % 8 = 0 THEN ', "availability": "InStock"' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE '}' END AS payload FROM part"""
_VALUE = "coalesce(json_extract_string(p, '$.' || x.prop), '')"
_REQUIRED = ", ".join(f"('{t}', '{p}')" for t, ps in structured.REQUIRED.items() for p in ps)


@query(f"""
WITH e AS ({ENTITY_SQL}), v AS (SELECT id, type, payload AS p FROM e WHERE json_valid(payload)), x(kind, prop) AS (VALUES {_REQUIRED})
SELECT id, type, x.prop AS missing FROM v JOIN x ON x.kind = v.type WHERE {_VALUE} IN ('', '0', 'false', 'null', '[]', '{{}}')""")
def jsonld_required_violations(spark, sf):
    return structured.required_violations(derived(spark, sf, ENTITY_SQL, "part")).select("id", "type", "missing")


def _keyed(keys) -> str:
    parts = ", ".join(f"CASE WHEN json_exists(p, '$.{k}') THEN json_extract_string(p, '$.\"@type\"') || '.{k} = ' || coalesce(json_extract_string(p, '$.{k}'), '') END" for k in keys)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '; ')"


@query(f"WITH e AS ({ENTITY_SQL}), v AS (SELECT id, payload AS p FROM e WHERE json_valid(payload)) SELECT id, {_keyed(P.PRICE_KEYS)} AS prices, {_keyed(P.AVAILABILITY_KEYS)} AS availability FROM v")
def jsonld_price_availability(spark, sf):
    e = derived(spark, sf, ENTITY_SQL, "part").where(F.try_parse_json("payload").isNotNull())
    return e.select("id", F.array_join(structured.prices(F.col("payload")), "; ").alias("prices"), F.array_join(structured.availability(F.col("payload")), "; ").alias("availability"))


@query(f"WITH e AS ({ENTITY_SQL}), v AS (SELECT id, payload AS p FROM e WHERE json_valid(payload)) SELECT id, {_keyed(P.ID_PROPERTIES)} AS identifiers FROM v")
def jsonld_identifiers(spark, sf):
    e = derived(spark, sf, ENTITY_SQL, "part").where(F.try_parse_json("payload").isNotNull())
    return e.select("id", F.array_join(structured.identifiers(F.col("payload")), "; ").alias("identifiers"))


@query(f"""
WITH e AS ({ENTITY_SQL}), v AS (SELECT id, type FROM e WHERE json_valid(payload)), n AS (SELECT id, unnest([('untyped', 0), (type, 1), ('Brand', 2)]) AS t FROM v)
SELECT id, t[1] AS type, t[2] AS depth_ord FROM n""")
def jsonld_types(spark, sf):
    e = derived(spark, sf, ENTITY_SQL, "part")
    nested = F.concat(F.lit('{"@graph": ['), "payload", F.lit(', {"@type": ["https://schema.org/Brand"]}]}'))
    return structured.walk(e.select("id", nested.alias("payload"))).select("id", F.explode("types").alias("type"), "depth_ord")


SHOWN_SQL = """
SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' AED 1,2' || CAST(p_size AS STRING) || '.50 In Stock' WHEN 1 THEN ' ' || CAST(p_size AS STRING) || ' USD or $' || CAST(p_size AS STRING) || ' sold out, only 3 left' WHEN 2 THEN ' pre-order ships within 2 days' ELSE ' no price' END AS t FROM part"""


@query(f"""
WITH s AS ({SHOWN_SQL}), f AS (SELECT id, regexp_extract_all(t, '{P.RENDERED_PRICE.removeprefix('(?i)')}', 0, 'i') AS a, list_transform(regexp_extract_all(t, '{P.RENDERED_AVAILABILITY.removeprefix('(?i)')}', 1, 'i'), lambda x: lower(x)) AS b FROM s)
SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '; ') AS prices, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), '; ') AS availability FROM f""")
def rendered_prices(spark, sf):
    from ..operators import pages

    s = derived(spark, sf, SHOWN_SQL, "part")
    return s.select("id", F.array_join(pages.rendered_prices(F.col("t")), "; ").alias("prices"), F.array_join(pages.rendered_availability(F.col("t")), "; ").alias("availability"))


# --- evidence and rubric --------------------------------------------------------------
_EV = f"""ev0 AS ({EVIDENCE_SQL}), ev1 AS (SELECT *, substr(sha256(source_url || '|' || kind || '|' || selector || '|' || raw), 1, 16) AS id FROM ev0),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, id ORDER BY ord) AS i FROM ev1) WHERE i = 1), inp AS ({INPUTS_SQL})"""


def _identified(spark, sf):
    return evidence.identified(captures.spread(evidence_rows(spark, sf)))


def _evidence(spark, sf):
    return evidence.keep_first(_identified(spark, sf))


def _inputs(spark, sf):
    return derived(spark, sf, INPUTS_SQL, "supplier")


def _n(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


_ST = "kind IN ('jsonld', 'microdata', 'rdfa')"
_TY = "regexp_extract(selector, '([^#]*)$', 1)"
_JS = "CASE WHEN json_valid(raw) THEN raw END"
_OBJ = f"json_valid(raw) AND json_type({_JS}) = 'OBJECT'"


def _lacks(p: str) -> str:
    return f"coalesce(json_extract_string({_JS}, '$.{p}'), '') IN ('', '0', 'false', 'null', '[]', '{{}}')"


_VIOLATES = " OR ".join(f"({_TY} = '{t}' AND {_lacks(p)})" for t, ps in structured.REQUIRED.items() for p in ps)
_COV = "CASE WHEN raw LIKE '%\\% label coverage%' ESCAPE '\\' THEN regexp_extract(raw, '\\(([0-9]+)% label', 1)::DOUBLE / 100 END"
_SIGNALS = {
    "robots": "kind = 'robots' AND selector = 'robots.txt'", "robots_bad": "kind = 'robots' AND selector = 'robots.txt#unparseable'", "stanza": "kind = 'robots' AND starts_with(selector, 'robots.txt#user-agent:')",
    "sitemap": "kind = 'sitemap' AND selector = 'sitemap#present'", "llms": "kind = 'llmstxt' AND selector = 'llms.txt#present'", "typed": f"{_ST} AND NOT contains(selector, '#untyped')",
    "org": f"{_ST} AND {_TY} IN ('Organization', 'LocalBusiness') AND {_OBJ} AND NOT ({_lacks('name')}) AND NOT ({_lacks('url')}) AND NOT ({_lacks('address')})",
    "covered": f"{_ST} AND {_TY} IN {tuple(structured.REQUIRED)}", "violating": f"{_ST} AND {_OBJ} AND ({_VIOLATES})",
    "spec": "kind = 'openapi' AND selector = 'openapi#spec'", "api": "kind = 'openapi' AND starts_with(selector, 'a[href')", "manifest": "kind = 'wellknown' AND contains(selector, '#manifest')",
    "pattern": "kind = 'identifier' AND starts_with(selector, 'url-pattern#') AND CASE WHEN regexp_matches(raw, ' on [0-9]+ distinct link') THEN regexp_extract(raw, ' on ([0-9]+) distinct link', 1)::INTEGER ELSE 0 END >= 2",
    "get_form": "kind = 'form' AND contains(selector, '#get#search')", "contact_good": f"kind = 'form' AND contains(selector, '#contact') AND NOT contains(raw, '0 named') AND {_COV} >= 0.5",
    "price": "kind = 'text' AND starts_with(selector, 'pricing#structured')", "shown": "kind = 'text' AND starts_with(selector, 'pricing#rendered')", "gated": "kind = 'header' AND selector = 'header#interstitial'",
    "open": "kind = 'header' AND selector = 'header#no-interstitial'", "landmark": "kind = 'dom' AND selector = 'semantics#landmarks'",
    "main": "kind = 'dom' AND selector = 'semantics#landmarks' AND (NOT contains(raw, '<main>=0') OR NOT contains(raw, 'role=main:0'))", "nav": "kind = 'dom' AND selector = 'semantics#landmarks' AND NOT contains(raw, '<nav>=0')",
    "single": "kind = 'dom' AND selector = 'semantics#headings' AND contains(raw, '1 <h1>')", "no_skip": "kind = 'dom' AND selector = 'semantics#headings' AND contains(raw, 'hierarchy skips: none')",
    "media": "kind = 'media'", "media_bad": "kind = 'media' AND (contains(raw, 'image-dominant') OR contains(raw, 'largely undescribed'))", "paged": "kind = 'pagination' AND selector IN ('pagination#crawlable-urls', 'pagination#rel')",
    "id_s": "kind = 'identifier' AND starts_with(selector, 'jsonld#')", "id_u": "kind = 'identifier' AND (starts_with(selector, 'url-pattern#') OR starts_with(selector, 'url-query#'))",
    "s_price": "kind = 'text' AND selector = 'pricing#structured-price'", "s_avail": "kind = 'text' AND selector = 'pricing#structured-availability'", "tos": "kind = 'text' AND selector = 'governance#tos-addresses-automation'",
    "silent": "kind = 'text' AND selector = 'governance#tos-silent-on-automation'", "rate": "kind = 'header' AND selector = 'header#rate-limit'", "auth": "kind = 'text' AND selector = 'governance#machine-auth-documented'",
    "injected": "kind = 'injection' AND selector <> 'injection#clean'", "clean": "kind = 'injection' AND selector = 'injection#clean'",
}
_AGG = f"""sig AS (SELECT inp.site, any_value(pages_ok) AS pages_ok, {', '.join(f'{_n(w)} AS {n}' for n, w in _SIGNALS.items())},
  count(DISTINCT source_url) FILTER (WHERE kind = 'link' AND selector = 'link[rel=canonical]') AS canon, count(DISTINCT {_TY}) FILTER (WHERE {_ST} AND {_TY} IN {structured.COVERAGE_TYPES}) AS entities,
  avg(TRY_CAST(regexp_extract(raw, 'ratio: ([0-9.]+)', 1) AS DECIMAL(9, 3)) * 1000) FILTER (WHERE kind = 'rendering' AND selector = 'rendering#delta') AS ratio, avg(round({_COV} * 100)::BIGINT) FILTER (WHERE kind = 'form') AS coverage
FROM inp LEFT JOIN ev ON ev.site = inp.site GROUP BY inp.site)"""
_CHECKS = (
    (1, "a1_robots_present", 2, "CASE WHEN robots > 0 AND robots_bad = 0 THEN 2 ELSE 0 END", "false"), (1, "a1_robots_agent_stanza", 3, "CASE WHEN stanza > 0 THEN 3 ELSE 0 END", "false"),
    (1, "a1_sitemap", 3, "CASE WHEN sitemap > 0 THEN 3 ELSE 0 END", "false"), (1, "a1_llms_txt", 4, "CASE WHEN llms > 0 THEN 4 ELSE 0 END", "false"),
    (1, "a1_canonical_coverage", 3, "CASE WHEN canon >= 0.8 * pages_ok THEN 3 ELSE 0 END", "pages_ok = 0"), (2, "a2_structured_present", 4, "CASE WHEN typed > 0 THEN 4 ELSE 0 END", "false"),
    (2, "a2_organization_node", 4, "CASE WHEN org > 0 THEN 4 ELSE 0 END", "false"), (2, "a2_entity_coverage", 8, "least(8, 2 * entities)", "false"),
    (2, "a2_required_properties", 4, "CASE WHEN violating = 0 THEN 4 ELSE 0 END", "covered = 0"), (3, "a3_openapi_spec", 6, "CASE WHEN spec > 0 THEN 6 ELSE 0 END", "false"),
    (3, "a3_documented_api", 3, "CASE WHEN api > 0 THEN 3 ELSE 0 END", "false"), (3, "a3_agent_manifest", 6, "CASE WHEN manifest > 0 THEN 6 ELSE 0 END", "false"),
    (3, "a3_stable_discovery", 5, "CASE WHEN pattern >= 2 OR get_form > 0 THEN 5 ELSE 0 END", "false"), (3, "a3_contact_capability", 3, "CASE WHEN contact_good > 0 THEN 3 ELSE 0 END", "false"),
    (3, "a3_pricing_without_login", 2, "CASE WHEN price + shown > 0 AND gated = 0 THEN 2 ELSE 0 END", "false"), (4, "a4_server_rendered", 5, "CASE WHEN ratio >= 500 THEN 5 ELSE 0 END", "ratio IS NULL"),
    (4, "a4_semantic_html", 4, "(main > 0)::INTEGER + (nav > 0)::INTEGER + (single > 0)::INTEGER + (no_skip > 0)::INTEGER", "landmark = 0"), (4, "a4_text_in_images", 3, "CASE WHEN 2 * media_bad < media THEN 3 ELSE 0 END", "media = 0"),
    (4, "a4_crawlable_pagination", 3, "CASE WHEN paged > 0 THEN 3 ELSE 0 END", "false"), (5, "a5_stable_identifiers", 5, "CASE WHEN id_s > 0 THEN 5 WHEN id_u > 0 THEN 3 ELSE 0 END", "false"),
    (5, "a5_structured_pricing", 4, "2 * ((s_price > 0)::INTEGER + (s_avail > 0)::INTEGER)", "s_price = 0 AND s_avail = 0 AND shown = 0"), (5, "a5_form_labelling", 3, "CASE WHEN coverage >= 90 THEN 3 ELSE 0 END", "coverage IS NULL"),
    (5, "a5_no_interstitials", 3, "CASE WHEN gated = 0 AND open > 0 THEN 3 ELSE 0 END", "gated = 0 AND open = 0"), (6, "a6_tos_automation", 3, "CASE WHEN tos > 0 THEN 3 ELSE 0 END", "tos = 0 AND silent = 0"),
    (6, "a6_rate_limit_headers", 2, "CASE WHEN rate > 0 THEN 2 ELSE 0 END", "false"), (6, "a6_machine_auth", 3, "CASE WHEN auth > 0 THEN 3 ELSE 0 END", "false"),
    (6, "a6_no_injection", 2, "CASE WHEN injected = 0 AND clean > 0 THEN 2 ELSE 0 END", "injected = 0 AND clean = 0"),
)
_RES = "res AS (" + " UNION ALL ".join(f"SELECT site, {a}::INTEGER AS axis, '{c}' AS check_id, CASE WHEN {s} THEN 0 ELSE {p} END::INTEGER AS points, {m}::INTEGER AS max_points, {s} AS suppressed FROM sig" for a, c, m, p, s in _CHECKS) + ")"
_WITH = f"WITH {_EV}, {_AGG}, {_RES}"


@query(f"{_WITH} SELECT site, axis, check_id, points, max_points, suppressed FROM res")
def rubric_check_results(spark, sf):
    return rubric.check_results(_identified(spark, sf), _inputs(spark, sf), references=False, repeated=True).select("site", "axis", "check_id", "points", "max_points", "suppressed")


def _axis(n: int, name: str):
    def run(spark, sf):
        return rubric.check_results(_identified(spark, sf), _inputs(spark, sf), references=False, repeated=True).where(F.col("axis") == n).select("site", "check_id", "points", "suppressed")

    run.__name__ = f"axis{n}_{name}"
    query(f"{_WITH} SELECT site, check_id, points, suppressed FROM res WHERE axis = {n}")(run)


for _i, _name in enumerate(("identity", "structured_data", "capability", "extractability", "transactional", "governance"), 1):
    _axis(_i, _name)


@query(f"""{_WITH} SELECT site, axis, sum(CASE WHEN suppressed THEN 0 ELSE points END)::BIGINT AS points, sum(CASE WHEN suppressed THEN 0 ELSE max_points END)::BIGINT AS max_possible, count(*) FILTER (WHERE suppressed) AS n_suppressed FROM res GROUP BY GROUPING SETS ((site, axis), (site))""")
def axis_rollup(spark, sf):
    return rubric.axis_rollup(rubric.check_results(_identified(spark, sf), _inputs(spark, sf), references=False, repeated=True))


_TOT = "tot AS (SELECT site, sum(points) AS t, sum(CASE WHEN suppressed THEN 0 ELSE max_points END) AS m FROM res GROUP BY site)"
_BAND = "CASE WHEN v <= 24 THEN 'Invisible' WHEN v <= 44 THEN 'Emerging' WHEN v <= 64 THEN 'Readable' WHEN v <= 84 THEN 'Agent-Ready' ELSE 'Agent-Native' END"


@query(f"""{_WITH}, {_TOT}, f AS (SELECT inp.*, t, m, CASE WHEN m > 0 THEN t * 100.0 / m ELSE 0 END::DOUBLE AS pct, pages_ok < 8 OR pages_robots_blocked > 0.30 * pages_crawled AS low FROM inp JOIN tot ON tot.site = inp.site), g AS (SELECT *, round_even(pct, 0)::INTEGER AS v FROM f)
SELECT site, t::BIGINT AS total, m::BIGINT AS max_possible, round_even(pct, 1) AS percentage, CASE WHEN NOT low THEN {_BAND} END AS band, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence FROM g""")
def site_score(spark, sf):
    inputs = _inputs(spark, sf)
    return rubric.site_scores(rubric.check_results(_identified(spark, sf), inputs, references=False, repeated=True), inputs).select("site", "total", "max_possible", "percentage", "band", "confidence")


@query(f"""WITH inp AS ({INPUTS_SQL}), c AS (SELECT *, pages_robots_blocked * 1.0::DOUBLE / pages_crawled AS share FROM inp), r AS (SELECT site, degraded, concat_ws('; and ', CASE WHEN pages_ok < 8 THEN 'only ' || pages_ok || ' page(s) were successfully crawled, below the 8-page floor' END, CASE WHEN share > 0.3 THEN round_even(share * 100, 0)::INTEGER || '% of pages were robots-blocked, above the 30% threshold' END) AS why FROM c)
SELECT site, CASE WHEN why <> '' THEN 'low' ELSE 'high' END AS level, CASE WHEN why <> '' THEN 'Grade band suppressed: ' || why || '.' WHEN degraded THEN 'Captured without a browser; rendering-dependent checks were suppressed and excluded from the total.' END AS reason FROM r""")
def band_confidence(spark, sf):
    c = rubric.confidence(F.col("pages_ok"), F.col("pages_robots_blocked"), F.col("pages_crawled"), F.col("degraded"))
    return _inputs(spark, sf).select("site", c.alias("c")).select("site", "c.level", "c.reason")


@query(f"""{_WITH} SELECT site, sum(CASE WHEN check_id = 'a1_llms_txt' THEN points ELSE 0 END)::BIGINT AS llms_drop, sum(CASE WHEN check_id = 'a1_robots_agent_stanza' THEN points ELSE 0 END)::BIGINT AS stanza_drop FROM res GROUP BY site""")
def score_counterfactual(spark, sf):
    """By how much totals fall when the llms.txt row or the AI stanzas are taken away."""
    without = {"b": F.col("selector") == "llms.txt#present", "c": F.col("selector").startswith("robots.txt#user-agent:")}
    t = rubric.totals_without(_evidence(spark, sf), _inputs(spark, sf), without)
    return t.select("site", (F.col("total") - F.col("b")).alias("llms_drop"), (F.col("total") - F.col("c")).alias("stanza_drop"))


@query(f"WITH {_EV} SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def evidence_kind_counts(spark, sf):
    return evidence.kind_counts(_evidence(spark, sf))


_ABSENT = " OR ".join(f"contains(selector, '{m}')" for m in P.ABSENCE_MARKERS)


@query(f"""WITH {_EV}, w AS (SELECT *, row_number() OVER s AS position, coalesce(sum(least(length(raw), 900)) OVER (PARTITION BY site ORDER BY length(raw) DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM ev WHERE kind IN {P.CAPABILITY_KINDS} AND NOT ({_ABSENT}) WINDOW s AS (PARTITION BY site ORDER BY length(raw) DESC, ord))
SELECT site, id, position::INTEGER AS position, spent::BIGINT AS spent FROM w WHERE position <= 60 AND spent < 40000""")
def induce_budget_window(spark, sf):
    return evidence.induced(_evidence(spark, sf)).select("site", "id", "position", F.col("spent").cast("long").alias("spent"))


# --- capabilities ------------------------------------------------------------------------
CAPS_SQL = """
SELECT o_orderkey AS cap_id, CASE o_orderkey % 5 WHEN 0 THEN 'search_products' WHEN 1 THEN 'book_room' WHEN 2 THEN 'get_order_status' ELSE 'list_items' END AS name, CASE o_orderkey % 7 WHEN 0 THEN 'Submit' ELSE 'search' END AS verb, o_orderkey % 13 = 0 AS state_changing,
  CASE o_orderkey % 4 WHEN 0 THEN '{"type": "string"}' WHEN 1 THEN '{"type": "string", "description": "d", "maxLength": 9}' WHEN 2 THEN '{"type": "integer"}' ELSE '{"type": "string", "description": "d"}' END AS spec FROM orders"""
CITED_SQL = "SELECT l_orderkey AS cap_id, l_partkey AS id FROM lineitem"
FACTS_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 7 THEN 'injection' ELSE 'text' END AS kind, CASE WHEN p_partkey % 100 = 7 THEN 'injection#clean' ELSE 'injection#agent_directive#visible_text' END AS selector, 'https://p.example/' || CAST(p_size AS STRING) AS source_url, CASE WHEN p_partkey % 97 = 3 THEN -p_partkey ELSE p_partkey END AS real_id FROM part"
_FACTS = FACTS_SQL.replace("p_partkey AS id,", "CASE WHEN p_partkey % 97 = 3 THEN -p_partkey ELSE p_partkey END AS id,").replace(", CASE WHEN p_partkey % 97 = 3 THEN -p_partkey ELSE p_partkey END AS real_id", "")


def _review_parts(spark, sf):
    caps = derived(spark, sf, CAPS_SQL, "orders").withColumn("parameters", F.create_map(F.lit("q"), F.col("spec")))
    return caps, derived(spark, sf, CITED_SQL, "lineitem"), derived(spark, sf, _FACTS, "part")


_STATE = f"(state_changing OR lower(verb) IN {P.STATE_CHANGING} OR list_has_any(string_split(lower(name), '_'), {list(P.STATE_CHANGING)}))"
_UNBOUND = "(json_extract_string(spec, '$.type') = 'string' AND (trim(coalesce(json_extract_string(spec, '$.description'), '')) = '' OR NOT (json_exists(spec, '$.maxLength') OR json_exists(spec, '$.enum') OR json_exists(spec, '$.pattern'))))"
_REVIEW = f"""caps AS ({CAPS_SQL}), cited AS ({CITED_SQL}), facts AS ({_FACTS}),
j AS (SELECT cap_id, count(*) FILTER (WHERE f.id IS NULL) AS missing, count(*) FILTER (WHERE f.kind = 'injection' AND f.selector <> 'injection#clean') AS tainted, count(*) AS n FROM cited LEFT JOIN facts f ON f.id = cited.id GROUP BY cap_id),
rev AS (SELECT caps.*, CASE WHEN coalesce(n, 0) = 0 OR missing > 0 THEN 'no_evidence' WHEN {_STATE} THEN 'state_changing' WHEN {_UNBOUND} THEN 'unbounded_param' WHEN tainted > 0 THEN 'injection_detected' END AS rule FROM caps LEFT JOIN j ON j.cap_id = caps.cap_id)"""


@query(f"WITH {_REVIEW} SELECT cap_id, rule FROM rev")
def critic_first_rule(spark, sf):
    return capabilities.review(*_review_parts(spark, sf)).select("cap_id", "rule")


@query(f"""WITH {_REVIEW}, v AS (SELECT *, coalesce(rule, CASE WHEN cap_id % 3 = 0 THEN NULL WHEN cap_id % 3 = 1 THEN CASE WHEN cap_id % 2 = 0 THEN 'unbounded_param' ELSE 'evidence_mismatch' END ELSE 'evidence_mismatch' END) AS final FROM rev)
SELECT coalesce(final, 'accepted') AS outcome, count(*) AS n FROM v GROUP BY 1""")
def critic_verdicts(spark, sf):
    """A third is accepted by the recorded answers, a third refused by a rule, a third has no answer."""
    reviewed = capabilities.review(*_review_parts(spark, sf))
    recorded = reviewed.select("cap_id", F.when(F.col("cap_id") % 3 == 0, "accept").when(F.col("cap_id") % 3 == 1, "reject").alias("verdict"), F.when(F.col("cap_id") % 2 == 0, "unbounded_param").otherwise("odd rule").alias("model_rule")).where("verdict is not null")
    out = capabilities.verdicts(reviewed, recorded)
    return out.groupBy(F.coalesce("rule", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_REVIEW} SELECT cap_id, name FROM rev WHERE rule IS NULL AND NOT {_STATE}")
def emit_filter(spark, sf):
    reviewed = capabilities.review(*_review_parts(spark, sf)).withColumn("accepted", F.col("rule").isNull())
    return capabilities.emitted(reviewed).select("cap_id", "name")


@query(f"SELECT cap_id, {_STATE} AS changes FROM ({CAPS_SQL})")
def capability_state_change(spark, sf):
    return derived(spark, sf, CAPS_SQL, "orders").select("cap_id", capabilities.implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing")).alias("changes"))


@query(f"SELECT cap_id, CASE WHEN {_UNBOUND} THEN 'q' ELSE '' END AS offenders FROM ({CAPS_SQL})")
def unbounded_params(spark, sf):
    caps = derived(spark, sf, CAPS_SQL, "orders")
    return caps.select("cap_id", F.array_join(capabilities.unbounded_parameters(F.create_map(F.lit("q"), F.col("spec"))), ",").alias("offenders"))


@query(f"WITH {_REVIEW}, f AS (SELECT cited.id, f.id IS NOT NULL AS hit FROM cited LEFT JOIN (SELECT DISTINCT id FROM facts) f ON f.id = cited.id) SELECT count(*) AS cited, count(*) FILTER (WHERE hit) AS resolved, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE hit) / count(*) END::DOUBLE AS validity FROM f")
def citation_validity(spark, sf):
    _, cited, facts = _review_parts(spark, sf)
    return capabilities.citation_validity(cited, facts)


@query(f"WITH cited AS ({CITED_SQL}), facts AS ({_FACTS}) SELECT cap_id, id FROM cited WHERE id NOT IN (SELECT id FROM facts)")
def dangling_citations(spark, sf):
    _, cited, facts = _review_parts(spark, sf)
    on = lambda d: d.withColumn("site", F.lit("all"))
    return evidence.dangling(on(cited), on(facts)).select("cap_id", "id")


@query(f"WITH {_REVIEW}, a AS (SELECT cap_id FROM caps WHERE cap_id % 2 = 0) SELECT count(DISTINCT a.cap_id) AS accepted, count(DISTINCT CASE WHEN f.id IS NULL THEN a.cap_id END) AS hallucinated FROM a JOIN cited ON cited.cap_id = a.cap_id LEFT JOIN facts f ON f.id = cited.id")
def hallucinated_rate(spark, sf):
    caps, cited, facts = _review_parts(spark, sf)
    used = cited.join(caps.where("cap_id % 2 = 0").select("cap_id"), "cap_id").join(facts.select("id", F.lit(1).alias("hit")).distinct(), "id", "left")
    return used.agg(F.count_distinct("cap_id").alias("accepted"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("cap_id"))).alias("hallucinated"))


@query(f"WITH {_REVIEW} SELECT DISTINCT cited.cap_id FROM cited SEMI JOIN (SELECT id FROM facts WHERE kind = 'injection' AND selector <> 'injection#clean') t ON t.id = cited.id")
def tainted_semi_join(spark, sf):
    _, cited, facts = _review_parts(spark, sf)
    return cited.join(facts.where("kind = 'injection' and selector <> 'injection#clean'"), "id", "left_semi").select("cap_id").distinct()


@query(f"""WITH {_REVIEW}, u AS (SELECT f.source_url, cited.id, caps.name FROM cited JOIN caps ON caps.cap_id = cited.cap_id AND caps.cap_id % 4 = 0 JOIN facts f ON f.id = cited.id),
e AS (SELECT source_url AS source, id::VARCHAR AS target, 'page-evidence' AS edge FROM u UNION SELECT id::VARCHAR, name, 'evidence-capability' FROM u UNION SELECT name, 'tool:' || name, 'capability-tool' FROM u)
SELECT edge, count(*) AS n FROM e GROUP BY edge""")
def graph_edges(spark, sf):
    caps, cited, facts = _review_parts(spark, sf)
    text = lambda d: d.withColumn("id", F.col("id").cast("string"))
    return capabilities.graph_edges(caps.withColumn("accepted", F.col("cap_id") % 4 == 0), text(cited), text(facts)).groupBy("edge").agg(F.count("*").alias("n"))


CLAIM_SQL = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'AED' || CAST(p_size AS STRING) || '.50 brass' ELSE 'n/a' END AS claim, p_name || ' ' || p_type AS source FROM part"


@query(f"""WITH c AS ({CLAIM_SQL}), t AS (SELECT id, trim(claim) AS claim, list_filter(regexp_extract_all(regexp_replace(lower(claim), '[^a-z0-9\\s]', '', 'g'), '[a-z]+|[0-9]+'), lambda x: length(x) >= 3) AS k, regexp_replace(lower(source), '[^a-z0-9\\s]', '', 'g') AS hay FROM c),
p AS (SELECT *, list_filter(k, lambda x: length(x) = list_max(list_transform(k, lambda y: length(y))))[1] AS probe FROM t)
SELECT id, CASE WHEN claim IN ('', 'n/a') OR probe IS NULL OR contains(hay, probe) THEN '' ELSE 'name=' || claim END AS unverifiable FROM p""")
def claim_verification(spark, sf):
    c = derived(spark, sf, CLAIM_SQL, "part")
    return c.select("id", F.array_join(T.unverifiable_claims(F.create_map(F.lit("name"), F.col("claim")), F.col("source")), ",").alias("unverifiable"))


ANSWER_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Sure! ```json' || chr(10) || '{\"a\": ' || CAST(o_orderkey AS STRING) || ',}```' WHEN 1 THEN 'text {\"a\": [1, 2,], \"b\": \"' || o_orderpriority || '\"} more' WHEN 2 THEN 'no object' ELSE '{broken' END AS answer FROM orders"


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN '{{\"a\": ' || id || '}}' WHEN 1 THEN '{{\"a\": [1, 2], \"b\": \"' || split_part(split_part(answer, '\"b\": \"', 2), '\"', 1) || '\"}}' END AS json FROM ({ANSWER_SQL})")
def json_repair(spark, sf):
    return derived(spark, sf, ANSWER_SQL, "orders").select("id", T.repaired_json(F.col("answer")).alias("json"))


# --- metrics -------------------------------------------------------------------------------
GOLD_SQL = """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 'timeout' END AS error, CAST(c_custkey % 101 AS INT) AS total,
  CASE c_custkey % 6 WHEN 0 THEN 'Invisible' WHEN 1 THEN 'Emerging' WHEN 2 THEN 'Readable' WHEN 3 THEN 'Agent-Ready' WHEN 4 THEN 'Agent-Native' END AS band, CASE c_nationkey % 3 WHEN 0 THEN 'Readable' WHEN 1 THEN 'Emerging' ELSE 'Agent-Ready' END AS expected_band,
  'search_' || c_mktsegment || '|Get  Items|list_' || CAST(c_custkey % 4 AS STRING) AS got, 'search ' || lower(c_mktsegment) || '|list 2' AS want, c_custkey % 8 = 0 AS unlabelled FROM customer"""
_NAMES = "list_distinct(list_transform(string_split({}, '|'), lambda x: trim(regexp_replace(replace(lower(x), '_', ' '), '\\s+', ' ', 'g'))))"
_ORD = "CASE {} WHEN 'Invisible' THEN 0 WHEN 'Emerging' THEN 1 WHEN 'Readable' THEN 2 WHEN 'Agent-Ready' THEN 3 WHEN 'Agent-Native' THEN 4 END"
_GOLD = f"""g AS ({GOLD_SQL}), s AS (SELECT name, {_NAMES.format('got')} AS got, {_NAMES.format('want')} AS want, abs({_ORD.format('band')} - {_ORD.format('expected_band')}) AS d FROM g WHERE error IS NULL AND NOT unlabelled),
ps AS (SELECT name, len(list_intersect(got, want)) / len(got) AS precision, len(list_intersect(got, want)) / len(want) AS recall, d FROM s)"""


def _golden(spark, sf):
    g = derived(spark, sf, GOLD_SQL, "customer")
    results = g.select("name", "error", "total", "band", F.split("got", r"\|").alias("predicted_capabilities"))
    labels = g.select("name", "expected_band", F.when(F.col("unlabelled"), F.array().cast("array<string>")).otherwise(F.split("want", r"\|")).alias("capabilities"))
    return metrics.golden(results, labels)


@query(f"WITH {_GOLD} SELECT name, precision, recall, d::INTEGER AS band_distance FROM ps")
def eval_precision_recall(spark, sf):
    return _golden(spark, sf)


@query(f"WITH {_GOLD} SELECT count(*) AS sites_compared, count(d) AS band_scored, round_even(avg(precision), 3) AS capability_precision, round_even(avg(recall), 3) AS capability_recall, round_even(avg((d = 0)::DOUBLE), 3) AS band_accuracy_exact, round_even(avg((d <= 1)::DOUBLE), 3) AS band_accuracy_within_1 FROM ps")
def eval_band_accuracy(spark, sf):
    return metrics.golden_summary(_golden(spark, sf))


@query("""WITH v AS (SELECT event_type, list_sort(list(round(value, 6))) AS s FROM events GROUP BY event_type)
SELECT event_type, s[round_even(0.95 * (len(s) - 1), 0)::INTEGER + 1] AS p95, s[round_even(0.5 * (len(s) - 1), 0)::INTEGER + 1] AS p50 FROM v""")
def eval_percentile_nearest(spark, sf):
    """Nearest-rank percentiles by event type, from counts of values: no group is gathered in one row."""
    from pyspark.sql import Window

    v = table(spark, sf, "events").groupBy("event_type", F.round("value", 6).alias("v")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("event_type").orderBy("v"))
    n = F.sum("k").over(Window.partitionBy("event_type"))
    at = lambda p: T.half_even(F.lit(p) / 100.0 * (F.col("n") - 1)).cast("long") + 1
    ranked = v.withColumns({"upto": upto, "n": n})
    pick = lambda p: F.min(F.when(F.col("upto") >= at(p), F.col("v")))
    return ranked.groupBy("event_type").agg(pick(95).alias("p95"), pick(50).alias("p50"))


METRIC_SQL = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 101) / 100.0 END AS value, CAST(c_custkey % 23 AS INT) AS samples, CASE c_custkey % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'tuning' ELSE 'operating' END AS class,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 0.5 END AS target, CASE c_custkey % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<=' WHEN 2 THEN '==' ELSE 'info' END AS comparison FROM customer"""


@query(f"""SELECT id, CASE WHEN value IS NULL THEN 'BLOCKED' WHEN class = 'tuning' AND samples < 10 THEN 'THIN' WHEN target IS NULL OR comparison = 'info' THEN 'PASS'
  WHEN comparison = '>=' AND value >= target OR comparison = '<=' AND value <= target OR comparison = '==' AND abs(value - target) < 1e-9 THEN 'PASS' WHEN class = 'gate' THEN 'FAIL' ELSE 'BELOW' END AS status FROM ({METRIC_SQL})""")
def eval_metric_status(spark, sf):
    m = derived(spark, sf, METRIC_SQL, "customer")
    return m.select("id", metrics.metric_status(F.col("value"), F.col("samples"), F.col("class"), F.col("target"), F.col("comparison")).alias("status"))


@query("SELECT user_id, (max(event_id % 17) - min(event_id % 17))::DOUBLE AS delta FROM events GROUP BY user_id")
def eval_stability(spark, sf):
    totals = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 17).alias("t"))  # 17 values at most
    return totals.select("user_id", metrics.stability(F.col("t")).alias("delta"))


# --- queues, ranks, streams --------------------------------------------------------------
@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS g, round_even(abs(c_acctbal) % 100 * 100.0 / 97, 1) AS percentage FROM customer)
SELECT id, g, percentage, rank() OVER (ORDER BY percentage DESC)::INTEGER AS rank, rank() OVER (PARTITION BY g ORDER BY percentage DESC)::INTEGER AS group_rank FROM s""")
def leaderboard_rank(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), (F.abs("c_acctbal") % 100).alias("total"), F.lit(97).alias("max_possible"))
    return queueing.leaderboard(s, "g").select("id", "g", "percentage", "rank", "group_rank")


@query("SELECT o_orderpriority AS provider, count(*) AS calls, sum(o_custkey)::BIGINT AS tokens, sum(0.0)::DOUBLE AS cost FROM orders GROUP BY 1")
def provider_usage(spark, sf):
    calls = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_custkey").alias("tokens"), F.lit(0.0).alias("cost"))
    return queueing.provider_usage(calls)


@query("""WITH s AS (SELECT CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 10 = 4 THEN 'dead' WHEN s_suppkey % 10 = 3 THEN 'blocked' WHEN s_suppkey % 4 = 0 THEN 'redirected' ELSE 'ok' END AS status FROM supplier) SELECT status, count(*) AS n FROM s GROUP BY status""")
def seed_status_tally(spark, sf):
    k = F.col("s_suppkey")
    status = F.when(k % 10 == 3, 503).when(k % 10 == 4, 410).otherwise(200)
    final = F.when(k % 4 == 0, "https://other.example/").otherwise("https://www.a.example/x")
    out = policy.seed_status(status, F.lit("https://a.example"), final, k % 9 == 0)
    return table(spark, sf, "supplier").groupBy(out.alias("status")).agg(F.count("*").alias("n"))


REQUEST_SQL = "SELECT CAST(user_id AS STRING) AS domain, event_id AS ord, CAST(event_id % 1000 AS DOUBLE) AS t FROM events"


@query(f"""WITH q AS ({REQUEST_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS n FROM q)
SELECT domain, ord, n * 2.0::DOUBLE + max(t - n * 2.0::DOUBLE) OVER (PARTITION BY domain ORDER BY ord ROWS UNBOUNDED PRECEDING) AS slot FROM n""")
def rate_limit_slots(spark, sf):
    return queueing.rate_slots(derived(spark, sf, REQUEST_SQL, "events")).select("domain", "ord", "slot")


@query("""WITH p AS (SELECT event_id AS job_id, user_id AS worker FROM events WHERE event_type = 'click'), h AS (SELECT user_id AS worker, max(ts) AS beat FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT job_id, worker FROM p WHERE worker NOT IN (SELECT worker FROM h, m WHERE epoch_us(now) - epoch_us(beat) <= 36000000000)""")
def queue_reclaim(spark, sf):
    e = table(spark, sf, "events")
    p = e.where("event_type = 'click'").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("worker"))
    beats = e.groupBy(F.col("user_id").alias("worker")).agg((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6).alias("beat"))
    now = e.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).first()[0]
    return queueing.reclaimed(p, beats, F.lit(now), ttl=36_000)


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS position FROM events")
def event_replay_order(spark, sf):
    return streams.replay(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "position")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, sf):
    """A stream over the event files, run to its end into a staged log, then counted in batch."""
    import uuid

    from .stages import shared_dir

    at = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    run = source.select("event_id", "event_type").writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/log")
    run.awaitTermination()
    return streams.counts(spark.read.parquet(f"{at}/log"))


@query(f"""
WITH p AS (SELECT 'https://s.example' || CASE s_suppkey % 5 WHEN 0 THEN '/llms.txt' WHEN 1 THEN '/sitemap.xml' WHEN 2 THEN '/openapi.json' WHEN 3 THEN '/.well-known/mcp.json' ELSE '/x' END AS url, s_suppkey FROM supplier)
SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'llms' WHEN 1 THEN 'sitemap' WHEN 2 THEN 'openapi' WHEN 3 THEN 'wellknown' ELSE 'other' END AS role FROM p""")
def probe_roles(spark, sf):
    k = F.col("s_suppkey") % 5
    path = F.when(k == 0, "/llms.txt").when(k == 1, "/sitemap.xml").when(k == 2, "/openapi.json").when(k == 3, "/.well-known/mcp.json").otherwise("/x")
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://s.example"), path).alias("url"))
    return policy.probe_roles(r).select("id", "role")
