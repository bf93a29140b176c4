"""Queries on generated artifacts, lookups and gates, with their DuckDB counterparts."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import artifacts, metrics, pages, policy
from .derived_queries import _EV, _evidence
from .fixtures import derived, table
from .page_queries import HOST, PATH

Q, O = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


CAP_SQL = """
SELECT CAST(o_custkey AS STRING) AS site, o_orderkey AS cap_ord, CASE o_orderkey % 3 WHEN 0 THEN 'search_items' WHEN 1 THEN 'book_room' ELSE 'list_news' END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'book' ELSE 'list' END AS verb, o_orderpriority AS noun, 'About ' || o_orderpriority AS description, o_orderkey % 4 = 0 AS accepted, false AS state_changing FROM orders"""


@query(f"""WITH c AS ({CAP_SQL}), a AS (SELECT site, list(name ORDER BY cap_ord) AS names FROM c WHERE accepted GROUP BY site) SELECT site, len(names)::INTEGER AS n_skills, names[1] AS first_skill FROM a""")
def agent_card_skills(spark, sf):
    cards = artifacts.agent_cards(derived(spark, sf, CAP_SQL, "orders"))
    skills = F.from_json(F.get_json_object("card", "$.skills"), "array<struct<id:string>>")
    return cards.select("site", F.size(skills).alias("n_skills"), F.get(skills, 0)["id"].alias("first_skill"))


@query(f"""
WITH c AS ({CAP_SQL}), s AS (SELECT CAST(c_custkey AS VARCHAR) AS site, c_name AS name FROM customer),
a AS (SELECT site, string_agg('- **' || verb || ' ' || noun || '**: ' || description, chr(10) ORDER BY cap_ord) AS t FROM c WHERE accepted GROUP BY site),
h AS (SELECT site, string_agg('- ' || verb || ' ' || noun, chr(10) ORDER BY cap_ord) AS t FROM c WHERE verb = 'book' GROUP BY site)
SELECT s.site, sha256(concat_ws(chr(10), '# ' || name || chr(10) || chr(10) || '> Public content on ' || s.site || '. This file is a proposal from the site''s own markup.' || chr(10),
  CASE WHEN a.t IS NOT NULL THEN '## What an agent can do here' || chr(10) || chr(10) || a.t || chr(10) END, CASE WHEN h.t IS NOT NULL THEN '## Not exposed' || chr(10) || chr(10) || h.t || chr(10) END)) AS digest
FROM s LEFT JOIN a ON a.site = s.site LEFT JOIN h ON h.site = s.site""")
def llms_txt_proposal(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("site"), F.col("c_name").alias("name"))
    no_pages = spark.createDataFrame([], "site string, page_ord int, final_url string, ok boolean, robots_blocked boolean")
    no_specs = spark.createDataFrame([], "site string, ord long, selector string, source_url string")
    out = artifacts.llms_txt_proposals(sites, derived(spark, sf, CAP_SQL, "orders"), no_pages, no_specs)
    return out.select("site", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_EV}, h AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord)::INTEGER AS position FROM ev WHERE kind NOT IN ('rendering', 'media', 'injection', 'header') AND contains(lower(concat_ws(' ', kind, selector, raw)), 'product'))
SELECT site, position, id, left(raw, 900) AS content FROM h WHERE position <= 8""")
def demo_tool_lookup(spark, sf):
    return artifacts.tool_lookup(_evidence(spark, sf), " Product ").select("site", "position", "id", "content")


@query("SELECT CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 <> 0 THEN 'interface_only' WHEN c_custkey % 3 = 0 THEN 'both' WHEN c_custkey % 2 = 0 THEN 'raw_only' ELSE 'neither' END AS outcome, count(*) AS n FROM customer GROUP BY 1")
def demo_outcome(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").groupBy(artifacts.outcome_note(k % 2 == 0, k % 3 == 0).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 11 = 0 THEN 'refuse' WHEN c_custkey % 7 = 0 THEN 'score' WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'pause' ELSE 'generate' END AS route, count(*) AS n FROM customer GROUP BY 1")
def gate_routes(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").groupBy(policy.gate(k % 11 != 0, k % 3 == 0, k % 5 == 0, k % 7).alias("route")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, list_distinct(list('p' || (event_id % 9))) AS f FROM events GROUP BY user_id) SELECT user_id, len(list_intersect(['p1', 'p2', 'p7'], f)) / 3 AS recall FROM s""")
def injection_recall(spark, sf):
    found = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string"))).alias("f"))  # nine values at most
    return found.select("user_id", metrics.injection_recall(F.array(*map(F.lit, ("p1", "p2", "p7", "p7"))), F.col("f")).alias("recall"))


_HINT = "(^|[/.\\-_])(api|apis|developer|developers|dev-portal|swagger|openapi|graphql|api-reference|api-docs|for-developers)([/.\\-_?#]|$)"


@query(f"""
WITH l AS (SELECT {HOST} AS site, page_id AS ord, 'https://x.example' || CASE page_id % 4 WHEN 0 THEN '/docs/api' WHEN 1 THEN '/api-docs' ELSE {PATH} END AS url FROM pages),
k AS (SELECT site, url, min(ord) AS ord FROM l WHERE regexp_matches({PATH}, '{_HINT}', 'i') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord)::INTEGER AS position FROM k)
SELECT site, url, position, 'a[href=' || left(url, 80) || ']' AS selector FROM r WHERE position <= 15""")
def api_link_detect(spark, sf):
    k = F.col("page_id") % 4
    url = F.concat(F.lit("https://x.example"), F.when(k == 0, "/docs/api").when(k == 1, "/api-docs").otherwise(T.url_path(F.col("url"))))
    links = table(spark, sf, "pages").select(T.normalised_domain(F.col("url")).alias("site"), F.lit("p").alias("page_url"), F.col("page_id").alias("ord"), url.alias("href"), url.alias("url"), F.lit("").alias("label"))
    return artifacts.api_links(links).select("site", "url", "position", "selector")


LOOK_SQL = """
SELECT CAST(s_suppkey AS STRING) AS site, 1 AS page_ord, '<script type="application/ld+json">{"@type": "Product", "b": {"@type": "Brand' || CAST(s_suppkey % 3 AS STRING) || '"}}</script>' AS html,
  CASE s_suppkey % 3 WHEN 0 THEN '# Hi' WHEN 1 THEN '<html># no' END AS llms, CASE s_suppkey % 4 WHEN 0 THEN '{"openapi": "3"}' WHEN 1 THEN 'swagger: 2' ELSE '{}' END AS spec, '' AS manifest, CASE WHEN s_suppkey % 5 = 0 THEN 'User-agent: GPTBot' END AS robots FROM supplier"""


@query(f"""WITH l AS ({LOOK_SQL}) SELECT site, 'Product,Brand' || (site::INTEGER % 3) AS types, coalesce(llms LIKE '# %', false) AS has_llms_txt, site::INTEGER % 4 < 2 AS has_openapi_spec, robots IS NOT NULL AS ai_stanza FROM l""")
def observation_probe(spark, sf):
    look = derived(spark, sf, LOOK_SQL, "supplier")
    out = artifacts.observed(look.select("site", "page_ord", "html"), look.select("site", "llms", "spec", "manifest", "robots"))
    return out.select("site", F.array_join("jsonld_types", ",").alias("types"), "has_llms_txt", "has_openapi_spec", "ai_stanza")


@query(f"SELECT page_id, CASE WHEN {PATH} IN ('', '/') THEN '' ELSE regexp_extract({PATH}, '([^/]*)/*$', 1) END AS slug FROM pages")
def page_slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(T.url_path(F.col("url")), r"([^/]*)/*$", 1).alias("slug"))


@query("""WITH d AS (SELECT conv_id, turn, role, text FROM conversations) SELECT role, count(*) AS n, sum(CASE WHEN regexp_matches(text, '\\b(ignore|disregard|forget|override)\\b', 'i') THEN 1 ELSE 0 END)::BIGINT AS overrides FROM d GROUP BY role""")
def conversation_roles(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.col("text").rlike(r"(?i)\b(ignore|disregard|forget|override)\b").cast("long")).alias("overrides"))


@query("""
WITH e AS (SELECT user_id::VARCHAR AS domain, ((event_id * 37) % 100000)::DOUBLE AS t, greatest(user_id % 5, 2)::DOUBLE AS step FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY domain ORDER BY t) > 3600 THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY domain ORDER BY t ROWS UNBOUNDED PRECEDING) AS part FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY domain, part ORDER BY t) - 1 AS n FROM s),
x AS (SELECT domain, t, n * step + max(t - n * step) OVER (PARTITION BY domain, part ORDER BY t ROWS UNBOUNDED PRECEDING) AS slot FROM n)
SELECT domain, t, slot, slot - t AS wait FROM x""")
def stream_rate_limiter(spark, sf):
    """Slots of the event table as a stream, with delays by domain; domains are forgotten after an hour without requests."""
    import uuid

    from ..streaming.events import rate_slots
    from .stages import shared_dir

    at = f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    e = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    slots = rate_slots(e.select(F.col("user_id").cast("string").alias("domain"), (F.col("event_id") * 37 % 100_000).cast("double").alias("t"), (F.col("user_id") % 5).cast("double").alias("delay")), delay="delay")
    slots.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/log")


@query(f"WITH {_EV} SELECT site, id, kind, left(raw, 2000) AS content FROM ev WHERE kind NOT IN ('rendering', 'media', 'injection', 'header')")
def evidence_snapshot(spark, sf):
    from ..operators.evidence import snapshot

    return snapshot(_evidence(spark, sf)).select("site", "id", "kind", "content")


@query(f"""
WITH p AS (SELECT {HOST} AS site, url AS page_url, regexp_extract_all(coalesce(html, ''), '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS a FROM pages),
x AS (SELECT site, page_url, unnest(range(len(a))) AS ord, trim(unnest(a), chr(9) || chr(10) || chr(12) || chr(13) || ' ') AS href FROM p),
k AS (SELECT *, regexp_extract(page_url, '^([^/]*//[^/?#]*)', 1) AS origin FROM x WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|mailto:|tel:|javascript:)'))
SELECT site, page_url, ord::INTEGER AS ord, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(page_url, '^([^/]*)//', 1) || href
  WHEN starts_with(href, '/') THEN origin || href WHEN starts_with(href, '?') THEN regexp_extract(page_url, '^([^?#]*)', 1) || href ELSE origin || '/' || href END AS url FROM k""")
def page_links(spark, sf):
    from ..sources import captures

    return pages.links(captures.from_pages(table(spark, sf, "pages"))).select("site", "page_url", "ord", "url")
