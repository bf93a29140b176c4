"""Detectors of site-level files: robots.txt, sitemaps, llms.txt, well-known manifests, API specs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import row

#: Files of a site as they were fetched. role: robots, sitemap, llms, wellknown or openapi; ord: their order.
RESOURCES = "site string, ord long, role string, url string, status int, text string, error string"
#: Site detectors in order; their rows come before those of pages.
DETECTORS = ("robots", "sitemap", "llms", "wellknown", "openapi")

# fixed values: tokens of AI user agents, keys of agent manifests
AI_AGENTS = (
    "gptbot", "chatgpt-user", "oai-searchbot", "claudebot", "claude-web", "claude-searchbot", "anthropic-ai",
    "google-extended", "googleother", "perplexitybot", "perplexity-user", "ccbot", "bytespider",
    "applebot-extended", "meta-externalagent", "meta-externalfetcher", "facebookbot", "cohere-ai",
    "cohere-training-data-crawler", "diffbot", "omgilibot", "omgili", "imagesiftbot", "youbot", "timpibot",
    "amazonbot", "ai2bot", "petalbot", "mistralai-user", "duckassistbot",
)
MANIFEST_KEYS = ("mcp", "tools", "skills", "capabilities", "agent", "protocolversion", "protocol_version", "api_endpoint", "schema_version")

AGENT_LINE = r"(?im)^[ \t]*user-agent[ \t]*:[ \t]*([^#\r\n]*[^#\s])"
SITEMAP_LINE = r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"
DELAY_LINE = r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9.]+)"
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
SHELL = r"(?i)<\s*(html|!doctype|head|body|script)\b"
HTML_ONLY = r"(?i)<\s*(html|!doctype|head|body)\b"


def robots_agents(raw: Column) -> Column:
    """User agents named in robots.txt, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(AGENT_LINE), 1), T.stripped))


def ai_agents(raw: Column) -> Column:
    return F.filter(robots_agents(raw), lambda a: F.exists(F.array(*map(F.lit, AI_AGENTS)), lambda t: F.contains(F.lower(a), t)))


def robots_sitemaps(raw: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(SITEMAP_LINE), 1))


def stanza(raw: Column, agent: Column) -> Column:
    """The lines of a named agent's stanza, up to the next user-agent line."""
    lines = F.split(raw, r"\r?\n")
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("done"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(a: Column, line: Column) -> Column:
        is_agent = line.rlike(r"(?i)^\s*user-agent\s*:")
        named = is_agent & (F.lower(T.stripped(F.regexp_extract(line, r"(?i)^\s*user-agent\s*:\s*([^#]*)", 1))) == F.lower(agent))
        opens = named & ~a["done"] & ~a["open"]
        closes = a["open"] & is_agent
        keep = a["open"] & ~is_agent
        return F.struct(((a["open"] & ~is_agent) | opens).alias("open"), (a["done"] | closes).alias("done"), F.when(keep, F.concat(a["kept"], F.array(line))).otherwise(a["kept"]).alias("kept"))

    body = F.aggregate(lines, start, step)["kept"]
    return T.stripped(F.concat(F.lit("User-agent: "), agent, F.lit("\n"), F.array_join(body, "\n")))


def sitemap(found: Column, text: Column) -> Column:
    """selector, whether an index, urls, lastmod count, first 20 urls."""
    urls = F.regexp_extract_all(text, F.lit(LOC), 1)
    return F.struct(
        F.when(found, "sitemap#present").otherwise("sitemap#unreachable").alias("selector"), F.contains(F.lower(text), F.lit("<sitemapindex")).alias("is_index"),
        F.size(urls).alias("n_urls"), F.regexp_count(text, F.lit(r"(?i)<lastmod>\s*[^<\s]+\s*</lastmod>")).alias("n_lastmod"), F.slice(urls, 1, 20).alias("first_urls"),
    )


def is_markdown(text: Column) -> Column:
    shell = F.left(text, F.lit(2000)).rlike(SHELL)
    return ~shell & (text.rlike(r"(?m)^[ \t]{0,3}#[ \t]+\S") | (F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)")) >= 2))


def llms_txt(found: Column, text: Column) -> Column:
    return F.when(~F.coalesce(found, F.lit(False)), "llms.txt#absent").when(is_markdown(text), "llms.txt#present").otherwise("llms.txt#not-markdown")


def object_keys(text: Column) -> Column:
    """Keys of a JSON object; null for anything else."""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(is_object, F.json_object_keys(text))


def wellknown(url: Column, text: Column) -> Column:
    path = T.url_path(url)
    keys = F.transform(object_keys(text), F.lower)
    manifest = ~F.left(text, F.lit(500)).rlike(HTML_ONLY) & F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, MANIFEST_KEYS))), F.lit(False))
    base = F.concat(F.lit("wellknown"), path)
    return F.when(url.endswith("security.txt") | url.endswith("ai.txt"), base).when(manifest, F.concat(base, F.lit("#manifest"))).otherwise(F.concat(base, F.lit("#not-a-manifest")))


def openapi(text: Column) -> Column:
    """selector, paths and operations of an API description in JSON or YAML."""
    s = T.stripped(text)
    keys = object_keys(s)
    is_json = s.startswith("{") & F.coalesce(F.array_contains(keys, "openapi") | F.array_contains(keys, "swagger"), F.lit(False))
    is_yaml = ~s.startswith("{") & s.rlike(r"(?im)^\s*(openapi|swagger)\s*:\s*[\"']?[0-9]") & s.rlike(r"(?m)^\s*paths\s*:")
    paths = F.when(is_json, F.json_object_keys(F.get_json_object(s, "$.paths")))
    methods = F.when(is_json, F.regexp_count(F.get_json_object(s, "$.paths"), F.lit(r'(?i)"(get|post|put|patch|delete)":')))
    return F.struct(F.when(is_json | is_yaml, "openapi#spec").otherwise("openapi#not-a-spec").alias("selector"), F.coalesce(F.size(paths), F.lit(0)).alias("n_paths"), F.coalesce(methods, F.lit(0)).alias("n_operations"))


def robots_rows(text: Column) -> Column:
    """Rows of a robots.txt that was found: the file, stanzas of AI agents, sitemaps and the crawl delay of all agents."""
    delay = F.regexp_extract(stanza(text, F.lit("*")), r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+)[ \t]*(?:#.*)?$", 1)
    file = F.when(text == "", "(empty robots.txt)").otherwise(F.left(text, F.lit(2000)))
    return F.concat(
        F.array(row("robots", "robots.txt", file)),
        F.transform(ai_agents(text), lambda a: row("robots", F.concat(F.lit("robots.txt#user-agent:"), a), stanza(text, a))),
        F.transform(robots_sitemaps(text), lambda u: row("robots", "robots.txt#sitemap", F.concat(F.lit("Sitemap: "), u))),
        F.when(delay != "", F.array(row("robots", "robots.txt#crawl-delay", F.concat(F.lit("Crawl-delay: "), delay, F.lit(".0"))))).otherwise(F.array().cast("array<struct<kind:string,selector:string,raw:string,phase:string>>")),
    )


def _sitemap_row(found: Column, text: Column, status: Column, error: Column) -> Column:
    s = sitemap(found, text)
    dated = F.when(s["n_lastmod"] > 0, F.concat(F.lit(", "), s["n_lastmod"].cast("string"), F.lit(" with <lastmod>"))).otherwise("")
    listed = F.concat(F.when(s["is_index"], "sitemap index").otherwise("sitemap"), F.lit(" reachable with "), s["n_urls"].cast("string"), F.lit(" <loc> entries"), dated, F.lit(".\n"), F.array_join(s["first_urls"], "\n"))
    failed = F.concat(F.lit("Sitemap not retrievable: HTTP "), status.cast("string"), F.coalesce(F.concat(F.lit(" ("), error, F.lit(")")), F.lit("")))
    return row("sitemap", s["selector"], F.when(found, listed).otherwise(failed))


def _llms_row(text: Column) -> Column:
    heads, links = F.regexp_count(text, F.lit(r"(?m)^[ \t]{0,3}#[ \t]+\S")), F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)"))
    lines = F.slice(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: T.stripped(x) != ""), 1, 25)
    said = F.concat(F.lit("llms.txt present: "), heads.cast("string"), F.lit(" H1, "), links.cast("string"), F.lit(" links, "), F.length(text).cast("string"), F.lit(" chars.\n\n"), F.array_join(lines, "\n"))
    return row("llmstxt", llms_txt(F.lit(True), text), F.when(is_markdown(text), said).otherwise(F.concat(F.lit("The answer for /llms.txt is not markdown.\n"), F.left(text, F.lit(400)))))


def _wellknown_row(url: Column, text: Column) -> Column:
    selector = wellknown(url, text)
    keys = F.array_sort(F.array_intersect(F.transform(object_keys(text), F.lower), F.array(*map(F.lit, MANIFEST_KEYS))))
    said = F.concat(F.lit("agent manifest keys present: "), F.array_join(keys, ", "), F.lit("\n\n"), F.left(text, F.lit(2000)))
    return row("wellknown", selector, F.when(selector.endswith("#manifest"), said).when(selector.endswith("#not-a-manifest"), "HTTP 200 but no agent manifest. Not counted.").otherwise(F.left(text, F.lit(1000))))


def _openapi_row(url: Column, status: Column, text: Column) -> Column:
    spec, s = openapi(text), T.stripped(text)
    version = F.coalesce(F.get_json_object(s, "$.openapi"), F.get_json_object(s, "$.swagger"))
    title = F.coalesce(F.get_json_object(s, "$.info.title"), F.lit("untitled"))
    paths = F.slice(F.array_sort(F.json_object_keys(F.get_json_object(s, "$.paths"))), 1, 25)
    as_json = F.concat(F.lit("OpenAPI "), version, F.lit(" spec: "), title, F.lit(", "), spec["n_paths"].cast("string"), F.lit(" paths, "), spec["n_operations"].cast("string"), F.lit(" operations.\n"), F.coalesce(F.array_join(paths, "\n"), F.lit("")))
    as_yaml = F.concat(F.lit("OpenAPI/Swagger YAML spec at "), url, F.lit("\n\n"), F.left(text, F.lit(1500)))
    none = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" at "), url, F.lit(" but no API description. Not counted."))
    return row("openapi", spec["selector"], F.when(spec["selector"] == "openapi#not-a-spec", none).when(s.startswith("{"), as_json).otherwise(as_yaml))


def site_evidence(sites: DataFrame, resources: DataFrame) -> DataFrame:
    """Rows of the five site detectors: site, detector (a number), seq, source_url, kind, selector, raw, phase.

    sites has site and root (its URL), one row each; resources as RESOURCES, of
    which those of other sites are left out. What is missing gives a row, too.
    A site's resources are grouped by counts only, so a site with many of them
    is no single task.
    """
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<struct<kind:string,selector:string,raw:string,phase:string>>")
    answered = F.coalesce(F.col("error").isNull() & F.col("status").between(200, 299), F.lit(False))
    known = resources.withColumns({"text": text, "found": answered & (T.stripped(text) != ""), "answered": answered})
    each = (
        F.when((F.col("role") == "robots") & F.col("answered"), robots_rows(F.col("text")))
        .when(F.col("role") == "sitemap", F.array(_sitemap_row(F.col("found"), F.col("text"), F.col("status"), F.col("error"))))
        .when((F.col("role") == "llms") & F.col("found"), F.array(_llms_row(F.col("text"))))
        .when((F.col("role") == "wellknown") & F.col("found"), F.array(_wellknown_row(F.col("url"), F.col("text"))))
        .when((F.col("role") == "openapi") & F.col("found"), F.array(_openapi_row(F.col("url"), F.col("status"), F.col("text"))))
        .otherwise(none)
    )
    number = F.array_position(F.array(*map(F.lit, DETECTORS)), F.col("role")).cast("int") - 1
    rows = known.join(sites.select("site"), "site", "left_semi").select("site", number.alias("detector"), "ord", F.col("url").alias("source_url"), F.posexplode(each).alias("place", "e"))
    rows = rows.select("site", "detector", F.struct(F.coalesce("ord", F.lit(-1).cast("long")).alias("ord"), "place").alias("seq"), "source_url", "e.*")
    said = {
        "robots": ("robots", "robots.txt#absent", "/robots.txt", "No robots.txt retrieved.", F.col("answered")), "sitemap": ("sitemap", "sitemap#absent", "", "No sitemap was reachable or declared.", F.lit(True)),
        "llms": ("llmstxt", "llms.txt#absent", "/llms.txt", "No llms.txt at the site root.", F.col("found")),
        "wellknown": ("wellknown", "wellknown#absent", "", "No agent manifest found.", F.col("found") & wellknown(F.col("url"), F.col("text")).endswith("#manifest")),
        "openapi": ("openapi", "openapi#no-spec", "", "No API description found.", F.col("found") & (openapi(F.col("text"))["selector"] == "openapi#spec")),
    }
    have = known.groupBy("site").agg(*(F.coalesce(F.max((F.col("role") == r) & said[r][4]), F.lit(False)).alias(f"has_{r}") for r in DETECTORS))
    absences = F.array_compact(F.array(*(F.when(~F.coalesce(f"has_{r}", F.lit(False)), F.struct(F.lit(i).alias("detector"), F.concat(F.regexp_replace("root", "/$", ""), F.lit(said[r][2] or "/")).alias("source_url"), row(said[r][0], said[r][1], said[r][3]).alias("e"))) for i, r in enumerate(DETECTORS))))
    missing = sites.join(have, "site", "left").select("site", F.explode(absences).alias("a"))
    last = F.struct(F.lit(2**62).cast("long").alias("ord"), F.lit(0).alias("place")).alias("seq")  # after rows of what was found
    return rows.unionByName(missing.select("site", "a.detector", last, "a.source_url", "a.e.*"))
