"""What is written from accepted capabilities and evidence: site text files, agent cards, lookups and outcome notes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .capabilities import implies_state_change


def _section(title: str, lines: Column) -> Column:
    """A heading and its lines, nothing where there are none."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n")))


def _listed(rows: DataFrame, line: Column, order: str, name: str, most: int | None = None) -> DataFrame:
    """Lines of each site in order, the first ones only where most is given."""
    rows = rows.select("site", F.col(order).alias("_o"), line.alias("_line"))
    if most:
        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("site").orderBy("_o"))).where(F.col("_i") <= most)
    return rows.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda x: x["_line"]).alias(name))


def llms_txt_proposals(sites: DataFrame, capabilities: DataFrame, pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """site, text: a proposed llms.txt of real pages, API descriptions and accepted capabilities.

    sites: site, name; capabilities: site, cap_ord, verb, noun, description,
    accepted, name, state_changing; pages: site, page_ord, final_url, ok,
    robots_blocked; evidence: site, ord, selector, source_url.
    """
    can = _listed(capabilities.where("accepted"), F.concat(F.lit("- **"), "verb", F.lit(" "), "noun", F.lit("**: "), "description"), "cap_ord", "can")
    read = _listed(pages.where("ok and not robots_blocked"), F.concat(F.lit("- ["), F.coalesce(F.when(T.title_from(F.col("final_url")) != "", T.title_from(F.col("final_url"))), F.lit("Home")), F.lit("]("), "final_url", F.lit(")")), "page_ord", "pages", 25)
    specs = _listed(evidence.where("selector = 'openapi#spec'"), F.concat(F.lit("- [OpenAPI specification]("), "source_url", F.lit(")")), "ord", "specs", 5)
    hidden = _listed(capabilities.where(implies_state_change(F.col("name"), F.col("verb"), F.col("state_changing"))), F.concat(F.lit("- "), "verb", F.lit(" "), "noun"), "cap_ord", "hidden")
    none = F.array().cast("array<string>")
    out = sites
    for part, name in ((can, "can"), (read, "pages"), (specs, "specs"), (hidden, "hidden")):
        out = out.join(part, "site", "left").withColumn(name, F.coalesce(name, none))
    head = F.concat(F.lit("# "), "name", F.lit("\n\n> Public content on "), "site", F.lit(". This file is a proposal from the site's own markup.\n"))
    body = F.concat_ws("\n", head, _section("What an agent can do here", F.col("can")), _section("Pages", F.col("pages")), _section("API", F.col("specs")), _section("Not exposed", F.col("hidden")))
    return out.select("site", body.alias("text"))


def agent_cards(capabilities: DataFrame, version: str = "0.3.0") -> DataFrame:
    """site, card: JSON with a skill for each accepted capability, in order."""
    skill = F.struct(
        F.col("name").alias("id"), F.coalesce(F.when(F.left("description", F.lit(80)) != "", F.left("description", F.lit(80))), F.col("name")).alias("name"), "description",
        F.array(F.col("verb"), F.replace("noun", F.lit(" "), F.lit("_"))).alias("tags"), F.array(F.concat_ws(" ", "verb", "noun", F.lit("on"), "site")).alias("examples"),
    )
    listed = capabilities.where("accepted").groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("cap_ord", skill.alias("skill")))), lambda x: x["skill"]).alias("skills"))
    return listed.select("site", F.to_json(F.struct(F.lit(version).alias("protocolVersion"), F.concat("site", F.lit(" (unofficial, generated)")).alias("name"), "skills")).alias("card"))


def tool_lookup(evidence: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The first evidence rows of each site that hold the query, as a generated tool finds them; by id where places are equal, so that reruns agree."""
    hay = F.lower(F.concat_ws(" ", "kind", F.coalesce("selector", F.lit("")), "raw"))
    hits = evidence.where(~F.col("kind").isin("rendering", "media", "injection", "header") & F.contains(hay, F.lit(query.lower().strip())))
    first = Window.partitionBy("site").orderBy("ord", "id")
    return hits.withColumn("position", F.row_number().over(first)).where(F.col("position") <= most).select("site", "position", "id", "kind", "selector", F.left("raw", F.lit(900)).alias("content"))


def outcome_note(raw_ok: Column, tool_ok: Column) -> Column:
    """Which arm of a comparison succeeded."""
    return F.when(tool_ok & ~raw_ok, "interface_only").when(raw_ok & tool_ok, "both").when(raw_ok, "raw_only").otherwise("neither")


def ships(imported: Column, tools: Column, errors: Column) -> Column:
    """Whether a generated bundle may be handed out."""
    return imported & (tools > 0) & (F.size(errors) == 0)


def observed(captures: DataFrame, files: DataFrame) -> DataFrame:
    """An independent look at each site: first 12 JSON-LD types, and plain tests of its files; used to cross-check detectors.

    captures: site, page_ord, html; files: site, llms, spec, manifest, robots (texts or null).
    """
    types = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script"), 1), lambda s: F.regexp_extract_all(s, F.lit(r'"@type"\s*:\s*"([^"]+)"'), 1)))
    found = captures.select("site", "page_ord", F.posexplode(types).alias("i", "type")).groupBy("site", "type").agg(F.min(F.struct("page_ord", "i")).alias("first"))
    first = Window.partitionBy("site").orderBy("first")
    kept = found.withColumn("n", F.row_number().over(first)).where("n <= 12").groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "type"))), lambda x: x["type"]).alias("jsonld_types"))
    shell = lambda c, n: F.left(c, F.lit(n)).rlike(r"(?i)<\s*(html|!doctype)")
    has = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    llms = has("llms") & ~shell("llms", 2000) & (F.col("llms").rlike(r"(?m)^#\s+\S") | (F.regexp_count("llms", F.lit(r"\]\(")) >= 2))
    spec = has("spec") & (F.trim("spec").rlike(r"(?m)^\s*(openapi|swagger)\s*:\s*[\"']?[0-9]") | F.coalesce(F.get_json_object("spec", "$.openapi").isNotNull() | F.get_json_object("spec", "$.swagger").isNotNull(), F.lit(False)))
    out = files.join(kept, "site", "left")
    return out.select("site", F.coalesce("jsonld_types", F.array().cast("array<string>")).alias("jsonld_types"), llms.alias("has_llms_txt"), spec.alias("has_openapi_spec"), (has("robots") & F.lower("robots").rlike("gptbot|claudebot|google-extended|perplexitybot|ccbot")).alias("ai_stanza"))


def api_links(links: DataFrame) -> DataFrame:
    """Links (site, page_url, ord, href, url, label) that suggest a documented API: the first 15 distinct ones of a page."""
    hint = r"(?i)(^|[/.\-_])(api|apis|developer|developers|dev-portal|swagger|openapi|graphql|api-reference|api-docs|for-developers)([/.\-_?#]|$)"
    said = r"(?i)\b(api\s+(reference|documentation|docs|guide)|developer\s+(portal|docs|hub|centre|center)|rest\s+api|graphql\s+api|api\s+key)\b"
    good = links.where(T.url_path(F.col("url")).rlike(hint) | F.coalesce(F.col("label"), F.lit("")).rlike(said))
    kept = good.groupBy("site", "page_url", "url").agg(F.min(F.struct("ord", "href", "label")).alias("x"))
    first = Window.partitionBy("site", "page_url").orderBy("x.ord")
    return kept.withColumn("position", F.row_number().over(first)).where("position <= 15").select("site", "page_url", "url", "position", F.concat(F.lit("a[href="), F.left("x.href", F.lit(80)), F.lit("]")).alias("selector"))

