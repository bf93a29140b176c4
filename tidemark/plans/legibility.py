"""The flagship plan: pages and site files to evidence to site scores, without a browser.

Evidence of a site is ordered by struct: its files before its pages, files by
detector, pages by place, rows of a page by detector. Any long will do for places.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import artifacts, dom, evidence, pages, rubric, sites, structured
from ..operators.registry import Registry
from ..sources import captures

ROW = "array<struct<kind:string,selector:string,raw:string,phase:string>>"


#: Rows of a page from its links are numbered from here on.
LINKS = 1 << 30
#: Those of users' detectors come after them.
USERS = 1 << 31
#: Longer pages give one row that says so; no detector reads them.
MAX_CHARS = 3_000_000


def _some(ok: Column, *rows: Column) -> Column:
    return F.when(ok, F.array(*rows)).otherwise(F.array().cast(ROW))


def _joined(x: Column, most: int) -> Column:
    return F.left(F.array_join(x, "\n"), F.lit(most))


def _structured_rows() -> list[Column]:
    """Entities, prices and availability of JSON-LD, microdata and RDFa; identifiers of JSON-LD."""
    each = lambda nodes, read: F.array_distinct(F.filter(F.flatten(F.transform(nodes, lambda n: read(n["node"]))), lambda x: x.isNotNull() & ~x.rlike(r" = \s*$")))
    price, stock = each("_nodes", structured.prices), each("_nodes", structured.availability)
    ids = F.slice(each(F.filter("_nodes", lambda n: n["syntax"] == "json-ld"), structured.identifiers), 1, 25)
    kind = lambda e: F.when(e["syntax"] == "json-ld", "jsonld").otherwise(e["syntax"])
    return [
        F.transform("_entities", lambda e: F.struct(kind(e).alias("kind"), F.concat(e["syntax"], F.lit("#"), e["type"]).alias("selector"), structured.entity_text(e["node"]).alias("raw"), F.lit("pre_js").alias("phase"))),
        F.transform(ids, lambda x: pages.row("identifier", F.concat(F.lit("jsonld#"), F.substring_index(x, " = ", 1)), x)),
        _some(F.size(price) > 0, pages.row("text", "pricing#structured-price", F.concat(F.lit("Price expressed in structured markup:\n"), _joined(price, 1500)))),
        _some(F.size(stock) > 0, pages.row("text", "pricing#structured-availability", F.concat(F.lit("Availability expressed in structured markup:\n"), _joined(stock, 1500)))),
    ]


def _dom_rows() -> list[Column]:
    """Forms and images of the shared parse; none of a page over its size limit."""
    said = lambda f: F.concat(F.upper(f["method"]), F.lit(" form, purpose="), f["purpose"], F.lit("\n"), f["fields"].cast("string"), F.lit(" fields, "), f["named"].cast("string"), F.lit(" named, "), f["labelled"].cast("string"), F.lit(" labelled ("), f["coverage"].cast("string"), F.lit("% label coverage)"))
    balance = F.concat(F.lit("images: "), F.col("images").cast("string"), F.lit(" total, "), F.col("content_images").cast("string"), F.lit(" judged content-bearing\nverdict: "), dom.media_verdict())
    return [
        F.transform("_forms", lambda f: pages.row("form", f["selector"], said(f))),
        _some(F.coalesce(F.col("images").isNotNull(), F.lit(False)), pages.row("media", "media#text-image-balance", balance)),
    ]


def _link_rows(ok: DataFrame) -> DataFrame:
    """URL patterns, identifiers in queries and API links: site, page_ord, source_url, seq, e."""
    links = pages.labelled_links(ok)
    page = F.struct("site", "page_ord", "page_url").alias("group")
    own = links.where(T.url_netloc(F.col("url")) == T.url_netloc(F.col("page_url")))
    path = T.url_path(F.col("url"))
    patterns = pages.top_markers(own.select(page, "url", "ord", pages.url_pattern(path).alias("marker")).where("marker is not null"), "marker", 10)
    keys = own.select(page, "url", "ord", path.alias("path"), F.explode(pages.query_keys(F.col("url"))).alias("k")).where(F.lower("k").isin(*P.ID_QUERY_KEYS))
    queries = pages.top_markers(keys.withColumn("marker", F.concat("path", F.lit("?"), "k", F.lit("="))), "marker", 8)
    seen = F.concat(F.lit(" on "), F.col("n").cast("string"), F.lit(" distinct link(s)."))
    patterns = patterns.select("group", (F.col("position") + LINKS).alias("seq"), pages.row("identifier", F.concat(F.lit("url-pattern#"), "marker"), F.concat(F.lit("Stable URL pattern "), "marker", F.lit(" seen"), seen)).alias("e"))
    queries = queries.select("group", (F.col("position") + LINKS + 100).alias("seq"), pages.row("identifier", F.concat(F.lit("url-query#"), "marker"), F.concat(F.lit("Identifier query parameter at "), "marker", seen)).alias("e"))
    # the detector groups by site and page: here a page of a crawl
    api = artifacts.api_links(links.withColumn("site", page))
    api = api.select(F.col("site").alias("group"), (F.col("position") + LINKS + 200).alias("seq"), pages.row("openapi", F.col("selector"), F.concat(F.lit("API/developer link: "), "url")).alias("e"))
    return patterns.unionByName(queries).unionByName(api).select("group.site", "group.page_ord", F.col("group.page_url").alias("source_url"), "seq", "e")


def page_evidence(found: DataFrame) -> DataFrame:
    """Evidence of every capture by the page detectors: one pass over the pages and one over their links."""
    html, url, text = F.col("html"), F.col("final_url"), F.col("_text")
    read = found.where(F.col("fetch_error").isNull() & F.col("status").between(200, 299)).select("site", "page_ord", "url", "final_url", "status", "headers", "html")
    large = F.length("html") > MAX_CHARS
    big = read.where(large).select("site", "page_ord", url.alias("source_url"), F.lit(0).alias("seq"), pages.row("text", "page#too-large", F.concat(F.lit("Page of "), F.length("html").cast("string"), F.lit(" chars: not scanned."))).alias("e"))
    read = captures.spread(read.where(~large))
    ok = dom.parsed(read)
    # what several rows need is computed once, in projections of its own
    ok = ok.withColumns({"_text": T.meaningful_text(html), "_forms": F.coalesce("forms", F.array().cast(ok.schema["forms"].dataType)), "_entities": F.coalesce("entities", F.array().cast(ok.schema["entities"].dataType)), "_nodes": F.coalesce("nodes", F.array().cast(ok.schema["nodes"].dataType)), "_blocks": F.coalesce(F.filter("blocks", lambda b: b["location"] != "visible_text"), F.array().cast(ok.schema["blocks"].dataType))})
    found_in = lambda x, location, at: F.transform(pages.injection_hits(x), lambda h: F.struct(h["pattern"].alias("pattern"), location.alias("location"), at.alias("at"), h["snippet"].alias("snippet")))
    # encoding tricks are looked for in visible text only
    hidden = F.flatten(F.transform("_blocks", lambda b: F.filter(found_in(b["text"], b["location"], b["selector"]), lambda h: ~h["pattern"].isin("zero_width_chars", "bidi_control_chars"))))
    ok = ok.withColumn("_injected", F.concat(hidden, found_in(text, F.lit("visible_text"), F.lit("body"))))
    # a pattern counts once at a place: the first
    key = lambda h: F.struct(h["pattern"], h["location"], h["at"])
    ok = ok.withColumn("_by_key", F.sort_array(F.transform("_injected", lambda h, i: F.struct(h["pattern"], h["location"], h["at"], i.alias("i"), h["snippet"]))))
    first = F.filter("_by_key", lambda h, i: (i == 0) | (key(F.get("_by_key", i - 1)) != key(h)))
    ok = ok.withColumn("_injected", F.sort_array(F.transform(first, lambda h: F.struct(h["i"], h["pattern"], h["location"], h["at"], h["snippet"]))))
    ok = ok.withColumns({"_canonical": pages.canonical(html, F.col("headers")), "_headings": pages.headings(html), "_chars": F.length(text), "_prices": pages.rendered_prices(text), "_stock": pages.rendered_availability(text), "_rates": pages.named_headers(F.col("headers"), P.RATE_LIMIT_HEADERS), "_auth": pages.named_headers(F.col("headers"), P.AUTH_HEADERS)})
    place = lambda p: F.when(p["pattern"].isin("zero_width_chars", "bidi_control_chars"), "encoding").otherwise(p["location"])
    said = lambda p: F.concat(F.lit("category: "), pages.injection_category(p["pattern"]), F.lit("\npattern: "), p["pattern"], F.lit(" (severity "), pages.injection_severity(p["pattern"]), F.lit(")\nat: "), p["at"], F.lit("\nsnippet: "), p["snippet"])
    injected = F.transform("_injected", lambda p: pages.row("injection", F.concat(F.lit("injection#"), p["pattern"], F.lit("#"), place(p)), said(p)))
    injected = F.when(F.size("_injected") > 0, injected).otherwise(F.array(pages.row("injection", "injection#clean", "Scanned: no injection payloads found in readable regions.")))
    rows = F.concat(
        F.array(
            F.col("_canonical"), pages.row("dom", "semantics#landmarks", pages.landmarks(html)), pages.row("dom", "semantics#headings", F.col("_headings")), pages.row("meta", "semantics#document", pages.document(html)),
            pages.row("rendering", "rendering#unavailable", F.concat(F.lit("pre-JS meaningful text: "), F.col("_chars").cast("string"), F.lit(" chars"))),
            pages.row("header", pages.interstitial(html, F.col("headers"), F.col("status")), F.lit("Checked for interstitial markers.")),
            pages.row("header", "header#response", pages.response(F.col("status"), F.col("headers"), F.col("url"), url)),
        ),
        injected,
        F.transform(pages.pagination_selectors(html, url), lambda x: pages.row("pagination", x, x)),
        *_structured_rows(), *_dom_rows(),
        _some(F.size("_prices") > 0, pages.row("text", "pricing#rendered-price", F.concat(F.lit("Prices in rendered text: "), _joined(F.col("_prices"), 600)))),
        _some(F.size("_stock") > 0, pages.row("text", "pricing#rendered-availability", F.concat(F.lit("Availability in rendered text: "), _joined(F.col("_stock"), 400)))),
        F.transform(pages.governance(url, text), lambda x: pages.row("text", x, F.concat(F.lit("Page scanned for terms: "), F.col("_chars").cast("string"), F.lit(" chars")))),
        _some(F.size("_rates") > 0, pages.row("header", "header#rate-limit", _joined(F.col("_rates"), 1500))),
        _some(F.size("_auth") > 0, pages.row("header", "header#auth", _joined(F.col("_auth"), 1500))),
    )
    spread = ok.select("site", "page_ord", url.alias("source_url"), F.posexplode(rows).alias("seq", "e"))
    every = spread.unionByName(_link_rows(read)).unionByName(big)
    return evidence.identified(every.select("site", _place(1, F.col("page_ord"), F.col("seq"), F.lit(0)), "source_url", "e.*"))


def _place(part: int, first: Column, second: Column, third: Column) -> Column:
    """Where a row stands among those of its site: files before pages."""
    return F.struct(F.lit(part).alias("part"), first.cast("long").alias("a"), second.cast("long").alias("b"), third.cast("long").alias("c")).alias("ord")


def site_evidence(found: DataFrame, resources: DataFrame) -> DataFrame:
    """Evidence by the site detectors for every site of the captures."""
    every = found.groupBy("site").agg(F.min(F.struct("page_ord", "final_url"))["final_url"].alias("url"))
    root = F.concat(F.coalesce(T.url_scheme("url"), F.lit("https")), F.lit("://"), T.url_netloc(F.col("url")), F.lit("/"))
    rows = sites.site_evidence(every.select("site", root.alias("root")), resources)
    return evidence.identified(rows.select("site", _place(0, F.col("detector"), F.col("seq.ord"), F.col("seq.place")), "source_url", "kind", "selector", "raw", "phase"))


def user_evidence(found: DataFrame, registry: Registry) -> DataFrame:
    """Evidence of captures by registered detectors, after that of the built-in ones of the same page."""
    read = found.where(F.col("fetch_error").isNull() & F.col("status").between(200, 299) & (F.length("html") <= MAX_CHARS))
    rows = registry.evidence(read).withColumn("phase", F.lit("pre_js"))
    return evidence.identified(rows.select("site", _place(1, F.col("page_ord"), F.col("detector") + USERS, F.col("seq")), "source_url", "kind", "selector", "raw", "phase"))


def crawl_evidence(found: DataFrame, resources: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Evidence of captures and of the files of their sites (as operators.sites.RESOURCES), each id of a site once, the first by ord."""
    if resources is None:
        resources = found.sparkSession.createDataFrame([], sites.RESOURCES)
    every = site_evidence(found, resources).unionByName(page_evidence(found))
    if registry and registry.detectors:
        every = every.unionByName(user_evidence(found, registry))
    return evidence.keep_first(every)


def scores(page_table: DataFrame, resources: DataFrame | None = None, registry: Registry | None = None) -> DataFrame:
    """Site scores of a table of pages and, if given, of the files of their sites and of users' detectors and checks."""
    found = captures.from_pages(page_table)
    inputs = rubric.scoring_input(found)
    rows = crawl_evidence(found, resources, registry)
    results = rubric.check_results(rows, inputs, references=False)
    if registry and registry.checks:
        results = results.unionByName(registry.results(rows, inputs).drop("evidence_refs"))
    return rubric.site_scores(results, inputs)
