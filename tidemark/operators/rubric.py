"""The rubric: 27 checks on six axes, from one conditional aggregation by site and, where they are read, references.

Evidence has site, ord, id, source_url, kind, selector, raw. Inputs have site,
pages_crawled, pages_ok, pages_robots_blocked, degraded; a site without any
evidence still gets all checks. A suppressed check leaves both sums. References
are the first few by ord, whatever a site's number of rows.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

VERSION = "1.0"
AXES = {1: ("Identity", 15), 2: ("Structured data", 20), 3: ("Capability", 25), 4: ("Extractability", 15), 5: ("Transactional", 15), 6: ("Governance", 10)}
STRUCTURED = ("jsonld", "microdata", "rdfa")


Signal = tuple[tuple[str, ...], Column]


def _on(kind: str | tuple[str, ...], where: Column | None = None) -> Signal:
    """Rows of these kinds for which where holds."""
    return (kind,) if isinstance(kind, str) else kind, F.lit(True) if where is None else where


def _sel() -> Column:
    return F.coalesce("selector", F.lit(""))


def _raw() -> Column:
    return F.col("raw")


def _type() -> Column:
    return F.substring_index(_sel(), "#", -1)


def _has(x: Column, part: str) -> Column:
    return F.contains(x, F.lit(part))


def _coverage() -> Column:
    """Label coverage of a form from its text, as a share of whole percents."""
    return F.try_to_number(F.regexp_extract(_raw(), r"\(([0-9]+)% label coverage", 1), F.lit("999")).cast("double") / 100


def _ratio() -> Column:
    return F.when(_raw().rlike(r"(?m)^ratio:\s*[0-9.]+"), F.regexp_extract(_raw(), r"(?m)^ratio:\s*([0-9.]+)", 1).cast("double"))


def _holds(v: Column) -> Column:
    return F.coalesce(~v.isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))  # v is looked up once


def _truthy(name: str) -> Column:
    return _holds(F.get_json_object(_raw(), f"$.{name}"))


def _signals() -> dict[str, Signal]:
    """Kinds of evidence rows and predicates on them; each becomes a count and ordered references."""
    from .structured import COVERAGE_TYPES, REQUIRED

    sel, raw, type_, ratio = _sel(), _raw(), _type(), _ratio()
    links = F.regexp_extract(raw, r" on ([0-9]+) distinct link", 1)
    identity = type_.isin("Organization", "LocalBusiness")
    values = F.lit(None).cast("array<string>")
    for kind, props in REQUIRED.items():
        values = F.when(type_ == kind, F.array(*(F.get_json_object(raw, f"$.{p}") for p in props))).otherwise(values)
    # a lambda, also so that Spark doesn't fuse the predicates into one method, too long to be compiled
    missing = F.exists(values, lambda v: ~_holds(v))
    parsed = T.stripped(raw).startswith("{") & F.try_parse_json(raw).isNotNull()  # dear, so the last of what is tried
    covered = type_.isin(*REQUIRED)
    return {
        "robots": _on("robots", sel == "robots.txt"),
        "robots_bad": _on("robots", sel == "robots.txt#unparseable"),
        "robots_absent": _on("robots", sel == "robots.txt#absent"),
        "stanza": _on("robots", sel.startswith("robots.txt#user-agent:")),
        "sitemap": _on("sitemap", sel == "sitemap#present"),
        "sitemap_bad": _on("sitemap", sel == "sitemap#unreachable"),
        "llms": _on("llmstxt", sel == "llms.txt#present"),
        "llms_bad": _on("llmstxt", sel == "llms.txt#not-markdown"),
        "canonical": _on("link", sel == "link[rel=canonical]"),
        "typed": _on(STRUCTURED, ~_has(sel, "#untyped")),
        "structured": _on(STRUCTURED),
        "identity": _on(STRUCTURED, identity),
        "organization": _on(STRUCTURED, identity & _truthy("name") & _truthy("url") & _truthy("address") & parsed),
        "entity": _on(STRUCTURED, type_.isin(*COVERAGE_TYPES)),
        "covered": _on(STRUCTURED, covered),
        "violating": _on(STRUCTURED, covered & missing & parsed),
        "spec": _on("openapi", sel == "openapi#spec"),
        "spec_bad": _on("openapi", sel == "openapi#not-a-spec"),
        "api_link": _on("openapi", sel.startswith("a[href")),
        "manifest": _on("wellknown", _has(sel, "#manifest")),
        "manifest_bad": _on("wellknown", _has(sel, "#not-a-manifest")),
        "pattern": _on("identifier", sel.startswith("url-pattern#") & (F.when(links != "", links).cast("int") >= 2)),
        "get_form": _on("form", _has(sel, "#get#search")),
        "contact": _on("form", _has(sel, "#contact")),
        "contact_good": _on("form", _has(sel, "#contact") & ~_has(raw, "0 named") & (_coverage() >= 0.5)),
        "price": _on("text", sel.startswith("pricing#structured")),
        "price_shown": _on("text", sel.startswith("pricing#rendered")),
        "gated": _on("header", sel == "header#interstitial"),
        "open": _on("header", sel == "header#no-interstitial"),
        "unrendered": _on("rendering", sel == "rendering#unavailable"),
        "ratio": _on("rendering", (sel == "rendering#delta") & ratio.isNotNull()),
        "landmark": _on("dom", sel == "semantics#landmarks"),
        "main": _on("dom", (sel == "semantics#landmarks") & (~_has(raw, "<main>=0") | ~_has(raw, "role=main:0"))),
        "nav": _on("dom", (sel == "semantics#landmarks") & ~_has(raw, "<nav>=0")),
        "heading": _on("dom", sel == "semantics#headings"),
        "single": _on("dom", (sel == "semantics#headings") & _has(raw, "1 <h1>")),
        "no_skip": _on("dom", (sel == "semantics#headings") & _has(raw, "hierarchy skips: none")),
        "media": _on("media"),
        "media_bad": _on("media", _has(raw, "image-dominant") | _has(raw, "largely undescribed")),
        "paged": _on("pagination", sel.isin("pagination#crawlable-urls", "pagination#rel")),
        "scroll_only": _on("pagination", (sel == "pagination#infinite-scroll") & _has(raw, "may be unreachable")),
        "id_structured": _on("identifier", sel.startswith("jsonld#")),
        "id_url": _on("identifier", sel.startswith("url-pattern#") | sel.startswith("url-query#")),
        "s_price": _on("text", sel == "pricing#structured-price"),
        "s_avail": _on("text", sel == "pricing#structured-availability"),
        "form": _on("form"),
        "measured": _on("form", _coverage().isNotNull()),
        "tos": _on("text", sel == "governance#tos-addresses-automation"),
        "tos_silent": _on("text", sel == "governance#tos-silent-on-automation"),
        "rate": _on("header", sel == "header#rate-limit"),
        "auth": _on("text", sel == "governance#machine-auth-documented"),
        "auth_header": _on("header", sel == "header#auth"),
        "injected": _on("injection", sel != "injection#clean"),
        "clean": _on("injection", sel == "injection#clean"),
    }


@dataclass(frozen=True)
class Check:
    axis: int
    id: str
    label: str
    most: int
    points: Column
    refs: Column
    suppressed: Column | None = None
    reason: str = ""


def _n(name: str) -> Column:
    return F.col(f"n_{name}")


#: No limit on the references of a check.
ALL = None


def _r(name: str, k: int | None) -> Column:
    refs = F.col(f"r_{name}")
    return refs if k is None else F.slice(refs, 1, k)


def checks() -> list[Check]:
    award = lambda ok, points: F.when(ok, points).otherwise(0)
    pick = lambda ok, a, b: F.when(ok, a).otherwise(b)
    none = F.array().cast("array<string>")
    covered_pages = F.col("canonical_pages") / F.when(F.col("pages_ok") > 0, F.col("pages_ok"))
    any_price = _n("price") + _n("price_shown")
    both = (_n("s_price") > 0).cast("int") + (_n("s_avail") > 0).cast("int")
    semantic = sum(((_n(x) > 0).cast("int") for x in ("nav", "single", "no_skip")), (_n("main") > 0).cast("int"))
    discovery = (_n("pattern") >= 2) | (_n("get_form") > 0)
    return [
        Check(1, "a1_robots_present", "robots.txt present and parseable", 2, award((_n("robots") > 0) & (_n("robots_bad") == 0), 2), F.when((_n("robots") > 0) & (_n("robots_bad") == 0), _r("robots", ALL)).when(_n("robots") > 0, F.concat(_r("robots", ALL), _r("robots_bad", ALL))).otherwise(_r("robots_absent", ALL))),
        Check(1, "a1_robots_agent_stanza", "robots.txt names an AI agent", 3, award(_n("stanza") > 0, 3), _r("stanza", ALL)),
        Check(1, "a1_sitemap", "sitemap.xml present and reachable", 3, award(_n("sitemap") > 0, 3), pick(_n("sitemap") > 0, _r("sitemap", ALL), _r("sitemap_bad", ALL))),
        Check(1, "a1_llms_txt", "llms.txt at the site root", 4, award(_n("llms") > 0, 4), pick(_n("llms") > 0, _r("llms", ALL), _r("llms_bad", ALL))),
        Check(1, "a1_canonical_coverage", "Canonical URLs on at least 80% of pages", 3, award(covered_pages >= 0.80, 3), _r("canonical", 10), F.col("pages_ok") == 0, "No page was crawled."),
        Check(2, "a2_structured_present", "Structured data present", 4, award(_n("typed") > 0, 4), pick(_n("typed") > 0, _r("typed", 10), _r("structured", 5))),
        Check(2, "a2_organization_node", "Organization with name, url and address", 4, award(_n("organization") > 0, 4), pick(_n("organization") > 0, _r("organization", 1), _r("identity", 3))),
        Check(2, "a2_entity_coverage", "Entity types covered", 8, F.least(F.lit(8), 2 * F.col("n_types")).cast("int"), F.col("entity_refs")),
        Check(2, "a2_required_properties", "No required property is missing", 4, award(_n("violating") == 0, 4), pick(_n("violating") > 0, _r("violating", 8), _r("covered", 10)), _n("covered") == 0, "No entity of a type with required properties was found."),
        Check(3, "a3_openapi_spec", "API description discoverable", 6, award(_n("spec") > 0, 6), pick(_n("spec") > 0, _r("spec", ALL), _r("spec_bad", 5))),
        Check(3, "a3_documented_api", "Documented API discoverable", 3, award(_n("api_link") > 0, 3), _r("api_link", 8)),
        Check(3, "a3_agent_manifest", "Agent manifest exists", 6, award(_n("manifest") > 0, 6), pick(_n("manifest") > 0, _r("manifest", ALL), _r("manifest_bad", 4))),
        Check(3, "a3_stable_discovery", "Stable URL patterns without JavaScript", 5, award(discovery, 5), F.when(_n("pattern") >= 2, _r("pattern", 6)).when(_n("get_form") > 0, _r("get_form", 4)).otherwise(_r("pattern", 3))),
        Check(3, "a3_contact_capability", "Contact form is machine-parseable", 3, award(_n("contact_good") > 0, 3), pick(_n("contact_good") > 0, _r("contact_good", 4), _r("contact", 4))),
        Check(3, "a3_pricing_without_login", "Prices reachable without login", 2, award((any_price > 0) & (_n("gated") == 0), 2), F.when((any_price > 0) & (_n("gated") == 0), pick(_n("price") > 0, _r("price", 6), _r("price_shown", 6))).when(_n("gated") > 0, _r("gated", 3)).otherwise(none)),
        Check(4, "a4_server_rendered", "Content is in server-rendered HTML", 5, award(F.col("mean_ratio") >= 0.5, 5), pick(_n("ratio") > 0, _r("ratio", 6), _r("unrendered", 3)), F.col("mean_ratio").isNull(), "No page has a usable rendering comparison."),
        Check(4, "a4_semantic_html", "Landmarks and one-h1 hierarchy", 4, semantic, F.concat(_r("landmark", 4), _r("heading", 4)), _n("landmark") == 0, "No page gave a semantic reading."),
        Check(4, "a4_text_in_images", "Content isn't locked in images", 3, award(2 * _n("media_bad") < _n("media"), 3), _r("media", 6), _n("media") == 0, "No page gave a media reading."),
        Check(4, "a4_crawlable_pagination", "Pagination by crawlable URLs", 3, award(_n("paged") > 0, 3), pick(_n("paged") > 0, _r("paged", 6), _r("scroll_only", 4))),
        Check(5, "a5_stable_identifiers", "Stable machine identifiers", 5, F.when(_n("id_structured") > 0, 5).when(_n("id_url") > 0, 3).otherwise(0), pick(_n("id_structured") > 0, _r("id_structured", 8), _r("id_url", 8))),
        Check(5, "a5_structured_pricing", "Prices and availability in markup", 4, (2 * both).cast("int"), pick(both > 0, F.concat(_r("s_price", 4), _r("s_avail", 4)), _r("price_shown", 6)), (both == 0) & (_n("price_shown") == 0), "No price or availability of any kind was found."),
        Check(5, "a5_form_labelling", "Forms are labelled", 3, award(F.col("mean_coverage") >= 0.90, 3), _r("measured", 6), F.col("mean_coverage").isNull(), "No form could be measured."),
        Check(5, "a5_no_interstitials", "Discovery paths are not gated", 3, award((_n("gated") == 0) & (_n("open") > 0), 3), pick(_n("gated") > 0, _r("gated", 6), _r("open", 6)), (_n("gated") == 0) & (_n("open") == 0), "No page was checked for interstitials."),
        Check(6, "a6_tos_automation", "Terms address automated access", 3, award(_n("tos") > 0, 3), pick(_n("tos") > 0, _r("tos", 4), _r("tos_silent", 3)), (_n("tos") == 0) & (_n("tos_silent") == 0), "No terms page was read."),
        Check(6, "a6_rate_limit_headers", "Rate-limit headers present", 2, award(_n("rate") > 0, 2), _r("rate", 4)),
        Check(6, "a6_machine_auth", "Machine authentication documented", 3, award(_n("auth") > 0, 3), pick(_n("auth") > 0, _r("auth", 4), _r("auth_header", 3))),
        Check(6, "a6_no_injection", "No injection payload in readable regions", 2, award((_n("injected") == 0) & (_n("clean") > 0), 2), pick(_n("injected") > 0, _r("injected", 8), _r("clean", 4)), (_n("injected") == 0) & (_n("clean") == 0), "No page was scanned."),
    ]


#: References that a signal keeps, more than any check of pages cites; signals of site files keep all, as their files bound them.
MOST_REFS = 10
SALTS = 128
OF_FILES = ("robots", "robots_bad", "robots_absent", "stanza", "sitemap", "sitemap_bad", "llms", "llms_bad", "spec", "manifest")


def first_references(rows: DataFrame, most: int) -> DataFrame:
    """site, signal, refs: the first ids by ord of rows (site, ord, id, signal).

    The rank limit is taken inside each task before rows are shuffled, and again
    after it, so a signal of many rows costs no more than its first ones.
    """
    first = Window.partitionBy("site", "signal").orderBy("ord", "id")
    kept = rows.select("site", "signal", "ord", "id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    return kept.groupBy("site", "signal").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("refs"))


def _by_kind() -> list[tuple[tuple[str, ...], dict[str, Column]]]:
    """Kinds and, by name, predicates of the signals that their rows may carry; entities are named by type, as the first of each is wanted. Kinds with the same signals go together."""
    from .structured import COVERAGE_TYPES

    of_kind: dict[str, dict[str, Column]] = {}
    for n, (kinds, where) in _signals().items():
        named = {f"entity:{t}": _type() == t for t in COVERAGE_TYPES} if n == "entity" else {n: where}
        for k in kinds:
            of_kind.setdefault(k, {}).update(named)
    same: dict[tuple[str, ...], list[str]] = {}
    for k, signals in of_kind.items():
        same.setdefault(tuple(signals), []).append(k)
    return [(tuple(kinds), of_kind[kinds[0]]) for kinds in same.values()]


def _numbers() -> dict[str, int]:
    """Signals by number, from 0, as rows carry them between steps."""
    return {n: i for i, n in enumerate(n for _, signals in _by_kind() for n in signals)}


#: Bits of a mark that are left to the signals of a kind; above them is the place of its kinds.
KIND_AT = 48


def _mark() -> Column:
    """The signals that a row carries as one long: the place of its kinds and a bit for each of their signals, only these are tried; 0 for other kinds."""
    mark = F.lit(0).cast("long")
    for place, (kinds, signals) in reversed(list(enumerate(_by_kind(), 1))):
        bits = (F.when(where, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, where in enumerate(signals.values()))
        mark = F.when(F.col("kind").isin(*kinds), sum(bits, F.lit(place << KIND_AT).cast("long"))).otherwise(mark)
    return mark


def _carried(mark: Column) -> Column:
    """The numbers of the signals of a mark."""
    numbers = _numbers()
    kinds = F.array(F.array().cast("array<int>"), *(F.array(*(F.lit(numbers[n]) for n in signals)) for _, signals in _by_kind()))
    return F.filter(F.get(kinds, F.shiftrightunsigned(mark, KIND_AT).cast("int")), lambda _, i: F.getbit(mark, i) == 1)


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, id, ord and what else is in rows (longs) of the first row by ord of each id, as keep_first has it: by a hash table of fixed width, without sorting rows."""
    ord_ = F.coalesce("ord", F.lit(-(2**63)).cast("long"))
    rest = [c for c in rows.columns if c not in (*keys, "id", "ord")]
    return rows.groupBy(*keys, "id").agg(F.min(ord_).alias("ord"), *(F.min_by(c, ord_).alias(c) for c in rest))


def _values() -> list[Column]:
    """What is counted of a row: its measure (thousandths of a ratio, percents of coverage), page (a hash of the address of a row with the canonical signal, else null) and mark."""
    measure = F.when(F.col("kind") == "rendering", F.round(_ratio() * 1000).cast("long")).when(F.col("kind") == "form", F.round(_coverage() * 100).cast("long"))
    canonical = (F.col("kind") == "link") & _signals()["canonical"][1]
    return [measure.alias("measure"), F.when(canonical, F.xxhash64("source_url")).alias("page"), _mark().alias("mark")]


def _counted(evidence: DataFrame, *keys: str, repeated: bool = False) -> DataFrame:
    """site, keys, signal (its number), page, n and total (sum of measures) of evidence rows.

    Pages can be counted apart; their kind has no other signal, so a page comes
    once. Rows are counted by their marks, of which a site has few, and
    then spread, so a signal may come more than once. Sums are taken in the tasks
    before they are shuffled, so no share of a large site is a single task.
    """
    # dealt first: a hash table of ids in the tasks that read would hold a whole split and drop few rows
    rows = _first(evidence.select("site", "id", "ord", *_values()).repartition("site", "id"), "site") if repeated else evidence.select("site", *keys, *_values())
    marks = rows.groupBy("site", *keys, "mark", "page").agg(F.count("*").alias("n"), F.sum("measure").alias("total"))
    return marks.select("site", *keys, "page", "n", "total", F.explode(_carried(F.col("mark"))).alias("signal"))


def _of_files() -> Column:
    """Whether a mark carries a signal of site files."""
    bits = {place: sum(1 << i for i, n in enumerate(signals) if n in OF_FILES) for place, (_, signals) in enumerate(_by_kind(), 1)}
    mark = F.col("mark")
    found = ((F.shiftrightunsigned(mark, KIND_AT) == place) & (mark.bitwiseAND(F.lit(b).cast("long")) != 0) for place, b in bits.items() if b)
    return reduce(lambda a, b: a | b, found)


def _cited(evidence: DataFrame, repeated: bool = False) -> DataFrame:
    """What _counted gives, and refs: ord and id of the first rows in order, from one pass over evidence.

    Rows are dealt by site and a salt of their id, once: each share finds the
    first row of an id, counts its rows by their marks and keeps the first of
    each mark, which carry the sums, before they are gathered by mark. So no
    share of a large site is a single task, and no value grows with a site's rows.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    rows = evidence.select("site", salt, "ord", "id", *_values()).repartition("site", "salt")
    rows = _first(rows, "site", "salt") if repeated else rows
    rows = rows.where(F.col("mark").bitwiseAND(F.lit((1 << KIND_AT) - 1)) != 0)
    share, gathered = (Window.partitionBy("site", *by).orderBy("ord", "id") for by in (("salt", "mark"), ("mark", "page")))
    all_of = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_files, place = _of_files(), F.col("place")
    head = lambda name: F.when(place == 1, F.col(name)).alias(name)
    shares = rows.select("site", "mark", "page", "ord", "id", F.row_number().over(share).alias("place"), F.count("*").over(all_of(share)).alias("n"), F.sum("measure").over(all_of(share)).alias("total"))
    shown = of_files | (place <= MOST_REFS)
    # of a page that no first row is of, only the page counts
    kept = shares.where(shown | F.col("page").isNotNull()).select("site", "mark", "page", "ord", F.when(shown, F.col("id")).alias("id"), head("n"), head("total"))
    refs = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("ord", "id"))).over(gathered.rowsBetween(0, MOST_REFS - 1))
    merged = kept.select("site", "mark", "page", F.row_number().over(gathered).alias("place"), F.sum("n").over(all_of(gathered)).alias("n"), F.sum("total").over(all_of(gathered)).alias("total"), refs.alias("refs"))
    runs = merged.where((place == 1) | (of_files & (place % MOST_REFS == 1)))  # a row stands for itself and those after it
    return runs.select("site", "page", head("n"), head("total"), "refs", F.explode(_carried(F.col("mark"))).alias("signal"))


def _added(counted: DataFrame, *keys: str) -> DataFrame:
    """site, keys, s: a map of a signal's number to n, total and urls (distinct pages), from rows of _counted of which a page has one; from those of _cited also cited, a map to its first references."""
    more = "refs" in counted.columns
    sums = counted.groupBy("site", *keys, "signal").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("page").alias("urls"), *([F.sort_array(F.flatten(F.collect_list("refs"))).alias("refs")] if more else []))
    of_files = F.col("signal").isin(*(_numbers()[n] for n in OF_FILES))
    maps = {"s": F.struct("n", "total", "urls")} | ({"cited": F.when(of_files, F.col("refs")).otherwise(F.slice("refs", 1, MOST_REFS))} if more else {})
    return sums.groupBy("site", *keys).agg(*(F.map_from_entries(F.collect_list(F.struct("signal", v))).alias(n) for n, v in maps.items()))


def _measured(inputs: DataFrame, added: DataFrame, *keys: str) -> DataFrame:
    """Rows of inputs with n_ of every signal, the number of covered types and the few means; sites without evidence have zeros.

    Means are of whole units (thousandths, percents), so they don't depend on the order of rows.
    """
    from .structured import COVERAGE_TYPES

    numbers = _numbers()
    # an array by number is looked up at once, in each of the many places that read it
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("urls"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(numbers) - 1)), lambda i: F.coalesce(F.try_element_at("s", i), none))
    got = lambda name: F.get("dense", F.lit(numbers[name]))
    cols = {f"n_{n}": got(n)["n"] for n in _signals() if n != "entity"}
    cols |= {"canonical_pages": got("canonical")["urls"], "mean_ratio": F.try_divide(got("ratio")["total"], got("ratio")["n"] * 1000), "mean_coverage": F.try_divide(got("measured")["total"], got("measured")["n"] * 100)}
    cols["n_types"] = sum(((got(f"entity:{t}")["n"] > 0).cast("int") for t in COVERAGE_TYPES), F.lit(0))
    return inputs.join(added, ["site", *keys], "left").withColumn("dense", dense).withColumns(cols).drop("s", "dense")


def site_signals(evidence: DataFrame, inputs: DataFrame, references: bool = True, repeated: bool = False) -> DataFrame:
    """One row for each site of inputs: n_ and, with references, r_ (count and first references in order) of every signal, and the few means.

    repeated: evidence is as identified() gives it, and of an id that a site has more than once only the first row by ord counts.
    """
    from .structured import COVERAGE_TYPES

    if not references:
        return _measured(inputs, _added(_counted(evidence, repeated=repeated)))
    none = F.array().cast("array<string>")
    numbers = _numbers()
    got = lambda name: F.try_element_at("cited", F.lit(numbers[name]))
    cols = {f"r_{n}": F.coalesce(F.transform(got(n), lambda x: x["id"]), none) for n in _signals() if n != "entity"}
    first = lambda t: F.get(got(f"entity:{t}"), F.lit(0))
    found = F.sort_array(F.array_compact(F.array(*(F.when(first(t).isNotNull(), F.struct(first(t)["ord"].alias("ord"), F.lit(t).alias("type"), first(t)["id"].alias("id"))) for t in COVERAGE_TYPES))))
    return _measured(inputs, _added(_cited(evidence, repeated))).withColumns(cols | {"entity_refs": F.transform(found, lambda e: e["id"])}).drop("cited")


def _off(c: Check) -> Column:
    return F.lit(False) if c.suppressed is None else F.coalesce(c.suppressed, F.lit(False))


def _points(c: Check) -> Column:
    return F.when(_off(c), 0).otherwise(F.coalesce(c.points, F.lit(0))).cast("int")


def check_results(evidence: DataFrame, inputs: DataFrame, references: bool = True, repeated: bool = False) -> DataFrame:
    """27 rows for each site: axis, check_id, label, points, max_points, suppressed, reason and, with references, evidence_refs.

    Where nobody reads the references, leaving them out saves the ordering of all evidence;
    repeated takes evidence before keep_first, which saves moving and sorting its texts.
    """
    rows = []
    for c in checks():
        row = [F.lit(c.axis).alias("axis"), F.lit(c.id).alias("check_id"), F.lit(c.label).alias("label"), F.coalesce(c.points, F.lit(0)).cast("int").alias("points"), F.lit(c.most).alias("max_points"), _off(c).alias("suppressed"), F.lit(c.reason).alias("reason")]
        rows.append(F.struct(*row, *([c.refs.alias("evidence_refs")] if references else [])))
    judged = {"points": lambda r: F.when(r["suppressed"], 0).otherwise(r["points"]), "reason": lambda r: F.when(r["suppressed"], r["reason"])}
    names = ["axis", "check_id", "label", "points", "max_points", "suppressed", "reason", *(["evidence_refs"] if references else [])]
    # what suppression does is a lambda over the rows, as all of them in one expression are too long a method to be compiled
    done = F.transform(F.array(*rows), lambda r: F.struct(*(judged.get(n, lambda r, n=n: r[n])(r).alias(n) for n in names)))
    return site_signals(evidence, inputs, references, repeated).select("site", F.inline(done))


def totals_without(evidence: DataFrame, inputs: DataFrame, without: dict[str, Column]) -> DataFrame:
    """site, total and, by name, what the total would be without the rows that a predicate holds for; evidence is read once.

    Rows are counted apart by the predicates that hold for them, and each total adds up what is left to it.
    """
    counted = _counted(evidence.withColumn("lost", F.array(*(F.coalesce(p, F.lit(False)) for p in without.values()))), "lost")
    left = F.array_compact(F.array(F.lit("total"), *(F.when(~F.get("lost", F.lit(i)), n) for i, n in enumerate(without))))
    split = counted.withColumn("variant", F.explode(left)).groupBy("site", "variant", "signal", "page").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    names = inputs.withColumn("variant", F.explode(F.array(*map(F.lit, ("total", *without)))))
    points = _measured(names, _added(split, "variant"), "variant").select("site", "variant", sum((_points(c) for c in checks()), F.lit(0)).cast("long").alias("points"))
    return points.groupBy("site").agg(*(F.max(F.when(F.col("variant") == n, F.col("points"))).alias(n) for n in ("total", *without)))


def axis_rollup(results: DataFrame) -> DataFrame:
    """Sums by axis and, with axis null, by site; suppressed checks are in neither sum."""
    counted = ~F.col("suppressed")
    sums = results.rollup("site", "axis").agg(F.sum(F.when(counted, F.col("points")).otherwise(0)).alias("points"), F.sum(F.when(counted, F.col("max_points")).otherwise(0)).alias("max_possible"), F.count_if("suppressed").alias("n_suppressed"))
    return sums.where("site is not null")


def confidence(pages_ok: Column, blocked: Column, crawled: Column, degraded: Column) -> Column:
    """level and reason: low under 8 pages or with over 30% of pages blocked by robots."""
    share = blocked / F.when(crawled > 0, crawled)
    few = F.when(pages_ok < 8, F.concat(F.lit("only "), pages_ok.cast("string"), F.lit(" page(s) were successfully crawled, below the 8-page floor")))
    shut = F.when(share > 0.30, F.concat(T.half_even(share * 100).cast("int").cast("string"), F.lit("% of pages were robots-blocked, above the 30% threshold")))
    why = F.concat_ws("; and ", few, shut)
    low = why != ""
    return F.struct(F.when(low, "low").otherwise("high").alias("level"), F.when(low, F.concat(F.lit("Grade band suppressed: "), why, F.lit("."))).when(degraded, "Captured without a browser; rendering-dependent checks were suppressed and excluded from the total.").alias("reason"))


def site_scores(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """total, max_possible, percentage (1 digit), band (null at low confidence), confidence, reason."""
    totals = axis_rollup(results).where("axis is null").select("site", "points", "max_possible")
    c = confidence(F.col("pages_ok"), F.col("pages_robots_blocked"), F.col("pages_crawled"), F.col("degraded"))
    scored = inputs.join(totals, "site").withColumns({"exact": T.percentage(F.col("points"), F.col("max_possible")), "c": c})
    return scored.select("site", F.col("points").alias("total"), "max_possible", T.half_even(F.col("exact"), 1).alias("percentage"), F.when(F.col("c.level") != "low", T.band(F.col("exact"))).alias("band"), F.col("c.level").alias("confidence"), F.col("c.reason").alias("reason"), "degraded", F.lit(VERSION).alias("rubric_version"))


def scoring_input(captures: DataFrame) -> DataFrame:
    """Counts of a crawl by site; captures have site, status, fetch_error, robots_blocked, mode."""
    ok = F.col("fetch_error").isNull() & F.col("status").between(200, 299)
    return captures.groupBy("site").agg(
        F.count("*").cast("int").alias("pages_crawled"), F.count_if(ok).cast("int").alias("pages_ok"), F.count_if("robots_blocked").cast("int").alias("pages_robots_blocked"),
        ((F.count_if(ok) > 0) & (F.count_if(ok & (F.col("mode") != "degraded")) == 0)).alias("degraded"),
    )

