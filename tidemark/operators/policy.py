"""Crawl policy: what may be fetched, what a crawl costs, which pages come first."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def url_verdict(url: Column) -> Column:
    """The rule that decides a URL: scheme, hard_excluded_path, skip_extension or ok."""
    path = F.regexp_replace(F.lower(T.url_path(url)), "/+$", "")
    excluded = F.exists(F.array(*map(F.lit, P.HARD_EXCLUDED_PATHS)), lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))
    suffix = T.path_suffix(T.url_path(url))
    return F.when(T.url_scheme(url) != "https", "scheme").when(excluded, "hard_excluded_path").when(suffix.isin(*P.SKIP_EXTENSIONS), "skip_extension").otherwise("ok")


def looks_like_sitemap(url: Column) -> Column:
    path = F.lower(T.url_path(url))
    return path.endswith(".xml") | path.endswith(".xml.gz") | F.contains(path, F.lit("sitemap"))


def domain_verdicts(domains: DataFrame, allowed: DataFrame, excluded: DataFrame, domain: str = "domain", submitted: str = "user_submitted") -> DataFrame:
    """Adds rule and ok: malformed, excluded, allowlist, user_submitted or not_allowlisted, in this order.

    allowed and excluded each have a column domain; both are lists that people keep, so Spark decides whether to broadcast.
    """
    d = domains.withColumn("_d", T.normalised_domain(F.col(domain)))
    a = allowed.select(T.normalised_domain(F.col("domain")).alias("_d")).distinct().withColumn("_allowed", F.lit(True))
    x = excluded.select(T.normalised_domain(F.col("domain")).alias("_d")).distinct().withColumn("_excluded", F.lit(True))
    rule = (
        F.when(F.coalesce("_d", F.lit("")) == "", "malformed").when(F.col("_excluded"), "excluded").when(F.col("_allowed"), "allowlist")
        .when(F.col(submitted), "user_submitted").otherwise("not_allowlisted")
    )
    return d.join(a, "_d", "left").join(x, "_d", "left").withColumn("rule", rule).withColumn("ok", F.col("rule").isin("allowlist", "user_submitted")).drop("_d", "_allowed", "_excluded")


def budget_estimate(pages: Column, cap: int = P.INTERACTIVE_PAGES) -> Column:
    """Pages, requests and seconds that a crawl of so many candidates takes."""
    n = F.least(pages, F.lit(cap))
    return F.struct(n.cast("int").alias("pages"), (n + len(P.PROBE_PATHS) + 1).cast("int").alias("requests"), (n * P.SECONDS_PER_REQUEST).alias("page_seconds"))


def discovered(links: DataFrame, cap: int = P.INTERACTIVE_PAGES) -> DataFrame:
    """Candidate pages of a site in order: links (site, root_url, ord, url) become (site, position, url).

    Fragments and trailing slashes go; the root itself, other sites, refused
    URLs and sitemaps drop out; of equal ones the first stays; the home page
    takes one of cap pages.
    """
    base = F.substring_index("url", "#", 1)
    cut = F.regexp_replace(base, "/+$", "")
    url = F.when(cut != "", cut).otherwise(base)
    root = F.regexp_replace("root_url", "/+$", "")
    good = (url != root) & (T.normalised_domain(url) == T.normalised_domain(F.col("root_url"))) & (url_verdict(url) == "ok") & ~looks_like_sitemap(url)
    kept = links.where(good).select("site", "ord", url.alias("url")).groupBy("site", "url").agg(F.min("ord").alias("ord"))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).where(F.col("position") < cap).select("site", "position", "url")


def probe_roles(resources: DataFrame) -> DataFrame:
    """Adds role of a fetched site file by its path: llms, sitemap, openapi, wellknown or other."""
    path = F.lower(T.url_path(F.col("url")))
    role = (
        F.when(F.contains(path, F.lit("llms.txt")), "llms").when(F.contains(path, F.lit("sitemap")), "sitemap")
        .when(F.contains(path, F.lit("openapi")) | F.contains(path, F.lit("swagger")) | F.contains(path, F.lit("api-docs")), "openapi")
        .when(F.contains(path, F.lit("/.well-known/")), "wellknown").otherwise("other")
    )
    return resources.withColumn("role", role)


def seed_status(status: Column, url: Column, final_url: Column, dns_failed: Column) -> Column:
    """ok, redirected, blocked or dead, of a recorded response."""
    dead = dns_failed | status.isin(404, 410)
    moved = T.normalised_domain(url) != T.normalised_domain(final_url)
    return F.when(dead, "dead").when(status >= 400, "blocked").when(moved, "redirected").otherwise("ok")


def gate(allowed: Column, paused: Column, owned: Column, pages_ok: Column) -> Column:
    """Where a job goes before generation: refuse, score, pause or generate."""
    return F.when(~allowed, "refuse").when(pages_ok == 0, "score").when(paused & ~owned, "pause").otherwise("generate")
