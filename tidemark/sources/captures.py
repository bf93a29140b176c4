"""Sources: captures from page tables, fixture pairs, latest snapshots, seed registries and recorded evaluations."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CAPTURES = "site string, page_ord long, url string, final_url string, status int, headers map<string,string>, html string, pre_html string, mode string, fetch_error string, robots_blocked boolean"


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: small inputs in few files are dealt out before costly expressions, larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df over four tasks a core at least: for short rows with costly expressions, as a file of few row groups is read by few tasks, whatever its number of splits."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming else df.repartition(max(tasks, df.rdd.getNumPartitions()))


def from_pages(pages: DataFrame) -> DataFrame:
    """Captures without a browser from (page_id, url, html): the host is the site, pages are in order of page_id, null ones first. No page is moved."""
    site = T.normalised_domain(F.col("url"))
    return pages.select(
        "page_id", site.alias("site"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.create_map().cast("map<string,string>").alias("headers"),
        F.coalesce("html", F.lit("")).alias("html"), F.coalesce("html", F.lit("")).alias("pre_html"), F.lit("").alias("post_html"), F.lit("degraded").alias("mode"), F.lit(None).cast("string").alias("fetch_error"), F.lit(False).alias("robots_blocked"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_ord"),
    )


def summaries(captures: DataFrame) -> DataFrame:
    """What a report says of each page: its addresses, status, how it was captured and the lengths of its html."""
    return captures.select("site", "url", "final_url", F.col("status").alias("status_code"), "robots_blocked", (F.col("mode") == "degraded").alias("degraded"), F.length("pre_html").alias("pre_js_chars"), F.length("post_html").alias("post_js_chars"), "fetch_error")


def refused(url: Column, reason: Column, robots: Column) -> Column:
    """A capture that was never made."""
    return F.struct(url.alias("url"), F.lit(0).alias("status"), reason.alias("fetch_error"), robots.alias("robots_blocked"), F.lit("").alias("html"))


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """name, pre, post of {name}.pre.html and {name}.post.html files."""
    files = spark.read.text(f"{folder}/*.html", wholetext=True).withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -1))
    named = files.select(F.regexp_extract("file", r"^(.*)\.(pre|post)\.html$", 1).alias("name"), F.regexp_extract("file", r"\.(pre|post)\.html$", 1).alias("part"), "value").where("part <> ''")
    return named.groupBy("name").agg(F.coalesce(F.max(F.when(F.col("part") == "pre", F.col("value"))), F.lit("")).alias("pre"), F.coalesce(F.max(F.when(F.col("part") == "post", F.col("value"))), F.lit("")).alias("post"))


def snapshot_key(url: Column, day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("/"), F.left(F.sha2(url, 256), F.lit(24)))


def latest_snapshots(snapshots: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """The newest snapshot of each url within the last days; columns url, capture_date and what goes with them."""
    recent = snapshots.where(F.col("capture_date").between(F.date_sub(today, days), today))
    newest = Window.partitionBy("url").orderBy(F.desc("capture_date"))
    return recent.withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i")


def seeds(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """Allowed and excluded sites of a parsed registry (groups of sites, excluded domains with reasons)."""
    sites = [(s["name"], s["url"], k, g.get("label", k), bool(s.get("golden", False))) for k, g in (data.get("groups") or {}).items() for s in g.get("sites", [])]
    excluded = data.get("excluded") or {}
    gone = [(d, (excluded.get("reasons") or {}).get(d, "removal requested")) for d in excluded.get("domains") or []]
    allowed = spark.createDataFrame(sites, "name string, url string, group_key string, group_label string, golden boolean").withColumn("domain", T.normalised_domain(F.col("url")))
    return allowed, spark.createDataFrame(gone, "domain string, reason string")


def seed_counts(allowed: DataFrame) -> DataFrame:
    return allowed.agg(F.count("*").alias("total_sites"), F.count_if("golden").alias("golden_sites"), F.count_distinct("group_key").alias("groups"))


def golden_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
