"""A store of page snapshots by day: puts that can be repeated, reads that pass over broken rows, the latest by url."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .captures import latest_snapshots

META = "struct<final_url:string,status:int,headers:map<string,string>,mode:string>"
KIND = "url string, url_key string, meta string, pre_html string, post_html string, capture_date date, run string"


def put(captures: DataFrame, at: str, run: str) -> None:
    """Adds captures (url, final_url, status, headers, mode, pre_html, post_html, capture_date) under the name of a run.

    A run that puts again replaces what it put on the same days and nothing
    else. Days and runs are partitions, so no other file is touched.
    """
    meta = F.to_json(F.struct("final_url", F.col("status").cast("int").alias("status"), "headers", "mode"))
    rows = captures.select("url", F.left(F.sha2("url", 256), F.lit(24)).alias("url_key"), meta.alias("meta"), "pre_html", "post_html", F.col("capture_date").cast("date").alias("capture_date"), F.lit(run).alias("run"))
    rows.write.partitionBy("capture_date", "run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(at)


def read(spark: SparkSession, at: str) -> DataFrame:
    """Snapshots with their meta data as columns; a row whose meta data can't be read is left out. Of a url's runs on a day the last by name counts."""
    rows = spark.read.schema(KIND).parquet(at).withColumn("m", F.from_json("meta", META, {"mode": "PERMISSIVE"}))
    rows = rows.where(F.col("m.status").isNotNull() & F.col("url").isNotNull())
    last = rows.groupBy("url", "capture_date").agg(F.max("run").alias("run"))
    return rows.join(last, ["url", "capture_date", "run"]).select("url", "url_key", "capture_date", "run", "m.*", "pre_html", "post_html")


def latest(spark: SparkSession, at: str, today: Column, days: int = 30) -> DataFrame:
    """The newest readable snapshot of each url of the last days."""
    return latest_snapshots(read(spark, at), today, days)
