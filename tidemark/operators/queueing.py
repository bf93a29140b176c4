"""Rate slots, job queue and leaderboards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FLOOR = 2.0


def rate_slots(requests: DataFrame, domain: str = "domain", at: str = "t", order: str = "ord", interval: float = FLOOR) -> DataFrame:
    """Adds slot and wait: each request of a domain takes the next free slot, interval seconds apart at least.

    The recurrence slot = max(now, next), next = slot + interval has the closed
    form n * interval + running max(t - n * interval).
    """
    step = max(FLOOR, interval)
    w = Window.partitionBy(domain).orderBy(order)
    n = F.row_number().over(w) - 1
    lead = F.max(F.col(at) - F.col("_n") * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_n", n).withColumn("slot", F.col("_n") * step + lead).withColumn("wait", F.greatest(F.lit(0.0), F.col("slot") - F.col(at))).drop("_n")


def reclaimed(processing: DataFrame, heartbeats: DataFrame, now: Column, ttl: int = 120) -> DataFrame:
    """Jobs in processing whose worker has no heartbeat within ttl seconds, in no order."""
    alive = heartbeats.where(now - F.col("beat") <= ttl).select("worker").distinct()
    return processing.join(alive, "worker", "left_anti")


def fifo(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy("enqueued", "job_id")))


def leaderboard(scores: DataFrame, group: str) -> DataFrame:
    """Ranks by percentage, not total, over all and in each group.

    Percentages have one decimal, so the counts from which ranks over all come
    are a small table, whatever the number of rows.
    """
    pct = T.percentage(F.col("total"), F.col("max_possible"))
    out = scores.withColumn("percentage", T.half_even(pct, 1))
    above = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy(F.col("percentage").alias("_p")).agg(F.count("*").alias("_n"))  # a row for each tenth
    ranks = counts.select("_p", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias("rank"))
    out = out.join(F.broadcast(ranks), F.col("percentage").eqNullSafe(F.col("_p"))).drop("_p")
    return out.withColumn("group_rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc("percentage"))))


def provider_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
