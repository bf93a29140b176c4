"""Event streams: an append-only log with replay, counts, and rate slots with state by domain."""

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queueing import FLOOR


def replay(events: DataFrame, job: str = "job_id", at: str = "at", tie: str = "event_id") -> DataFrame:
    """Events of each job with their position, by time."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy(job).orderBy(at, tie)))


def counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events by kind; for streams in complete or update mode."""
    return events.groupBy(kind).agg(F.count("*").alias("n"))


#: State stores that keep more than one value by key; transformWithState asks for one.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which a domain that nothing asks for is forgotten.
TTL = 3600.0


class Slots(StatefulProcessor):
    """Slots of one domain: state is its next free second, its longest delay so far and its latest request."""

    def __init__(self, domain: str, at: str, floor: float, ttl: float):
        self.domain, self.at, self.floor, self.ttl = domain, at, floor, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", "free double, delay double, seen double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        free, delay, seen = self.state.get() if self.state.exists() else (0.0, 0.0, -math.inf)
        asked = sorted((t, d) for f in rows for t, d in zip(f[self.at], f["delay"].fillna(0.0), strict=True))
        out = []
        for t, d in asked:
            if t - seen > self.ttl:
                free, delay = 0.0, 0.0
            delay = max(delay, d)
            slot = max(t, free)
            out.append((key[0], t, slot, slot - t))
            free, seen = slot + max(self.floor, delay), max(seen, t)
        self.state.update((free, delay, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((seen + self.ttl) * 1000) + 2)
        yield pd.DataFrame(out, columns=[self.domain, self.at, "slot", "wait"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_slots(requests: DataFrame, domain: str = "domain", at: str = "t", delay: str | None = None, interval: float = FLOOR, ttl: float = TTL, late: str = "2 hours") -> DataFrame:
    """Slots of a stream of requests: (domain, t, slot, wait), by event time (seconds, from 0) within each batch.

    A request takes the next free second of its domain; the next one is free
    after interval, FLOOR or the longest delay that requests of the domain have
    named (column ``delay``, null: none), whichever is longest: delays only
    lengthen it. A domain that nothing asks for during ttl seconds of event time
    is forgotten, and its state is cleared by a timer, so state is bounded by
    the domains of the last hours. A request that comes late is served after
    those before it; one that is more than ``late`` behind is dropped. Requests
    of a domain of one batch are held by one task.
    """
    spark = requests.sparkSession
    if "RocksDB" not in (spark.conf.get(_STORE, "") or ""):
        spark.conf.set(_STORE, _ROCKS)
    named = F.lit(None).cast("double") if delay is None else F.col(delay).cast("double")
    rows = requests.select(F.col(domain).cast("string").alias(domain), F.col(at).cast("double").alias(at), named.alias("delay"), F.timestamp_millis((F.col(at) * 1000).cast("long") + 1).alias("_time"))
    timed = rows.withWatermark("_time", late)
    return timed.groupBy(domain).transformWithStateInPandas(Slots(domain, at, max(FLOOR, interval), ttl), f"`{domain}` string, `{at}` double, slot double, wait double", "Append", "EventTime")
