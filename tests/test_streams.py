"""Rate slots with state, the event log, the snapshot store and resumed runs."""

import os

import pytest
from pyspark.sql import functions as F


def recurrence(batches, floor=2.0, ttl=3600.0):
    """Slots as the limiter gives them, batch by batch."""
    state, out = {}, []
    for batch in batches:
        for domain, t, delay in sorted(batch, key=lambda r: (r[0], r[1], r[2] or 0)):
            free, longest, seen = state.get(domain, (0.0, 0.0, float("-inf")))
            if t - seen > ttl:
                free, longest = 0.0, 0.0
            longest = max(longest, delay or 0)
            slot = max(t, free)
            out.append((domain, t, slot))
            state[domain] = (slot + max(floor, longest), longest, max(seen, t))
    return sorted(out)


def test_slots_across_restart_and_expiry(spark, tmp_path):
    from tidemark.streaming.events import rate_slots

    batches = [
        [("a", 1.0, None), ("a", 1.0, None), ("a", 1.5, 5.0), ("b", 9.0, 1.0)],
        [("a", 2.0, 3.0), ("a", 400.0, None), ("b", 10.0, None), ("c", 0.0, None)],
        [("a", 5000.0, None), ("a", 5000.5, None), ("b", 3609.0, None), ("c", 20000.0, 7.0)],
        [("a", 20001.0, None), ("c", 20001.0, None), ("b", 20002.0, 2.5), ("b", 20002.0, 0.5)],
    ]
    kind = "domain string, t double, delay double"
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # a stream of its own for each batch: it starts from the checkpoint
        slots = rate_slots(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), delay="delay")
        slots.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r.domain, r.t, r.slot) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == recurrence(batches)
    assert ("a", 5000.5, 5002.0) in got and ("c", 20001.0, 20007.0) in got  # the delay of 5 is forgotten, that of 7 isn't


def test_a_stream_that_dies_adds_each_event_once(spark, tmp_path, monkeypatch):
    from tidemark.streaming import log

    at, kind = str(tmp_path / "log"), "job_id string, n long"
    schema = spark.createDataFrame([], kind).schema
    for i in range(4):
        spark.createDataFrame([(f"j{i % 2}", 10 * i + k) for k in range(3)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def source():
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def read():
        log.follow(spark, at, schema).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "r")).trigger(availableNow=True).start(str(tmp_path / "seen")).awaitTermination()
        return sorted(r.n for r in spark.read.schema(kind).parquet(str(tmp_path / "seen")).collect()) if os.path.exists(tmp_path / "seen") else []

    whole = log.put_batch

    def dies(batch, number, at):
        whole(batch, number, at)
        if number == 2:
            raise RuntimeError("killed after the batch was written, before the stream knew")

    monkeypatch.setattr(log, "put_batch", dies)
    assert log.history(spark, at, schema).count() == 0
    with pytest.raises(Exception, match="killed"):
        log.append(source(), at, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    early = read()
    assert len(early) == 9
    monkeypatch.setattr(log, "put_batch", whole)
    log.append(source(), at, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    everything = sorted(10 * i + k for i in range(4) for k in range(3))
    assert sorted(r.n for r in log.history(spark, at, schema).collect()) == everything
    assert read() == everything


def test_puts_of_snapshots_can_be_repeated(spark, tmp_path):
    from tidemark.sources import snapshots

    kind = "url string, final_url string, status int, headers map<string,string>, mode string, pre_html string, post_html string, capture_date string"
    row = lambda url, day, html, status=200: (url, url, status, {"a": "b"}, "full", html, "", day)
    at = str(tmp_path / "s")
    first = spark.createDataFrame([row("u", "2026-01-01", "1"), row("u", "2026-01-05", "2"), row("v", "2026-01-05", "3")], kind)
    for _ in range(2):
        snapshots.put(first, at, "r1")
    assert snapshots.read(spark, at).count() == 3
    snapshots.put(spark.createDataFrame([row("u", "2026-01-05", "4"), row("w", "2026-01-09", "5", None)], kind), at, "r2")
    spark.createDataFrame([("x", "k", "{broken", "h", "", "2026-01-06", "r3")], snapshots.KIND.replace("capture_date date", "capture_date string")).write.mode("append").partitionBy("capture_date", "run").parquet(at)
    today = F.to_date(F.lit("2026-01-10"))
    got = {r.url: (str(r.capture_date), r.pre_html, r.headers) for r in snapshots.latest(spark, at, today).collect()}
    assert got == {"u": ("2026-01-05", "4", {"a": "b"}), "v": ("2026-01-05", "3", {"a": "b"})}
    assert snapshots.latest(spark, at, F.to_date(F.lit("2026-03-10"))).count() == 0


def test_a_failing_stage_is_made_alone(spark, tmp_path):
    from tidemark.plans.lifecycle import Lifecycle

    made, at = [], str(tmp_path / "run")
    spark.range(10).write.parquet(str(tmp_path / "in"))

    def go(fail=False, parameters=""):
        life = Lifecycle(spark, at)

        def doubled(t):
            made.append("doubled")
            return t.select((F.col("id") * 2).alias("id"))

        def summed(t):
            made.append("summed")
            return t.agg(F.sum("id" if not fail else F.raise_error(F.lit("no"))).alias("s"))

        source = life.source(spark.read.parquet(str(tmp_path / "in")), "in")
        a = life.stage("doubled", doubled, source)
        b = life.stage("summed", summed, a, parameters=parameters)
        assert [r.name for r in life.manifest(a, b).collect()] == ["doubled", "summed"]
        return b.table.first().s

    with pytest.raises(Exception, match="no"):
        go(fail=True)
    assert made == ["doubled", "summed"]
    assert go() == 90 and made == ["doubled", "summed", "summed"]
    assert go() == 90 and len(made) == 3
    assert go(parameters="v2") == 90 and made[3:] == ["summed"]
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == 132 and made[4:] == ["doubled", "summed"]


def test_score_run_equals_the_plan(spark, tmp_path):
    from tidemark.plans import legibility, lifecycle

    spark.createDataFrame([(1, "https://x.example/a", "<main><h1>x</h1></main>"), (2, "https://y.example/", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    stages = lifecycle.score_run(spark, pages, str(tmp_path / "run"))
    again = lifecycle.score_run(spark, pages, str(tmp_path / "run"))
    assert [s.made for s in stages] == [True] * 4 and [s.made for s in again] == [False] * 4
    assert sorted(map(tuple, again[-1].table.collect())) == sorted(map(tuple, legibility.scores(pages).collect()))
