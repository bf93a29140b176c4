"""Users' detectors and checks, and references of checks."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def registry():
    from tidemark.operators.registry import Registry, UserCheck

    # local functions go to workers by value, as those of a notebook do
    def shout(url, html, headers):
        for i, word in enumerate(w for w in html.split() if w.isupper()):
            yield "custom", f"shout#{i}", f"{word} at {url} {headers.get('a', '')}"

    def broken(url, html, headers):
        yield "custom", "broken", "x"
        raise RuntimeError("no")

    out = Registry()
    out.detector("shout")(shout)
    out.detector("broken")(broken)
    out.check(UserCheck("u_shouts", 7, "Shouts", 5, F.col("selector").startswith("shout#"), lambda n: F.when(n >= 2, 5).otherwise(n), refs=2))
    out.check(UserCheck("u_silent", 7, "Silence", 3, F.col("selector") == "shout#0", lambda n: F.when(n == 0, 9).otherwise(-1)))
    return out


def test_registered_detectors_reach_evidence_and_score(spark, registry):
    from tidemark.operators import rubric
    from tidemark.plans import legibility
    from tidemark.sources import captures

    pages = spark.createDataFrame([(1, "https://x.example/a", "<p>STOP that NOW and NOW</p>"), (2, "https://y.example/", "<p>quiet</p>"), (3, "https://z.example/", None)], "page_id long, url string, html string")
    found = captures.from_pages(pages)
    rows = legibility.crawl_evidence(found, registry=registry)
    mine = sorted((tuple(r.ord), r.site, r.kind, r.selector, r.raw) for r in rows.where("kind in ('custom', 'detector_error')").collect())
    assert [m[1:] for m in mine if m[2] == "custom"] == [("x.example", "custom", "shout#0", "NOW at https://x.example/a")]
    assert {m[1] for m in mine if m[2] == "detector_error"} == {"x.example", "y.example", "z.example"} and all(m[4] == "RuntimeError: no" for m in mine if m[2] == "detector_error")
    got = {(r.site, r.check_id): r for r in registry.results(rows, rubric.scoring_input(found)).collect()}
    assert len(got) == 6 and got["y.example", "u_shouts"].points == 0 and got["y.example", "u_silent"].points == 3 and got["x.example", "u_silent"].points == 0
    assert len(got["x.example", "u_shouts"].evidence_refs) == min(2, sum(m[2] == "custom" for m in mine))
    plain = {r.site: (r.total, r.max_possible) for r in legibility.scores(pages).collect()}
    for r in legibility.scores(pages, registry=registry).collect():
        more = got[r.site, "u_shouts"].points + got[r.site, "u_silent"].points
        assert (r.total, r.max_possible) == (plain[r.site][0] + more, plain[r.site][1] + 8)


def test_detectors_in_sql_and_their_arguments(spark, registry):
    registry.for_sql(spark)
    spark.createDataFrame([("u", "A b CC", {"a": "h"}), (None, None, None)], "url string, html string, headers map<string,string>").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT s.seq, s.selector, s.raw FROM some_pages, LATERAL shout(url, html, headers) s").collect()
    assert sorted(tuple(r) for r in got) == [(0, "shout#0", "A at u h"), (1, "shout#1", "CC at u h")]
    with pytest.raises(Exception, match="headers is a column"):
        spark.sql("SELECT * FROM some_pages, LATERAL shout(url, html, html)").collect()


def test_registering_twice_raises(registry):
    with pytest.raises(ValueError):
        registry.detector("shout")(registry.detectors["shout"])
    with pytest.raises(ValueError):
        registry.check(registry.checks["u_shouts"])


def test_references_are_the_first_of_each_signal(spark):
    from tidemark.operators import rubric

    rows = spark.createDataFrame([("s", (i * 7919) % 5000, f"id{(i * 7919) % 5000}", "a" if i % 3 else "b") for i in range(5000)], "site string, ord long, id string, signal string").repartition(7)
    found = rubric.first_references(rows, 10)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    want = {k: [f"id{o}" for o in sorted((i * 7919) % 5000 for i in range(5000) if (i % 3 == 0) == (k == "b"))[:10]] for k in "ab"}
    assert {r.signal: r.refs for r in found.collect()} == want
