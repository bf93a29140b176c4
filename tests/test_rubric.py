import pytest

from tidemark.operators import evidence as E
from tidemark.operators import rubric as R

KIND = "site string, ord long, source_url string, kind string, selector string, raw string, phase string"


def score(spark, rows, pages_ok=12, crawled=12, blocked=0, degraded=False):
    ev = spark.createDataFrame([("s", i, f"u{u}", k, s, r, "pre_js") for i, (u, k, s, r) in enumerate(rows)], KIND)
    inp = spark.createDataFrame([("s", crawled, pages_ok, blocked, degraded)], "site string, pages_crawled int, pages_ok int, pages_robots_blocked int, degraded boolean")
    results = R.check_results(E.keep_first(E.identified(ev)), inp)
    found = {r.check_id: r for r in results.collect()}
    assert len(found) == 27
    return found, R.site_scores(results, inp).first()


def test_no_evidence_gives_all_checks(spark):
    found, s = score(spark, [])
    assert s.total == 0 and s.max_possible < 100 and s.band == "Invisible"
    assert {c for c, r in found.items() if r.suppressed} == {"a2_required_properties", "a4_server_rendered", "a4_semantic_html", "a4_text_in_images", "a5_structured_pricing", "a5_form_labelling", "a5_no_interstitials", "a6_tos_automation", "a6_no_injection"}


def test_axes_sum_to_their_weights(spark):
    found, _ = score(spark, [])
    sums = {}
    for r in found.values():
        sums[r.axis] = sums.get(r.axis, 0) + r.max_points
    assert sums == {a: m for a, (_, m) in R.AXES.items()}


@pytest.mark.parametrize(("pages", "points"), [(9, 0), (10, 3)])
def test_canonical_coverage_edge(spark, pages, points):
    found, _ = score(spark, [(i, "link", "link[rel=canonical]", f"c{i}") for i in range(pages)])
    assert found["a1_canonical_coverage"].points == points
    assert len(found["a1_canonical_coverage"].evidence_refs) == min(pages, 10)


@pytest.mark.parametrize(("ratios", "points"), [(("0.500",), 5), (("0.499",), 0), (("0.400", "0.600"), 5)])
def test_rendering_edge(spark, ratios, points):
    found, _ = score(spark, [(i, "rendering", "rendering#delta", f"ratio: {r}") for i, r in enumerate(ratios)])
    assert found["a4_server_rendered"].points == points


def test_quirks_of_text_tests(spark):
    found, _ = score(spark, [(1, "dom", "semantics#landmarks", "<main>=0, <nav>=0, role=main:0"), (1, "dom", "semantics#headings", "11 headings, 11 <h1>.\nhierarchy skips: 1"), (1, "form", "form#contact#post#other", "10 fields, 10 named, 10 labelled (100% label coverage)")])
    assert found["a4_semantic_html"].points == 1  # "11 <h1>" holds "1 <h1>"
    assert found["a3_contact_capability"].points == 0  # "10 named" holds "0 named"


def test_taking_a_row_away_takes_its_points(spark):
    rows = [(1, "llmstxt", "llms.txt#present", "# x"), (1, "robots", "robots.txt#user-agent:GPTBot", "ua"), (1, "injection", "injection#clean", "ok")]
    totals = [score(spark, rows[:i] + rows[i + 1 :])[1].total for i in range(3)]
    whole = score(spark, rows)[1].total
    assert [whole - t for t in totals] == [4, 3, 2]


def test_order_of_evidence_changes_no_total(spark):
    rows = [(i, k, s, r) for i, (k, s, r) in enumerate([("jsonld", "jsonld#Product", '{"name": "a"}'), ("jsonld", "jsonld#Offer", '{"price": "1"}'), ("header", "header#rate-limit", "x"), ("media", "media#text-image-balance", "verdict: image-dominant")])]
    assert score(spark, rows)[1].total == score(spark, rows[::-1])[1].total


@pytest.mark.parametrize(("ok", "blocked", "level"), [(7, 0, "low"), (8, 0, "high"), (10, 3, "high"), (10, 4, "low")])
def test_confidence_edges(spark, ok, blocked, level):
    _, s = score(spark, [], pages_ok=ok, crawled=10, blocked=blocked)
    assert s.confidence == level and (s.band is None) == (level == "low")


def test_totals_without_rows_read_evidence_once(spark):
    rows = [("llmstxt", "llms.txt#present", "# x"), ("robots", "robots.txt#user-agent:GPTBot", "ua"), ("injection", "injection#clean", "ok"), ("link", "link[rel=canonical]", "c"), ("link", None, "c")]
    ev = E.keep_first(E.identified(spark.createDataFrame([("s", i, "u", *r, "pre_js") for i, r in enumerate(rows)], KIND)))
    inp = spark.createDataFrame([("s", 1, 1, 0, False), ("none", 1, 1, 0, False)], "site string, pages_crawled int, pages_ok int, pages_robots_blocked int, degraded boolean")
    sel = R.F.col("selector")
    out = R.totals_without(ev, inp, {"a": sel == "llms.txt#present", "b": sel.startswith("robots.txt#user-agent:"), "c": sel.startswith("l"), "d": R.F.lit(True)})
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("row_number()") == 1
    assert {r.site: (r.total, r.a, r.b, r.c, r.d) for r in out.collect()} == {"s": (12, 8, 9, 5, 0), "none": (0, 0, 0, 0, 0)}


def test_results_without_references_order_no_evidence(spark):
    ev = E.keep_first(E.identified(spark.createDataFrame([("s", 1, "u", "llmstxt", "llms.txt#present", "# x", "pre_js")], KIND)))
    inp = spark.createDataFrame([("s", 9, 9, 0, False)], "site string, pages_crawled int, pages_ok int, pages_robots_blocked int, degraded boolean")
    whole, points = R.check_results(ev, inp), R.check_results(ev, inp, references=False)
    assert sorted(map(tuple, points.collect())) == sorted(tuple(r)[:-1] for r in whole.collect())
    assert points._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # that of keep_first


def test_evidence_of_line_items_is_its_sql(spark):
    from tidemark.plans import fixtures

    want = fixtures.derived(spark, "/root/testdata/sf0.001", fixtures.EVIDENCE_SQL, "lineitem")
    got = fixtures.evidence_rows(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert E.identified(got)._jdf.queryExecution().optimizedPlan().toString().count("array") < 8  # blank texts are found without the steps after it


REPEATS = [
    (4, "u", "link", "link[rel=canonical]", "c"), (2, "u", "link", "link[rel=canonical]", "c"), (3, "v", "link", "link[rel=canonical]", "c"), (1, "u", "jsonld", "jsonld#Product", '{"name": "P"}'), (5, "u", "jsonld", "jsonld#Product", '{"name": "P"}'),
    (6, "w", "media", None, "verdict: image-dominant"), (7, "w", "media", "", "verdict: image-dominant"), (8, "x", "media", "m", "text"), (9, "x", "other", "m", "text"),
    (11, "y|form", "form", "s", "(40% label coverage)"), (10, "y", "form", "form|s", "(40% label coverage)"), (13, "z", "form", "f|r", "none"), (12, "z", "form", "f", "r|none"),
    (14, "t|form|f", "text", "pricing#rendered-price", "AED"), (15, "t", "form", "f|text|pricing#rendered-price", "AED"),  # one id, and the first by ord is no form
]


def test_repeated_rows_count_as_the_first_of_their_id(spark):
    ev = E.identified(spark.createDataFrame([("s", *r, "pre_js") for r in REPEATS] + [("t", *r, "pre_js") for r in REPEATS[::-1]], KIND))
    inp = spark.createDataFrame([(s, 9, 2, 0, False) for s in "stu"], "site string, pages_crawled int, pages_ok int, pages_robots_blocked int, degraded boolean")
    want = sorted(map(tuple, R.check_results(E.keep_first(ev), inp).collect()))
    assert E.keep_first(ev).count() < ev.count()
    assert sorted(map(tuple, R.check_results(ev, inp, repeated=True).collect())) == want
    points = R.check_results(ev, inp, references=False, repeated=True)
    assert sorted(map(tuple, points.collect())) == [w[:-1] for w in want]
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan  # no row of evidence is sorted


def test_signals_go_by_number_and_are_tried_in_compiled_code(spark):
    rows = [("jsonld", "jsonld#Offer", '{"price": "1"}'), ("microdata", "m#Offer", '{"price": "1", "priceCurrency": "AED"}'), ("rdfa", "r#Offer", '{"priceCurrency": "AED", "price": "0"}'), ("jsonld", "jsonld#FAQPage", "not json"), ("jsonld", "jsonld#Thing", "{}"), ("link", "jsonld#Offer", "{}")]
    ev = E.identified(spark.createDataFrame([("s", i, "u", *r, "pre_js") for i, r in enumerate(rows)], KIND))
    counted = R._counted(ev)
    assert dict(counted.dtypes)["signal"] == "int"
    assert "aggregate(" not in counted._jdf.queryExecution().optimizedPlan().toString()  # a lambda of all predicates isn't compiled
    names = {i: n for n, i in R._numbers().items()}
    n = {}
    for r in counted.collect():
        n[names[r.signal]] = n.get(names[r.signal], 0) + r.n
    assert n == {"typed": 5, "structured": 5, "covered": 4, "violating": 2, "entity:Offer": 3, "entity:FAQPage": 1}


def test_counts_and_references_come_from_one_pass(spark):
    import hashlib

    links = [(i, f"u{i % 30}", "link", "link[rel=canonical]", f"c{i}") for i in range(60)]
    agents = [(100 + i, "r", "robots", f"robots.txt#user-agent:{i}", "ua") for i in range(25)]
    media = [(50 - i, "m", "media", "m", f"text {i % 20}") for i in range(40)]  # each id twice, the later row comes first
    rows = [("s", *r, "pre_js") for r in links + agents + media]
    ev = E.identified(spark.createDataFrame(rows + [("t", *r[1:]) for r in rows[::-1]], KIND))
    inp = spark.createDataFrame([("s", 40, 37, 0, False), ("t", 40, 38, 0, False)], "site string, pages_crawled int, pages_ok int, pages_robots_blocked int, degraded boolean")
    out = R.check_results(ev, inp, repeated=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    found = {(r.site, r.check_id): (r.points, r.evidence_refs) for r in out.collect()}
    ids = lambda picked: [hashlib.sha256("|".join(r[1:]).encode()).hexdigest()[:16] for r in picked]
    for site, points in (("s", 3), ("t", 0)):  # 30 pages of 37, of 38
        assert found[site, "a1_canonical_coverage"] == (points, ids(links[:10]))
        assert found[site, "a1_robots_agent_stanza"] == (3, ids(agents))
        assert found[site, "a4_text_in_images"] == (3, ids(media[:33:-1]))
