import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evidence as E


def test_ids_equal_hashlib(spark):
    rows = [("https://é.example", "text", None, "د.إ 5"), ("u", "dom", "#x", "a\nb"), ("", "k", "", "​")]
    df = spark.createDataFrame(rows, "u string, k string, s string, r string")
    got = [r[0] for r in df.select(T.evidence_id(F.col("u"), F.col("k"), F.col("s"), F.col("r"))).collect()]
    assert got == [hashlib.sha256(f"{u}|{k}|{s or ''}|{r}".encode()).hexdigest()[:16] for u, k, s, r in rows]


def test_truncation_edges(spark):
    df = spark.createDataFrame([("x" * 4000,), ("x" * 4001,), ("  a \n",)], "r string")
    got = [r[0] for r in df.select(T.truncated_raw(F.col("r"))).collect()]
    assert got == ["x" * 4000, "x" * 4000 + "\n…[truncated, 4001 chars total]", "a"]


def test_keep_first_ignores_phase(spark):
    rows = [("s", 2, "u", "k", None, "raw", "post_js"), ("s", 1, "u", "k", None, "raw", "pre_js"), ("s", 3, "u", "k", None, "  ", "pre_js")]
    df = spark.createDataFrame(rows, "site string, ord long, source_url string, kind string, selector string, raw string, phase string")
    assert [(r.ord, r.phase) for r in E.keep_first(E.identified(df)).collect()] == [(1, "pre_js")]


def test_bands_round_half_even(spark):
    df = spark.createDataFrame([(x,) for x in (24.4, 24.5, 24.6, 44.5, 64.5, 84.5, -3.0, 120.0)], "p double")
    got = [r[0] for r in df.select(T.band(F.col("p"))).collect()]
    assert got == ["Invisible", "Invisible", "Emerging", "Emerging", "Readable", "Agent-Ready", "Invisible", "Agent-Native"]


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=30), st.integers(0, 100))
def test_nearest_rank_index(values, p):
    ordered = sorted(values)
    i = min(round(p / 100 * (len(values) - 1)), len(values) - 1)
    assert ordered[i] in ordered


def test_nearest_rank(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(T.nearest_rank(F.col("v"), 95)).collect()] == [3.0, 0.0]


def test_pages_too_large_give_one_row(spark):
    from tidemark.plans import legibility
    from tidemark.sources import captures

    rows = [(1, "https://a.example/", "<main><h1>x</h1></main>"), (2, "https://a.example/big", "x" * (legibility.MAX_CHARS + 1)), (None, "https://b.example/", None)]
    found = legibility.page_evidence(captures.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    large = [r for r in found if r.source_url.endswith("/big")]
    assert [(r.kind, r.selector) for r in large] == [("text", "page#too-large")] and len(found) > 3


def test_findings_of_odd_rows(spark):
    from tidemark.operators import evidence

    rows = [("a", "injection", None, "category: x: y\r\nseverity low)\r\n"), ("b", "injection", "injection#clean", "category: z"), ("c", "text", None, "category: z"), ("d", "injection", "s", "")]
    found = {r.id: tuple(r)[1:] for r in evidence.injection_findings(spark.createDataFrame(rows, "id string, kind string, selector string, raw string")).collect()}
    assert found == {"a": ("x: y", "low", "severity low)"), "d": ("unknown", "medium", "")}


def test_induced_keeps_only_what_was_shown(spark):
    from tidemark.operators import capabilities

    rows = [("s", i, f"n{i}", ["a", "z", "", "a"] if i == 0 else None if i == 1 else ["q"]) for i in range(14)]
    shown = spark.createDataFrame([("s", "a"), ("t", "q"), ("s", "a")], "site string, id string")
    out = {r.place: r for r in capabilities.induced(spark.createDataFrame(rows, "site string, place int, name string, evidence_ids array<string>"), shown).collect()}
    assert len(out) == 12 and (out[0].kept, out[0].hallucinated, out[0].status) == (["a", "a"], ["z"], "reported")
    assert (out[1].kept, out[1].status, out[2].hallucinated, out[2].status) == ([], "dropped", ["q"], "dropped")


def test_a_finding_at_two_sites_is_one_of_each(spark):
    from tidemark.sources import reports

    empty = lambda kind: spark.createDataFrame([], kind)
    ev = spark.createDataFrame([(s, i, "same", "u", "injection", "injection#x#body", "category: x", "pre_js") for i, s in enumerate("ab")], "site string, ord long, id string, source_url string, kind string, selector string, raw string, phase string")
    rows = reports.report_rows(
        empty("site string, total long, max_possible long, percentage double, band string, confidence string, reason string"),
        empty("site string, axis int, check_id string, label string, points int, max_points int, suppressed boolean, reason string, evidence_refs array<string>"),
        empty("site string, url string, final_url string, status_code int, robots_blocked boolean, degraded boolean, pre_js_chars int, post_js_chars int, fetch_error string"),
        ev, empty("site string, cap_id long, name string, description string, accepted boolean, rule string"),
    )
    assert sorted((r.site, r.ord) for r in rows.where("part = 'finding'").collect()) == [("a", "0"), ("b", "1")]
