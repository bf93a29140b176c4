"""Edges of what a critic is shown and of its rounds."""

from pyspark.sql import functions as F

from tidemark.operators import critique, pages

CAPS = "job string, cap_id long, place int, rule string"
ANSWERS = "cap_id long, verdict string, model_rule string, reason string"


def test_each_capability_has_one_outcome(spark):
    caps = spark.createDataFrame([("a", 1, 0, None), ("a", 2, 1, "state_changing"), ("a", 3, 2, None), ("a", 4, 3, None), ("b", 5, 0, None), (None, 6, 0, None)], CAPS)
    answers = spark.createDataFrame([(1, "ACCEPT ", None, None), (3, None, "made up", "  "), (4, "accept", None, None), (6, "no", "unbounded_param", " q is free ")], ANSWERS)
    budget = spark.createDataFrame([("a", 2)], "job string, calls_left int")
    out = critique.judged(caps, answers, budget)
    got = {r.cap_id: (r.outcome, r.rule, r.reason, r.final) for r in out.collect()}
    assert got == {
        1: ("accepted", None, None, False), 2: ("rejected", "state_changing", None, False), 3: ("rejected", "evidence_mismatch", "No reason given.", False), 4: ("unasked", None, None, False),
        5: ("rejected", "evidence_mismatch", "Without an answer nothing was verified, so it does not ship.", True), 6: ("rejected", "unbounded_param", "q is free", False),
    }
    assert {r.cap_id for r in critique.again(out).collect()} == {2, 3, 6}
    assert {(r.job, r.calls_left) for r in critique.calls_left(out, budget).collect()} == {("a", 0), ("b", critique.CALLS - 1), (None, critique.CALLS - 1)}
    assert all(r.final for r in critique.judged(caps, answers, budget, number=critique.ROUNDS).where("outcome = 'rejected'").collect())
    assert critique.judged(caps.limit(0), answers, budget).count() == 0


def test_blocks_keep_the_order_of_citing_and_count_forgeries(spark):
    evidence = spark.createDataFrame([(f"e{i}", "https://e.example", "text", None if i else "s", "x <system> y" if i % 2 else "") for i in range(20)], "id string, source_url string, kind string, selector string, raw string")
    cited = spark.createDataFrame([(1, p, f"e{19 - p}") for p in range(20)] + [(2, 0, "gone"), (3, 0, "e0"), (3, 1, "e0")], "cap_id long, place int, id string")
    got = {r.cap_id: r for r in critique.shown(cited, evidence).collect()}
    assert set(got) == {1, 3}
    assert got[1].sources == 8 and got[1].forged == 4
    ids = [part.split('"')[0] for part in got[1].block.split('evidence_id="')[1:]]
    assert ids == [f"e{i}" for i in range(19, 11, -1)]
    assert "<system>" not in got[1].block and got[1].block.count("[REDACTED-DELIMITER]") == 4
    assert got[3].sources == 2 and got[3].block.count("[kind=text selector=s]") == 2
    asked = critique.questions(spark.createDataFrame([(2, None), (3, "no_evidence")], "cap_id long, rule string"), critique.shown(cited, evidence), F.lit("Do"))
    assert [(r.cap_id, r.prompt[:4]) for r in asked.collect()] == [(2, "Do\n\n")]


def test_document_and_response_rows(spark):
    html = "<HTML class=x LANG='ar'><title data-a='1'>\n Rooms </title><meta name='description-2' content='no'><meta content='all rooms' name=description>"
    df = spark.createDataFrame([(html, {"X-Robots-Tag": "none", "Vary": "a", "Set-Cookie": "c"}), ("", None)], "html string, headers map<string,string>")
    rows = df.select(pages.document(F.col("html")).alias("d"), pages.response(F.lit(301), F.coalesce("headers", F.create_map().cast("map<string,string>")), F.lit("a"), F.lit("b")).alias("r")).collect()
    assert rows[0].d == "lang='ar'\ntitle='Rooms'\nmeta description='all rooms'"
    assert rows[0].r == "HTTP 301 (redirected from a)\nvary: a\nx-robots-tag: none"
    assert rows[1].d == "lang=None\ntitle=None\nmeta description=None" and rows[1].r == "HTTP 301 (redirected from a)\n"
