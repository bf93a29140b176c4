"""Robots answers against the standard library's parser, and edge cases."""

import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from tidemark.operators import robots

# parts of made-up files and URLs
PATHS = ["/", "/a", "/a/b", "/a?x=1", "/é", "/%7Eq", "", "*", "/private/", "//x/y", "/a;", "/a;b", "/%2Fa", "/a b", "/a+b", "/%zz", "/%", "http://s.example/a", "/a?", "/a#", "/%23x", "/*", "a", "HTTP:/a", "////q", "?", "mailto:x", "%20/a", "/%C3", "/%E2%82%AC", "/~q", "/a%0Ab"]
AGENTS = ["*", "GPTBot", "gpt", "Other", "GPTBot/2 # x", "", "%47PTBot"]
KEYS = ["Disallow", "Allow", "disallow", "Crawl-delay", "Request-rate", "Sitemap", "Noindex"]


def test_answers_equal_the_standard_library(spark):
    rng = random.Random(6)
    rows = [(None, "https://s.example/a"), ("", "https://s.example/a"), ("User-agent: *\nDisallow: /", None), ("nonsense\x00\nDisallow", "/a")]
    for _ in range(1500):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += [f"{rng.choice(('User-agent', 'user-agent ', ' USER-AGENT'))}: {rng.choice(AGENTS)}" for _ in range(rng.randrange(3))]
            lines += [f"{rng.choice(KEYS)}: {rng.choice(PATHS)}" for _ in range(rng.randrange(4))] + [rng.choice(("", " ", "# c", "x"))] * rng.randrange(2)
        host = rng.choice(("https://s.example", "", "HTTPS://s.example:8", "weird:"))
        rows.append((rng.choice(("\n", "\r\n", "\r", "\x85", "\n\n")).join(lines), host + rng.choice(PATHS) + rng.choice(("", "b", "/x", ";", "?", "#", "?q=1&r", "%41"))))
    df = spark.createDataFrame([(i, r, u) for i, (r, u) in enumerate(rows)], "i int, robots string, url string").repartition(3)
    got = {r.i: r.allowed for r in robots.allowed(df, "GPTBot/1").collect()}
    want = {}
    for i, (raw, url) in enumerate(rows):
        p = RobotFileParser()
        p.parse((raw or "").splitlines())
        want[i] = not raw or url is None or p.can_fetch("GPTBot/1", url)
    assert got == want
    assert 50 < sum(not x for x in want.values()) < len(want)


def test_one_file_of_most_urls_and_columns_of_the_same_names(spark):
    raw = "User-agent: *\nDisallow: /0"
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, raw).alias("robots"), F.concat(F.lit("https://s.example/"), (F.col("id") % 2).cast("string")).alias("url"), F.lit(1).alias("rules"), F.lit(2).alias("file"), F.lit(3).alias("path"))
    out = robots.allowed(df.unionByName(df), "A")
    assert out.columns == [*df.columns, "allowed"]
    assert out.groupBy("allowed").count().orderBy("allowed").collect() == [(False, 2 * sum(i % 3 > 0 and i % 2 == 0 for i in range(2000))), (True, 2 * sum(i % 3 == 0 or i % 2 == 1 for i in range(2000)))]


def test_a_long_file_and_no_rows(spark):
    raw = "User-agent: *\n" + "\n".join(f"Disallow: /p/{i}/" for i in range(20_000))
    df = spark.createDataFrame([(raw, "https://s.example/p/19999/x"), (raw, "https://s.example/p/20000/x")], "robots string, url string")
    assert sorted((r.url[-7:], r.allowed) for r in robots.allowed(df, "A").collect()) == [("19999/x", False), ("20000/x", True)]
    assert robots.allowed(df.limit(0), "A").count() == 0
