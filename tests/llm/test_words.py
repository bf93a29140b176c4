"""Periodic runs, spelling variants and quality rules against brute force and their SQL."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least, exponent):
    """Every maximal stretch of each period, of its smallest one only."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(2 * p, exponent * p, least):
                if not any(a <= i and i + (j - i + p) <= a + m and q < p for a, m, q in found):
                    found.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent", [2, 3])
def test_runs_of_random_texts(exponent):
    from tidemark.llm.periodic import find_runs

    rng = random.Random(exponent)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            t = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(40))]
            if rng.random() < 0.5 and t:
                t = (t[: rng.randrange(1, 9)] * 9)[: rng.randrange(60)] + t
            texts.append(t)
        off = np.cumsum([0, *map(len, texts)])
        start, length, period = find_runs(np.array([w for t in texts for w in t], np.int64), off, 2, exponent)
        want = [(off[d] + a, m, p) for d, t in enumerate(texts) for a, m, p in brute_runs(t, 2, exponent)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_range_minimum_and_next_smaller():
    from tidemark.llm.periodic import RangeMinimum, next_smaller

    rng = np.random.default_rng(4)
    for n in (1, 2, 15, 16, 17, 33, 500):
        x = rng.integers(0, 20, n)
        least = RangeMinimum(x)
        a = rng.integers(0, n, 300)
        b = np.maximum(a, rng.integers(0, n, 300))
        assert least(a, b).tolist() == [x[i : j + 1].min() for i, j in zip(a, b, strict=True)]
        assert next_smaller(x).tolist() == [next((j for j in range(i + 1, n) if x[j] < x[i]), n) for i in range(n)]


def test_periodic_runs_of_documents(spark):
    from tidemark.llm.periodic import periodic_runs

    phrase = "der Hund é𝒳 bellt"
    rows = [
        (1, None), (2, ""), (3, " \t\r\n"), (4, "a"), (5, "a " * 24), (6, "a " * 23), (None, "a " * 30), (5, "a " * 24), (7, f"{phrase} " * 6 + "x"), (8, f"x  {phrase}\n" * 5),
        (9, ("a b " * 20 + "c ") * 4), (10, "\0 \0\0 " * 12), (11, " ".join(f"w{i % 5000}" for i in range(400_000))), (12, " ".join(f"w{i % 100}" for i in range(300))),
    ]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], "doc_id long, text string, n_words int, runs string")
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    want = []
    for k, t in rows:
        w = WORD.findall(t or "")
        runs = [(0, 400_000, 5000)] if k == 11 else brute_runs(w, 24, 3)
        runs = [r for r in runs if r[1] >= max(24, 3 * r[2])]
        gone = {i for a, m, p in runs for i in range(a + p, a + m)}
        want.append((str(k), len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want, key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, exponent=1)


def brute_variants(count, least=7, occurrences=2, ratio=10):
    words = {w: n for w, n in count.items() if len(w) >= least and n >= occurrences}
    by = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[i, w[:i] + w[i + 1 :]].add(w)
    near = collections.defaultdict(set)
    for (_, x), group in by.items():
        for w in group:
            near[w] |= group - {w}
            if x in words:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64, 2])
def test_variants_equal_brute_force(spark, monkeypatch, most):
    """With keys of many words, too: split down to one open code point."""
    from tidemark.llm import spelling

    monkeypatch.setattr(spelling, "MOST", most)
    rng = random.Random(most)
    words = {"aaaaaaa", "aaaaaaaa", "ééééééé", "éééééé", "zèbresx", "zebresx", "x" * 3000, "x" * 2999, "x" * 2998 + "y"}
    for base in ("election", "internationale", "été-l'abc", "bonjours"):
        for _ in range(250):
            w = list(base)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i : i + rng.choice((0, 1))] = rng.choice(("", "a", "é", "ab", "n"))
            words.add("".join(w))
    count = {w: rng.choice((1, 2, 3, 40, 400, 4000, 40000)) for w in sorted(words)}
    rows = [(w, n - n // 3, "clash") for w, n in count.items()] + [(w, n // 3, "x") for w, n in count.items()] + [(None, 5, "x")]
    df = spark.createDataFrame(rows, "word string, n long, form string").repartition(3)
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute_variants(count)
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] != r[2] for r in got if r[1])


def test_variants_of_nothing(spark):
    from tidemark.llm import spelling

    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(none)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_word_counts(spark, monkeypatch):
    from tidemark.llm import spelling

    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(1, "Élections ÉLECTIONS élections×÷x abcdefg"), (2, None), (3, ""), (None, "abcdefg ABCDEFG straßen1straßen"), (4, "aÀ" * 60_000), (4, "œuvrers short"), (5, "abcdefgh " * 50)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, word int")
    want = collections.Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            want[w] += len(w) >= 7
    got = {r.word: r.n for r in spelling.word_counts(df, alter=spelling.drop_some).collect()}
    assert got == {w: n for w, n in want.items() if n}


def brute_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def quality_texts():
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a b c d e f g h i j", "a b c d e a b c d e f", "x " * 40, "l1 a b\nl1 a b\n\n\n l1 a b\nz\r\nz\r", "é𝒳 #*$%&|<> #    x", "1 2 3 4 5 6 7 8 9 0\x0b1 2 3 4 5\x0c6"]
    for i in range(300):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(12, 80))]
        if i % 20 == 0:
            words = [w + "#*" for w in words]
        if i % 25 == 0:
            words = [w * 6 for w in words]
        if i % 10 == 0:
            words += words[:6]
        texts.append(re.sub(r" (?=\S{3} )", "\n", " ".join(words)))
    texts.append(" ".join(f"v{i % 90_000}" for i in range(200_000)))
    return texts


def test_text_counts_equal_brute_force(spark):
    from tidemark.llm import rules

    texts = quality_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    for r in rules.text_counts(df, "body").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.i]), texts[r.i]


@pytest.mark.parametrize(("few", "enough"), [(100_000, 40), (0, 1)])
def test_quality_rules_equal_brute_force(spark, monkeypatch, few, enough):
    """With broadcast and salted fences; groups that decide by themselves and those that don't."""
    from tidemark.llm import rules

    monkeypatch.setattr(rules, "FEW", few)
    monkeypatch.setattr(rules, "ENOUGH", enough)
    texts = quality_texts()
    rows = [(None if i % 50 == 9 else i // 2, t, (None, "en", "de")[i % 3], None if i % 7 == 0 else "hot" if i % 2 else f"s{i % 5}", 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, failed string").repartition(3)
    facts = []
    for _, t, lang, source, _, _ in rows:
        n, chars, symbols, dup, again = brute_counts(t)
        base = n < 10 or 100 * again > 20 * n
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        facts.append((lang, source, base, None if base else [1000 * chars // n, 1000 * symbols // n, 1000 * dup // lines, 1000 * again // n]))
    coarse = lambda v: v >> max(v.bit_length() - rules.BITS, 0) << max(v.bit_length() - rules.BITS, 0)
    want = collections.Counter()
    for (key, t, *_), (lang, source, base, values) in zip(rows, facts, strict=True):
        failed = []
        for i, (name, least, low) in enumerate(rules.RULES if values else ()):
            groups = ([f[3][i] for f in facts if f[3] and (lang is f[0] or lang == f[0]) and f[1] == source], [f[3][i] for f in facts if f[3] and f[0] == lang], [f[3][i] for f in facts if f[3]])
            own = sorted(coarse(v) for v in next((g for g in groups if len(g) >= enough), groups[-1]))
            q1, q3 = own[-(-len(own) // 4) - 1], own[-(-3 * len(own) // 4) - 1]
            reach = rules.REACH * max(q3 - q1, least)
            if values[i] > q3 + reach or low and values[i] < q1 - reach:
                failed.append(name)
        want[str(key), brute_counts(t), base, tuple(failed), not base and not failed] += 1
    got = collections.Counter((str(r.doc_id), tuple(r[c] for c in rules.COUNTS), r.base_failed, tuple(r.failed), r.kept) for r in rules.quality_rules(df).collect())
    assert got == want and any(k[3] for k in got)
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_quality_rules_keep_good_documents(spark):
    from tidemark.llm import rules

    folder = "/root/testdata/sf0.01"
    judged = rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_spelling_variants", "op13_quality_rules"])
def test_query_equals_sql(compare, name):
    from tidemark.llm import queries

    compare(queries.QUERIES[name], queries.ORACLES[name])


def test_digests_of_planted_runs(spark):
    """The query on a text that the contract makes periodic, by hand."""
    from tidemark.llm import queries

    at = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, at).collect()}
    seen = 0
    for d in spark.read.parquet(f"{at}/documents.parquet").collect():
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and 0 < n < 400:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            runs = brute_runs(w, 24, 3)
            assert rows[d.doc_id].n_runs == len(runs)
            assert rows[d.doc_id].runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
            seen += bool(runs)
    assert seen
