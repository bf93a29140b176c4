"""Components, packing, mixing, archives and suffix dedup against brute force on small tables with planted cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), len(sets[i]), str(least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(-1, None), (-2, ""), (-3, "  \t\n"), (-4, "Hello"), (-5, "hello"), (None, "hello world"), (None, "HELLO  world"), (7, "hello world"), (8, "hello world x"), (9, "z"), (9, "z"), (10, "É a b c d"), (11, "é a b c d")]
    base = [rng.choice(vocabulary) for _ in range(100)]
    passage = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(60):
        b = list(base)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(100)] = rng.choice([*vocabulary, f"q{i}"])
        rows.append((100 + i, " ".join(b)))
    for i in range(60):
        a = rng.randrange(200)
        rows.append((400 + i, " ".join(passage[a : a + rng.randrange(30, 100)] + [rng.choice(vocabulary) for _ in range(rng.randrange(12))])))
    return rows


KIND = "doc_id long, text string, source string, n_shingles int, component_id string, id string"


def frame(spark, rows, parts=3):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(k, t, None if i % 3 == 0 else f"s{i % 5}", 1, "x", "y") for i, (k, t) in enumerate(rows)], KIND).repartition(parts)


def test_components_equal_brute_force(spark, texts):
    from tidemark.llm.jaccard_join import jaccard_components

    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(frame(spark, texts)).collect())
    assert got == brute_components(texts)


@pytest.mark.parametrize("percent", [30, 50, 75, 90, 100])
def test_linked_sets_share_a_key_where_the_smaller_leads(percent):
    from tidemark.llm.jaccard_join import prefix_keys, size_classes

    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.choice(60, rng.integers(1, 12))) for _ in range(60)]
    base = rng.choice(2000, 300, replace=False)
    sets += [np.unique(np.r_[base[rng.random(300) > rng.random() ** 3 * 0.3], rng.choice(2000, rng.integers(0, 4 + i % 40))]) for i in range(60)]
    sets = [np.array(x, np.uint64) for x in {tuple(s) for s in sets}]
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    df = np.zeros(2000, np.int64)
    df[token.astype(int)] = count
    shared = [s[df[s.astype(int)] > 1] for s in sets]
    n = np.array([len(s) for s in sets])
    at = np.r_[0, np.cumsum([len(s) for s in shared])]
    flat = np.concatenate(shared)
    own, keys, lead, before = prefix_keys(flat, df[flat.astype(int)], at, n, n, percent)
    by = [dict(zip(keys[own == i], zip(lead[own == i], before[own == i]))) for i in range(len(sets))]
    cls = np.searchsorted(size_classes(int(n.max()), percent), n, "right")
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (n[i] + n[j] - both):
                a, b = (i, j) if n[i] <= n[j] else (j, i)
                met = [k for k in by[a].keys() & by[b].keys() if by[a][k][0]]
                assert met and abs(cls[i] - cls[j]) <= 1
                # the bound by positions holds at every shared key
                assert all(both <= min(by[a][k][1], by[b][k][1]) + min(len(shared[a]) - by[a][k][1], len(shared[b]) - by[b][k][1]) for k in by[a].keys() & by[b].keys())
                links += 1
    assert links > 20 or percent == 100


def test_one_of_each_keeps_columns(spark, texts):
    from tidemark.llm.jaccard_join import one_of_each

    names = "doc_id long, text string, k string, t string, row string, _k string, _t string, _i string, component_id string"
    df = spark.createDataFrame([(k, t, *(f"{c}{i}" for c in "abcdefg")) for i, (k, t) in enumerate([*texts, texts[7], texts[7]])], names).repartition(3)
    out = one_of_each(df)
    assert out.columns == df.columns
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) <= {tuple(r) for r in df.collect()}
    want = {k for k, _, c in brute_components(texts) if k == c}
    assert {str(r[0]) for r in rows} - {"None"} == want - {"None"}
    once = [r[0] for r in rows if r[0] is not None]
    assert len(once) == len(set(once)) and next(r for r in rows if r[0] == 7)[2] == "a133"


def test_components_of_large_groups(spark):
    """A third of the rows are near copies of one text, others share its passages, and one set is very long."""
    from tidemark.llm.jaccard_join import jaccard_components

    rng = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(150):
        b = list(base)
        for _ in range(rng.randrange(9)):
            b[rng.randrange(120)] = f"x{i}{rng.randrange(9)}"
        rows.append((i, " ".join(b)))
    rows += [(200 + i, " ".join(base[i % 60 : i % 60 + 50] + [rng.choice(words) for _ in range(rng.randrange(60))])) for i in range(150)]
    long = [rng.choice(words) for _ in range(60_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[300:] + ["end"])), (502, " ".join(long[:30_000]))]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_empty_tables(spark, tmp_path):
    from tidemark.llm import archive, jaccard_join, media, mixing, packing, quality, secrets, suffix_dedup, token_counts, top_k

    import public_tokenizers as P

    none = frame(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    results = [
        jaccard_join.jaccard_components(none), media.media_features(none), mixing.mix(none), packing.best_fit_packing(none, P.path("byte_bpe_50k.json")), quality.quality_scores(none, labels),
        secrets.secret_spans(none), suffix_dedup.suffix_dedup(none), token_counts.token_counts(none, P.path("word_bpe_49k.json")), top_k.top_k(vectors), secrets.redacted(none), mixing.mixed_documents(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    archive.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert archive.archive_report(spark, str(tmp_path / "a")).count() == 0


def brute_kept(src, window=100):
    seen, out = set(), {}
    for k in sorted(src):
        t, m = src[k], bytearray(len(src[k]))
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            if w in seen:
                m[i : i + window] = b"\1" * window
            seen.add(w)
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out[k] = (len(t), sum(m), runs, hashlib.sha256(bytes(c for c, x in zip(t, m, strict=True) if not x)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    from tidemark.llm.suffix_dedup import suffix_dedup

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(-1, None), (-2, ""), (-3, "a" * 99), (-4, "a" * 500), (-5, "ab" * 300), (-6, "é" * 120), (-7, "x" + base[10:400] + "\0" * 150), (-8, base + "\0" * 120)]
    for i in range(40):
        a, c = rng.randrange(1800), rng.randrange(1800)
        rows.append((100 + i, base[a : a + rng.randrange(90, 400)] + rng.choice(["", "zz", base[c : c + 130]])))
    rows += [rows[7], rows[20]]
    want = brute_kept({k: (t or "").encode() for k, t in rows})
    got = suffix_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_loser_tree_merges_and_keeps_prefix_lengths():
    from tidemark.llm.suffix_dedup import Merge, decoded, front_coded

    rng = random.Random(1)
    runs = []
    for _ in range(5):
        rows = np.array([[rng.randrange(97, 99) for _ in range(12)] for _ in range(rng.randrange(0, 30))], np.uint8).reshape(-1, 12)
        rows = rows[np.lexsort(rows.T[::-1])]
        lcp, rest = front_coded(rows)
        texts_ = decoded(lcp, rest.tobytes(), 12)
        assert texts_ == [r.tobytes() for r in rows]
        runs.append((texts_, lcp.tolist()))
    out, before = [], None
    for run, i, n in Merge(runs):
        t = runs[run][0][i]
        if before is not None:
            assert n == next((j for j in range(12) if t[j] != before[j]), 12)
        out.append(t)
        before = t
    assert out == sorted(t for r in runs for t in r[0])


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i in range(len(rooms)) if rooms[i] >= n), key=lambda i: rooms[i], default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[best] -= n
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_as_many_bins_as_plain_best_fit(seed):
    from tidemark.llm.packing import plan

    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 300])
    lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, placed = {}, {}
    for length, first, number, start, per, offset in plan(counts, capacity):
        for i in range(number):
            bins.setdefault(start + i // per, []).append((offset + i % per * length, length))
            placed.setdefault(length, set()).add(first + i)
    assert all(placed[n] == set(range(c)) for n, c in counts.items())
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == plain_best_fit(lengths, capacity)


ODD = ["Σας ΑΣ <|endoftext|> x<|startoftext|>  é ẞ İ ½ 中文字 l'été it's \x1c\x85 ok 12 «a» “b” ͅª don’t <|ENDOFTEXT|>   \n\n  x \t", "  \n\n a  b   c\r\n  d 's    ", None, "", "a" * 3000, "word " * 2500]


def test_packed_ids_equal_the_library(spark):
    import public_tokenizers as P

    from tidemark.llm.packing import _tokenizer, best_fit_packing

    rows = list(enumerate(ODD))
    tok, by = _tokenizer(P.path("byte_bpe_50k.json")), {}
    for r in best_fit_packing(frame(spark, rows), P.path("byte_bpe_50k.json")).collect():
        by.setdefault(r.doc_id, []).append(r)
    for k, t in rows:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(by[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 1024 or n == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_token_counts_equal_the_library(spark):
    import public_tokenizers as P

    from tidemark.llm.token_counts import _tokenizer, token_counts

    rows = [*enumerate(ODD), (None, "x y")]
    tok = _tokenizer(P.path("word_bpe_49k.json"))
    want = sorted(str((k, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False)), n > 2048)) for k, t in rows)
    assert sorted(str(tuple(r)) for r in token_counts(frame(spark, rows), P.path("word_bpe_49k.json")).collect()) == want


def test_tokenizers_of_another_kind_are_refused(spark):
    import public_tokenizers as P

    from tidemark.llm.token_counts import check_supported, token_counts

    check_supported(P.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        token_counts(frame(spark, [(1, "a")]), P.path("byte_bpe_50k.json"))


def water_fill(sizes):
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    clamped = {}
    while True:
        free = [s for s in sizes if s not in clamped]
        level = (1.5 * sum(sizes.values()) - sum(clamped.values())) / max(sum(weights[s] for s in free), 1)
        over = {s: 2 * sizes[s] for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            return {s: clamped.get(s, weights[s] * level) for s in sizes}
        clamped |= over


def test_mix_meets_targets(spark):
    from tidemark.llm.mixing import mix, mixed_documents

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60))) for i in range(600)] + [(900, None), (901, ""), (None, "a b"), (5, "again")]
    df = frame(spark, rows)
    out = mix(df).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mix(df).collect()))
    sizes, taken, targets = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
        assert r.taken <= 2 * r.size
    for s, t in water_fill(sizes).items():
        assert abs(t - targets[s]) < 1e-6 and abs(taken[s] - t) <= 0.02 * t + 5
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


def test_mix_targets_of_a_billion_words(spark):
    """Words that fit an integer, but not three times as many, and words beyond one."""
    from tidemark.llm.mixing import targets

    for unit in (1_000, 60_000_000, 400_000_000):
        sizes = {f"s{i:02d}": unit * n for i, n in enumerate((9, 1, 1, 1, 2, 4, 1, 1))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df, (3, 1, 2), (3, 2), 2).collect()}
        want = water_fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - t) <= 1e-9 * t for s, t in want.items())


def test_mixed_documents_of_a_billion_words(spark, monkeypatch):
    """The pipeline's stage, with every word counted a hundred thousand times."""
    import corpus_pipeline
    from tidemark.llm import mixing

    monkeypatch.setattr(mixing, "words", lambda text, own=mixing.words: own(text) * 100_000)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice("aaab")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["source_mixing"]
    assert 2**31 / 3 < 100_000 * sum(len(t.split()) for _, t, _ in rows) < 2**31
    taken, sizes = {"a": 0, "b": 0}, {"a": 0, "b": 0}
    for r in stage(spark, df, None).collect():
        taken[r.source] += 100_000 * len(r.text.split())
    for _, t, s in rows:
        sizes[s] += 100_000 * len(t.split())
    for s, t in water_fill(sizes).items():
        assert t - 3_000_000 <= taken[s] <= t


def test_mix_fills_room_beside_a_long_document(spark):
    from tidemark.llm.mixing import mix

    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "a") for i in range(2000)] + [(5000, " ".join(["w"] * 11900), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed, share in ((21, (3, 5)), (48, (3, 10))):  # the long document doesn't fit, in a bucket before the last
        out = mix(df, share=share, seed=seed).collect()
        room = int(out[0].target) - sum(r.taken for r in out)
        assert len(out) == len(rows) and 0 <= room <= 0.05 * out[0].target
        assert all(r.size > room for r in out if r.copies == 0)


def test_mix_of_repeated_rows_and_many_documents(spark):
    """A third of the rows repeat one key and text, a third have no key, and empty texts keep to the cap."""
    from tidemark.llm.mixing import TAIL, mix, mixed_documents

    rng = random.Random(6)
    rows = [(7, "same words here", "a", "x")] * 3000 + [(None, " ".join(["w"] * rng.randrange(1, 9)), rng.choice("ab"), "y") for _ in range(3000)]
    rows += [(i, " ".join(["w"] * rng.randrange(40)), "b", "z") for i in range(100, 3100 + TAIL)] + [(9, None, "c", "z"), (8, "", "c", "z")] * 3 + [(5, "five words of a clamped source here", "c", "z")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").repartition(5)
    out = mix(df).collect()
    assert len(out) == len(rows) and max(r.copies for r in out) <= 2
    for name in "abc":
        mine = [r for r in out if r.source == name]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert mine[0].target * 0.998 - 60 <= sum(r.taken for r in mine) <= mine[0].target
    mixed = [tuple(r) for r in mixed_documents(df).collect()]
    assert len(mixed) == sum(r.copies for r in out)
    for name in "abc":
        assert sum(len((t or "").split()) for _, t, s, _ in mixed if s == name) == sum(r.taken for r in out if r.source == name)


def test_archive_round_trip(spark, tmp_path):
    from tidemark.llm import archive

    rows = [(i, f"https://e.example/{i}", f"<p>{i % 7}") for i in range(40)] + [(50, None, None), (51, "u\r\nX: y", ""), (None, "u", "<p>1")]
    at = str(tmp_path / "warc")
    archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), at)
    last = {}
    for k, _, h in rows:
        if k is not None:
            last[h or ""] = max(last.get(h or "", -1), k)
    want = []
    for k, _, h in rows:
        b, again = (h or "").encode(), k is not None and k < last[h or ""]
        want.append(str((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None)))
    assert sorted(str(tuple(r)) for r in archive.archive_report(spark, at).collect()) == sorted(want)
    assert archive.read_payloads(spark, at).count() == 8  # each payload once
    records = archive.read_records(spark, at).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(block) == size + 4 and head.startswith(b"WARC/1.1\r\n")


def test_damaged_archives_fail(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.llm import archive

    at, bad = str(tmp_path / "warc"), str(tmp_path / "bad")
    archive.write_archive(spark.createDataFrame([(1, "u", "<p>one"), (2, "u", "<p>two")], "page_id long, url string, html string"), at)
    archive.read_headers(spark, at).write.parquet(f"{bad}/headers")
    stored = spark.read.parquet(f"{at}/payloads")
    stored.withColumn("body", F.lit(bytes(stored.first().body))).write.parquet(f"{bad}/payloads")
    for read in (archive.read_payloads, archive.archive_report):
        with pytest.raises(Exception, match="doesn't match its digest"):
            read(spark, bad).collect()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_on_which_polynomial_hashes_agree_do_not_link(spark):
    """Thue-Morse strings and their complements: equal under any odd base modulo 2^64 from 1024 bytes on."""
    from tidemark.llm.jaccard_join import jaccard_components

    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, "b", "a")), (3, thue_morse(4096)), (4, thue_morse(4096, "b", "a")), (5, thue_morse(1024)), (6, "x" * 100_000), (7, "x" * 99_999 + "y"), (8, "a" * 16), (9, "a" * 16 + "\0"), (10, "a" * 17)]
    rows += [(20 + i, " ".join(f"{w}{i // 2}" for w in "p q r s t".split()) + " " + thue_morse(2048, *("ab" if i % 2 else "ba"))) for i in range(4)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_word_hashes_tell_words_apart():
    from tidemark.llm.jaccard_join import word_hashes

    words = [b"a", b"a\0", b"\0a", b"ab", b"ba", *(bytes([i]) * n for i in (0, 1, 97, 255) for n in (7, 8, 9, 15, 16, 17, 40)), *(str(i).encode() for i in range(5000))]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    for h in word_hashes(data, end - [len(w) for w in words], end):
        assert len(np.unique(h)) == len(words)
    assert all(len(h) == 0 for h in word_hashes(data[:0], end[:0], end[:0]))


def test_repeats_compare_bytes_not_hashes():
    from tidemark.llm.suffix_dedup import equal_bytes, repeats

    text = np.frombuffer(b"abcabdabcab", np.uint8)
    at, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    same = lambda x, y: equal_bytes(text, at, x, y, size)
    once, again = repeats(np.zeros(4, np.uint64), np.zeros(4, np.int64), at, same)
    assert sorted(once.tolist()) == [0, 1, 3] and again.tolist() == [2]
    once, again = repeats(np.zeros(0, np.uint64), np.zeros(0, np.int64), at[:0], same)
    assert len(once) == len(again) == 0


def test_removal_of_texts_on_which_hashes_nearly_agree(spark):
    from tidemark.llm.suffix_dedup import suffix_dedup

    texts = [thue_morse(4096), thue_morse(4096, "b", "a"), "x" + thue_morse(512) + "y", "q" * 300, thue_morse(256, "b", "a") + "z"]
    want = brute_kept({i: t.encode() for i, t in enumerate(texts)})
    got = suffix_dedup(frame(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("window", [0, 30, 40, 256, 300])
def test_windows_out_of_range_raise(spark, window):
    from tidemark.llm.suffix_dedup import suffix_dedup

    with pytest.raises(ValueError, match="window"):
        suffix_dedup(frame(spark, [(1, "a")]), window)
