"""The registered queries of this subpackage: each applies an operator to its whole table."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from . import archive, common, rules
from .jaccard_join import jaccard_components
from .media import media_features
from .mixing import mix
from .packing import best_fit_packing
from .periodic import periodic_runs
from .quality import quality_scores
from .secrets import secret_spans
from .spelling import drop_some, spelling_variants, word_counts
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .top_k import top_k


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark, sf_dir):
    return top_k(_table(spark, sf_dir, "embeddings"))


def op3_media_columns(spark, sf_dir):
    return media_features(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc_archive(spark, sf_dir):
    at = common.Scratch(spark, "warc").path("archive")
    archive.write_archive(_table(spark, sf_dir, "pages"), at)
    return archive.archive_report(spark, at)


def op6_best_fit_packing(spark, sf_dir):
    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_secret_scan(spark, sf_dir):
    return secret_spans(_table(spark, sf_dir, "documents")).drop("all_spans")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op9_source_mixing(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents")).drop("copies")


def op10_token_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark, sf_dir):
    """Runs of documents; one in ten of these repeats its own words from some place on, as the contract has it."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), rules.BLANK), lambda w: w != "")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    planted = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    planted = planted.withColumn("a", (F.col("g") % F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    planted = planted.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    found = periodic_runs(planted.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text")))
    # of equal exponents the first stays: runs are in order of start, then period
    none = F.expr("cast(null as struct<start:long,length:long,period:long>)")
    best = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(word_counts(_table(spark, sf_dir, "documents"), alter=drop_some))


def op13_quality_rules(spark, sf_dir):
    return rules.quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", *rules.COUNTS, "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_top_k,
        op3_media_columns,
        op4_quality_classifier,
        op5_warc_archive,
        op6_best_fit_packing,
        op7_secret_scan,
        op8_suffix_dedup,
        op9_source_mixing,
        op10_token_counts,
        op11_periodic_runs,
        op12_spelling_variants,
        op13_quality_rules,
    )
} | {"pipeline": corpus_pipeline.run}

#: A CRC-32 table, and the CRC of a text by it.
_CRC_TABLE = "tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i))"


def _crc(text: str) -> str:
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


#: DuckDB SQL by the meaning of the contract, not by the operator's way.
ORACLES = {
    "op2_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hx, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hx, 1 + 10 * (i // 8)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM h""",
    "op11_periodic_runs": f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o FROM documents, tab),
e AS (SELECT *, len(o)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) END AS w FROM f),
x AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM w),
m AS (SELECT s.doc_id, s.i, t.i - s.i AS q FROM x s JOIN x t ON s.doc_id = t.doc_id AND s.x = t.x AND t.i > s.i AND 3 * (t.i - s.i) <= s.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM m),
c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM g GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.q < c.q AND b.s <= c.s AND b.s + b.l >= c.s + c.l)),
k AS (SELECT x.doc_id, string_agg(x.x, ' ' ORDER BY x.i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.l) GROUP BY x.doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l * 1000000000 // q DESC, s, q) AS z FROM r)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN b ON b.doc_id = w.doc_id AND b.z = 1""",
    "op12_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
c AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS t, r, count(*) AS n FROM o GROUP BY doc_id, r),
h AS (SELECT r, n, {_crc("t")} AS h FROM c, tab),
u AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM u WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS x FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.x = b.x AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.x = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.x = w.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND k.k = 1),
s AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL""",
    "op13_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
c AS (SELECT id, doc_id, lang, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
x AS (SELECT id, i, array_to_string(w[i:i + 4], chr(10)) AS x FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM c)),
y AS (SELECT id, i, lead(i) OVER (PARTITION BY id ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY id, x) AS k FROM x) WHERE k > 1),
z AS (SELECT id, sum(least(5, coalesce(j - i, 5)))::BIGINT AS n FROM y GROUP BY id),
n AS (SELECT id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines FROM c LEFT JOIN z USING (id)),
b AS (SELECT *, n_words < {rules.FEWEST} OR 100 * n_repeat_words > {rules.REPEATED} * n_words AS base_failed FROM n),
v AS (SELECT id, lang, source, unnest([0, 1, 2, 3]) AS rule, unnest([1000 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words]) AS value FROM b WHERE NOT base_failed),
g AS (SELECT lang, source, rule, (value >> greatest(length(bin(value)) - {rules.BITS}, 0)) << greatest(length(bin(value)) - {rules.BITS}, 0) AS bucket, count(*) AS n FROM v GROUP BY ALL),
m AS (SELECT *, 0 AS level FROM g UNION ALL SELECT lang, NULL, rule, bucket, sum(n), 1 FROM g GROUP BY ALL UNION ALL SELECT NULL, NULL, rule, bucket, sum(n), 2 FROM g GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM m),
q AS (SELECT level, lang, source, rule, max(total) AS n, min(bucket) FILTER (4 * below >= total) AS lower, min(bucket) FILTER (4 * below >= 3 * total) AS upper FROM p GROUP BY ALL),
f AS (SELECT v.id, v.rule, v.value, CASE WHEN q0.n >= {rules.ENOUGH} THEN q0 WHEN q1.n >= {rules.ENOUGH} THEN q1 ELSE q2 END AS s FROM v
  JOIN q q0 ON q0.level = 0 AND q0.rule = v.rule AND q0.lang IS NOT DISTINCT FROM v.lang AND q0.source IS NOT DISTINCT FROM v.source
  JOIN q q1 ON q1.level = 1 AND q1.rule = v.rule AND q1.lang IS NOT DISTINCT FROM v.lang JOIN q q2 ON q2.level = 2 AND q2.rule = v.rule),
r(rule, least, low) AS (VALUES {", ".join(f"({i}, {least}, {low})" for i, (_, least, low) in enumerate(rules.RULES))}),
o AS (SELECT id, bool_or(value > s.upper + {rules.REACH} * greatest(s.upper - s.lower, least) OR low AND value < s.lower - {rules.REACH} * greatest(s.upper - s.lower, least)) AS beyond FROM f JOIN r USING (rule) GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept FROM b LEFT JOIN o USING (id)""",
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
