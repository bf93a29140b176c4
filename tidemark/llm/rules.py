"""Quality rules whose thresholds adapt to language and source; DataFrame functions only.

Each rule is a whole number by document (thousandths of a ratio). Its values go
into a mergeable sketch per language and source: counts by log-linear buckets,
32 to an octave, so a quantile is within 1/32 of a true one. Buckets and counts
are integers: sketches merge by adding counts, in any order, with the same
result. Where a language and source have few documents, the merged sketch of the
language decides, and where that has few, too, that of all documents.

A document fails a rule beyond a fence: quartile -/+ REACH times the distance of
the quartiles, which counts as ``least`` at least. Fences come back to documents
by a join; of documents that pass the base rules those that pass all fences stay.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLANK = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Base rules: fewest words, most percent of words in repeated windows.
FEWEST, REPEATED = 10, 20
#: Name, least distance of the quartiles, whether low values fail, too. Thousandths: code points a word, symbols a word, of lines, of words.
RULES = (("word_length", 300, True), ("symbols", 20, False), ("repeated_lines", 100, False), ("repeated_words", 35, False))
#: Quartile distances beyond a quartile that pass; documents from which a sketch decides.
REACH, ENOUGH = 5, 200
#: Bits that a bucket keeps of a value; rows of fences up to which they are broadcast.
BITS, FEW = 6, 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bucket(value: Column) -> Column:
    """The least value of a whole number's bucket: its first BITS binary digits, then zeros."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _neighbours(pairs: str) -> Column:
    """i of the pairs (v, i), which are sorted, whose v another one has."""
    same = lambda x, k: F.coalesce(x["v"] == F.get(pairs, k)["v"], F.lit(False))
    return F.array_compact(F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])))


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """Adds COUNTS and n_lines to docs, whose own columns have other names.

    Windows that come twice are found by sorting a text's windows, and only in
    texts where hashes of windows aren't distinct; windows are compared as texts.
    """
    lines = F.replace("_text", F.lit("\n"), F.lit(" "))
    # few texts have other blanks than single spaces and ends of lines
    plain = F.trim(F.when(lines.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(lines, BLANK, " ")).otherwise(lines))
    zero = F.lit(0).cast("long")
    out = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("_plain", plain).withColumn("_words", F.split("_plain", " "))
    out = out.withColumn("n_words", F.when(F.col("_plain") == "", zero).otherwise(F.size("_words").cast("long")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(SOLID)))
    first = F.slice("_words", F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))
    rest = lambda i: [F.get("_words", i + k) for k in range(1, WINDOW)]
    out = out.withColumn("_hashes", F.transform(first, lambda w, i: F.xxhash64(w, *rest(i))))
    # equal windows have equal hashes: of texts with equal hashes, windows that share one are compared as texts
    by_hash = F.transform("_hashes", lambda h, i: F.struct(h.alias("v"), i.alias("i")))
    out = out.withColumn("_by_hash", F.sort_array(F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), by_hash)))
    out = out.withColumn("_maybe", _neighbours("_by_hash"))
    windows = F.transform("_maybe", lambda i: F.struct(F.concat_ws(" ", F.get("_words", i), *rest(i)).alias("v"), i.alias("i")))
    out = out.withColumn("_by_text", F.sort_array(windows)).withColumn("_again", F.sort_array(_neighbours("_by_text")))
    covered = F.aggregate(F.transform("_again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_again", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return out.select(
        *docs.columns, "n_words",
        F.when(F.col("n_words") > 0, F.length("_plain") - F.col("n_words") + 1).otherwise(zero).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
    )


def rule_values() -> Column:
    """Values of RULES, in order; of documents with a word."""
    share = lambda part, of: F.floor(1000 * F.col(part) / F.col(of))
    return F.array(share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n of rows with lang, source and values; add n by fewer columns to merge."""
    each = rows.select("lang", "source", F.posexplode("values").alias("rule", "value"))
    return each.groupBy("lang", "source", "rule", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, rule, n and the buckets q1 and q3 of the quartiles: the first with a quarter, or three, of all values in it or below."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    # a group has as many rows as a sketch has buckets, some hundreds
    group = Window.partitionBy(*by, "rule")
    placed = merged.withColumns({"below": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    least = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}")
    return placed.groupBy(*by, "rule").agg(F.max("total").alias("n"), least(1), least(3))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and, by rule, low and high: the bounds that documents of that language and source must keep to."""
    table = [quartiles(sketch, by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("rule"), F.struct("n", "q1", "q3").alias(f"s{i}")) for i, by in enumerate((["lang", "source"], ["lang"], []))]
    every = table[0].join(table[1].withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")) & (table[0]["rule"] == table[1]["rule"])).select(table[0]["rule"], "_lang", "_source", "s0", "s1")
    every = every.join(F.broadcast(table[2]), "rule")  # one row by rule
    best = F.when(F.col("s0.n") >= ENOUGH, F.col("s0")).when(F.col("s1.n") >= ENOUGH, F.col("s1")).otherwise(F.col("s2"))
    rules = F.array(*(F.struct(F.lit(least).alias("least"), F.lit(low).alias("low")) for _, least, low in RULES))
    found = every.select("_lang", "_source", "rule", best.alias("s"), F.get(rules, F.col("rule")).alias("r"))
    reach = REACH * F.greatest(F.col("s.q3") - F.col("s.q1"), F.col("r.least"))
    bounds = found.select("_lang", "_source", "rule", F.when(F.col("r.low"), F.col("s.q1") - reach).alias("low"), (F.col("s.q3") + reach).alias("high"))
    at = lambda i: F.max(F.when(F.col("rule") == i, F.struct("low", "high"))).alias(f"_f{i}")
    return bounds.groupBy(F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(*(at(i) for i in range(len(RULES))))


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of docs: key, COUNTS, n_lines, base_failed, failed (names of the rules a document is beyond the fences of), kept.

    base_failed: fewer than FEWEST words, or more than REPEATED percent of them
    in windows of WINDOW words that the text has twice. Such documents fail no
    further rule and take no part in sketches; kept is false for them. Null and
    empty texts have no words. Null languages and sources are values of their
    own. Null keys and repeated rows come back as they are, a row each; other
    columns aren't looked at.
    """
    scratch = common.Scratch(docs.sparkSession, "quality-rules")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("body"))
    base = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    counted = text_counts(rows, "body").drop("body").withColumn("base_failed", base)
    staged = scratch.stage(counted.withColumn("values", F.when(~F.col("base_failed"), rule_values())), "counts")
    bounds = scratch.stage(fences(scratch.stage(sketches(staged.where("not base_failed")), "sketches")), "fences")
    judged = common.beside(staged, bounds, ["lang", "source"], FEW)
    beyond = (F.when((F.get("values", F.lit(i)) > F.col(f"_f{i}.high")) | F.coalesce(F.get("values", F.lit(i)) < F.col(f"_f{i}.low"), F.lit(False)), F.lit(name)) for i, (name, _, _) in enumerate(RULES))
    judged = judged.withColumn("failed", F.array_compact(F.array(*beyond)))
    return judged.select(F.col("id").alias(key), *COUNTS, "n_lines", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
