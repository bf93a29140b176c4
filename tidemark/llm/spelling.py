"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

Every word of l code points is indexed by two segments, its first l // 2 code
points and the rest. One edit leaves one of them whole, so a near word of l code
points has the same segment at the same place, and one of l + 1 has the first
at the same place or the second one further on. So words meet those of equal
length and those that are one longer, and only where a segment is shared.

The same argument holds inside what a key leaves open. A key that too many words
share is split: the open part is halved, and a near word shares either half, too.
Keys are split until words per key are few or one code point is open, where
an alphabet bounds them. So no pairs of a large group are formed, and none is lost.
"""

import math
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a key beyond which it is split; distinct words of a task that are counted before they are sent.
MOST, HELD = 64, 400_000


def drop_some(key: int | None, word: str) -> str:
    """A word without one code point, in about one of 31 documents that have it: by a CRC of key and word."""
    h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % 31 == 0 else word


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, alter: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """word, n: runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of at least that many code points and how often they occur.

    A-Z count as a-z. alter(key, word) may change the words of a document; it
    sees each once, and its result counts if it is long enough. Null texts have
    no words.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def count(batches):
        total: dict[str, int] = {}

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = common.text_buffers(batch.column(1))
            # bytes.lower() changes A-Z only
            raw = data.tobytes().lower()
            for i, name in enumerate(ids):
                own: dict[str, int] = {}
                for w in runs.findall(raw[off[i] : off[i + 1]].decode("utf-8", "replace")):
                    own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    if alter:
                        w = alter(name, w)
                        if len(w) < least:
                            continue
                    total[w] = total.get(w, 0) + n
                if len(total) >= HELD:
                    yield sent()
                    total = {}
        if total:
            yield sent()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame, cuts: Column) -> DataFrame:
    """rows (word, n, longer, l) by the keys of cuts (array of a, b): all of a word of l code points but those from a to b; of one that is longer, one more is open."""
    each = rows.select("word", "n", "longer", "l", F.explode(cuts).alias("c"))
    left = F.substring("word", F.lit(1), F.col("c.a"))
    right = F.substring("word", F.col("c.b") + 1 + F.col("longer").cast("int"), F.length("word"))
    # a hash that is shared by other words only adds pairs to verify
    return each.select(F.xxhash64("l", "c.a", "c.b", left, right).alias("key"), "word", "n", "longer", "l", "c.a", "c.b")


def _halves(a: Column, b: Column) -> Column:
    at = lambda x, y: F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"))
    middle = F.floor((a + b) / 2)
    return F.array(at(middle, b), at(a, middle))


def near_words(words: DataFrame, least: int, scratch: common.Scratch) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words that are one edit apart, once. words: word, n, no word twice."""
    length = F.length("word")
    roles = [words.select("word", "n", F.lit(False).alias("longer"), length.alias("l")), words.where(length > least).select("word", "n", F.lit(True).alias("longer"), (length - 1).alias("l"))]
    rows = _keyed(roles[0].unionByName(roles[1]), _halves(F.lit(0), F.col("l")))
    found, used = [], []
    while True:
        size = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(~F.col("longer")).alias("indexed")).where("size > 1 and indexed > 0")
        live = scratch.stage(rows.join(size, "key").withColumn("split", (F.col("size") > MOST) & (F.col("b") - F.col("a") > 1)).drop("size", "indexed"), "keys")
        small = live.where("not split")
        index = small.where("not longer").select("key", "word", "n")
        probe = small.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "longer")
        one = F.levenshtein("word", "near", 1) == 1
        pairs = index.join(probe, "key").where((F.col("longer") | (F.col("word") < F.col("near"))) & one).select("word", "n", "near", "near_n")
        found.append(scratch.stage(pairs, "pairs"))
        used.append(live)
        large = live.where("split")
        if not large.limit(1).count():
            break
        rows = _keyed(large.select("word", "n", "longer", "l", "a", "b").withColumn("cuts", _halves(F.col("a"), F.col("b"))), F.col("cuts"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.dropDuplicates(["word", "near"])
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    out = scratch.stage(pairs.select(both.alias("p")).select("p.*"), "near")
    scratch.drop(*found, *used)
    return out


def spelling_variants(counts: DataFrame, least: int = 7, occurrences: int = 2, ratio: int = 10) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    counts: word, n; rows of a word are summed, null words and words under
    ``least`` code points or ``occurrences`` are left out. Two words are near if
    they differ by one code point that is inserted, deleted or replaced. The
    form of a word is its near word of largest n (ties: the least in code-point
    order), if that is at least ``ratio`` times its own, else null; ``ratio`` is
    2 or more, so forms end. root follows forms to the last.
    """
    if ratio < 2 or least < 2:
        raise ValueError("ratio and least are 2 or more")
    scratch = common.Scratch(counts.sparkSession, "spelling")
    summed = counts.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)
    words = scratch.stage(summed, "words")
    near = near_words(words, least, scratch)
    # strings compare by bytes of UTF-8, which is code-point order
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.m") >= ratio * F.col("n"), F.lit(False)))
    judged = scratch.stage(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.m")).alias("form_n")), "forms")
    scratch.drop(near)
    steps = scratch.stage(judged.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    # n grows by ratio with each step, which bounds them; each round doubles the steps that are taken
    deepest = int(math.log(max(judged.agg(F.max("n")).first()[0] or 1, 1), ratio)) + 1
    for _ in range(max(deepest - 1, 0).bit_length()):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = scratch.stage(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        scratch.drop(steps)
        steps = after
    return judged.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
