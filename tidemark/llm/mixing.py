"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: sources share ``share`` times all words by weight; one that would pass
``max_epochs`` times its own words is clamped there and its excess goes to the
others by weight, until none is above. A source's epochs are then whole
repetitions of all its documents and a seeded part of them. Documents stand in
the order of a seeded hash of key and text; those before a source's cut are in
the part. The cut is found by sums over ranges of hashes, finer each time.
Where it lies, some ``TAIL`` documents are taken one by one while they fit, so a
long one doesn't leave room behind: what is left is less than each of ``TAIL``
documents left out, or nothing else fits. Rows that repeat key, text and source
are one item of so many copies, so no order spans a source or a group of copies.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, bits by which a range of hashes is divided at once, items at a cut, copies made of an item at once.
BITS, FAN, TAIL, CHUNK = 60, 12, 1024, 1 << 16
#: Most rows of a few numbers that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def place(key: Column, tag: Column, seed: int) -> Column:
    """BITS bits of md5 of key, text and seed."""
    name = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), tag.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def _few(df: DataFrame) -> DataFrame:
    """df, staged, to be broadcast where its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def items(docs: DataFrame, seed: int, text: str, key: str, source: str) -> DataFrame:
    """id, source, tag, size, k (rows alike) and h."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), text_tag(F.col(text)).alias("tag"))
    alike = rows.groupBy("id", "source", "size", "tag").agg(F.count("*").alias("k"))
    return alike.withColumn("h", place(F.col("id"), F.col("tag"), seed))


def _running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the sums over all rows before in that order: inside range partitions, and of those before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.Scratch(df.sparkSession, "running").stage(df.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()), "dealt")
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    inside = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums_ = dealt.groupBy("p").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    bases = sums_.select("p", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_base") for n in sums))
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items())).join(F.broadcast(bases), "p")
    return out.withColumns({n: F.col(n) + F.col(f"{n}_base") for n in sums}).drop("p", *(f"{n}_base" for n in sums))


def targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Adds rank, weight and target to (source, source_size).

    Sources rank by code point, null last. Those with the least room for their
    weight are clamped first: in that order the level of the rest follows from
    sums of integers before each source.
    """
    scratch = common.Scratch(sources.sparkSession, "targets")
    at = F.array(*(F.lit(w) for w in weights))
    ranked = _running(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1).cast("long"))
    ranked = ranked.withColumns({"weight": F.get(at, F.pmod("rank", F.lit(len(weights))).cast("int")).cast("long"), "cap": F.col("source_size") * max_epochs})
    ranked = scratch.stage(ranked, "ranked")
    all_ = ranked.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    if not all_["w"]:
        return ranked.drop("cap").withColumn("target", F.lit(0.0))
    before = _running(ranked, [F.col("cap") / F.col("weight"), F.col("rank")], caps=F.col("cap"), ws=F.col("weight"))
    # a literal is an integer where it fits one, so it is widened before it is multiplied
    level = (F.lit(all_["all"]).cast("long") * share[0] - F.col("caps") * share[1]) / ((F.lit(all_["w"]).cast("long") - F.col("ws")) * share[1])
    found = before.where(F.col("weight") * level <= F.col("cap")).agg(F.min(F.struct("caps", "ws")).alias("x")).first()["x"]
    target = F.col("cap").cast("double")
    if found is not None:
        level = (all_["all"] * share[0] - found["caps"] * share[1]) / ((all_["w"] - found["ws"]) * share[1])
        target = F.least(target, F.col("weight") * F.lit(float(level)))
    return ranked.withColumn("target", target).drop("cap")


def _sources(listed: DataFrame, weights, share, max_epochs, scratch: common.Scratch) -> DataFrame:
    """Per source: source_size, target, whole (repetitions of all), cut and end (hashes before and from which items are in and out) and room at the cut."""
    sums = listed.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("k")).alias("source_size"))
    aims = targets(sums, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("whole", whole).withColumn("room", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    aims = scratch.stage(aims.withColumn("cut", F.lit(0).cast("long")), "sources")
    most = aims.agg(F.max("n")).first()[0] or 0
    shift = BITS
    while most > TAIL and shift >= FAN:
        above, shift, most = shift, shift - FAN, most >> FAN
        state = _few(aims.select(F.col("source").alias("s"), "room", "cut"))
        inside = listed.join(state, F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", above) == F.shiftright("cut", above))
        steps = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum(F.col("size") * F.col("k")).alias("sum"), F.first("room").alias("room"))
        order = Window.partitionBy("source").orderBy("b")  # at most 2 ** FAN rows
        over = steps.withColumn("upto", F.sum("sum").over(order)).where("upto > room").groupBy("source").agg(F.min(F.struct("b", (F.col("room") - F.col("upto") + F.col("sum")).alias("left"))).alias("x"))
        over = over.select(F.col("source").alias("s"), F.col("x.b").alias("b"), F.col("x.left").alias("left"))
        finer = aims.join(over, F.col("source").eqNullSafe(F.col("s")), "left")
        finer = finer.withColumns({"cut": F.when(F.col("b").isNull(), F.col("cut")).otherwise(F.shiftleft("b", shift)), "room": F.coalesce("left", "room")})
        after = scratch.stage(finer.drop("s", "b", "left"), "sources")
        scratch.drop(aims)
        aims = after
    wide = F.ceil(F.lit(float(2 * TAIL)) / F.col("n") * F.lit(float(1 << BITS)))
    return scratch.stage(aims.withColumn("end", F.when(F.col("n") <= 2 * TAIL, F.lit(1 << BITS)).otherwise(F.least(F.col("cut") + wide, F.lit(1 << BITS))).cast("long")).drop("n"), "sources")


def _tail(listed: DataFrame, aims: DataFrame, scratch: common.Scratch) -> DataFrame:
    """s, i, t (source, id and tag) and extra (copies taken) of the items at the cut, as far as any are; about 2 * TAIL of a source are looked at."""
    state = _few(aims.select(F.col("source").alias("s"), "room", "cut", "end"))
    near = listed.join(state, F.col("source").eqNullSafe(F.col("s"))).where("h >= cut and h < end and size > 0 and size <= room")
    rows = near.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("h", "id", "tag", "size", "k"))).alias("rows"), F.first("room").alias("room"))
    start = F.struct(F.col("room").alias("left"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def step(acc: Column, row: Column) -> Column:
        extra = F.least(row["k"], F.floor(acc["left"] / row["size"]))
        return F.struct((acc["left"] - extra * row["size"]).alias("left"), F.concat(acc["taken"], F.array(extra)).alias("taken"))

    taken = rows.withColumn("taken", F.aggregate("rows", start, step)["taken"]).select("source", F.explode(F.arrays_zip("rows", "taken")).alias("z"))
    return scratch.stage(taken.where("z.taken > 0").select(F.col("source").alias("s"), F.col("z.rows.id").alias("i"), F.col("z.rows.tag").alias("t"), F.col("z.rows.k").alias("of"), F.col("z.taken").alias("extra")), "tail")


def _same(*names: tuple[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in names))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row of docs: key, source, size, source_size, target, copies (times the mix takes it) and taken (words).

    Null or empty texts have size 0 and are taken as often as all of their
    source are; null sources are one source, ranked last. Rows that repeat key,
    text and source are interchangeable. Sources without words have target 0.
    Reruns over the same rows agree. An empty table gives no rows.
    """
    scratch = common.Scratch(docs.sparkSession, "mixing")
    listed = scratch.stage(items(docs, seed, text, key, source), "items")
    aims = _sources(listed, weights, share, max_epochs, scratch)
    tail = _few(_tail(listed, aims, scratch))
    per = listed.join(_few(aims.withColumnRenamed("source", "x")), F.col("source").eqNullSafe(F.col("x")))
    per = per.join(tail, _same(("source", "s"), ("id", "i"), ("tag", "t")), "left")
    per = per.withColumn("extra", F.when((F.col("h") < F.col("cut")) & (F.col("size") > 0), F.col("k")).otherwise(F.coalesce("extra", F.lit(0))))
    per = per.select("id", "source", "size", "source_size", "target", "whole", "extra", "k", "h")
    # a row for each copy; many copies of one item are dealt to tasks first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda a, b: F.explode(F.sequence(a, b))
    chunks = per.where(F.col("k") > CHUNK).withColumn("c", number(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK))).repartition(parts, "h", "c")
    many = chunks.withColumn("j", number(F.col("c") * CHUNK, F.least(F.col("c") * CHUNK + CHUNK, F.col("k")) - 1)).drop("c")
    each = per.where(F.col("k") <= CHUNK).withColumn("j", number(F.lit(0).cast("long"), F.col("k") - 1)).unionByName(many)
    out = each.withColumn("copies", (F.col("whole") + (F.col("j") < F.col("extra")).cast("long")).cast("int"))
    return out.select(F.col("id").alias(key), F.col("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as many times as the mix takes it, with the columns of docs.

    Cuts of sources and items at cuts go to the documents, so no text is
    shuffled. Rows of an item of which only a part is taken are staged with
    numbers first.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "mixed")
    listed = scratch.stage(items(docs, seed, text, key, source), "items")
    aims = _sources(listed, weights, share, max_epochs, scratch)
    tail = _tail(listed, aims, scratch)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), text_tag(F.col(text)).alias("tag"), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("worded"))
    rows = rows.join(_few(aims.select(F.col("source").alias("x"), "whole", "cut")), F.col("source").eqNullSafe(F.col("x"))).drop("x")
    rows = rows.join(_few(tail), _same(("source", "s"), ("id", "i"), ("tag", "t")), "left")
    before = (place(F.col("id"), F.col("tag"), seed) < F.col("cut")) & F.col("worded")
    extra = F.when(before | (F.col("extra") == F.col("of")), F.lit(1)).otherwise(F.lit(0))
    apart = F.coalesce(F.col("extra") < F.col("of"), F.lit(False))
    out = rows.where(~apart).select("row", (F.col("whole") + extra).alias("copies"))
    if tail.where("extra < of").limit(1).count():
        some = scratch.stage(rows.where(apart).select("row", "id", "source", "tag", "whole", "extra", F.monotonically_increasing_id().alias("u")), "parts")
        # of an item's rows the first by number: whole partitions, then those of one partition
        name = ["source", "id", "tag"]
        order = Window.partitionBy(*name).orderBy("p")
        counts = some.groupBy(*name, F.shiftright("u", 33).alias("p")).agg(F.count("*").alias("n"), F.first("extra").alias("extra")).withColumn("left", F.col("extra") - F.sum("n").over(order) + F.col("n"))
        edge = counts.where("left >= 0 and left < n").select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("tag").alias("t"), F.col("p").alias("q"), "left")
        at_edge = some.select(*name, "u").join(_few(edge), _same(("source", "s"), ("id", "i"), ("tag", "t")) & (F.shiftright("u", 33) == F.col("q")))
        bound = at_edge.withColumn("r", F.row_number().over(Window.partitionBy(*name).orderBy("u"))).where("r = left + 1").select("s", "i", "t", F.col("u").alias("bound"))
        bound = scratch.stage(bound, "bounds")
        taken = some.join(_few(bound), _same(("source", "s"), ("id", "i"), ("tag", "t")))
        out = out.unionByName(taken.select("row", (F.col("whole") + (F.col("u") < F.col("bound")).cast("long")).alias("copies")))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")
