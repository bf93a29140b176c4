"""Near-duplicate components by a Jaccard join on word shingles with token-combination prefixes.

Tokens are hashed shingles, ordered by document frequency, then value. A set of
n that links with one of its size or smaller shares at least a = t * n tokens
with it, one that links with a larger set at least b = 2t / (1 + t) * n. So its
first n - a + k tokens share k with those of any partner, and of a pair the
smaller set needs only its first n - b + k: these are the rows that may lead.
Rare tokens are indexed one by one. Where the prefix reaches frequent ones, it
is extended to share k = g + 1 of them, which are dealt to g groups by hash, and
the pairs inside each group are indexed: two of k shared tokens meet in one
group. g grows with the class of sizes, so keys stay in proportion to a prefix.

1. Blocks send (token fingerprint, set) packed by bucket; buckets find document
   frequencies and return the tokens of more than one set.
2. Blocks choose prefixes and emit index rows. Of keys with the same sets one stays.
3. Rounds verify: in each key a hub meets all sets of a near size class and of
   another component, with bounds by size, prefix position and bitmaps before
   whole sets are compared exactly. While many links come to light, one set of
   a key is its hub and leaves it. In the last round all sets outside a key's
   largest component are hubs. Members of one component need no comparison.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected

WORDS = 5
#: Frequent tokens are in more sets than RARE; about GROUP prefix tokens of the smallest set of a class share a hash group.
RARE, GROUP = 16, 2
BLOCK_BYTES, SLICE = 8 << 20, 512 << 10
#: Bytes of a word that are hashed as they are.
PLAIN = 16
#: Text bytes by which buckets and their partitions are counted.
BUCKET_BYTES, PART_BYTES = 8 << 20, 16 << 20
#: Words of 64 bits in a set's parity bitmap: sets differ by at least as many tokens as their bitmaps by bits.
BITMAP = 16
#: Most rows (of two longs) that are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1 << 20
#: Pairs for each index row at which the last round may come, and rows for each link found at which it comes anyway.
MORE = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, mixed from its length and its bytes; of a word of more than PLAIN bytes, from XXH3-128 of them."""
    size = end - start
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(PLAIN, np.uint8)), PLAIN)[start]
    rows[np.arange(PLAIN) >= size[:, None]] = 0
    low, high = rows.view("<u8").reshape(-1, 2).T.astype(np.uint64)
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > PLAIN).tolist():
        digest = xxhash.xxh3_128_intdigest(raw[start[i] : end[i]])
        low[i], high[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    n = common.mix64(size.astype(np.uint64) + _MIX[0])
    return common.mix64(low ^ common.mix64(high ^ n)), common.mix64(high + _MIX[1] * common.mix64(low + _MIX[2] * n))


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, 64-bit hash, another one) of the distinct shingles of texts side by side, by document, then hash.

    A-Z count as a-z; words are what stands between bytes 32 and 9 to 13.
    Fewer words than ``words`` are one shingle.
    """
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.r_[False, solid[:-1]] if len(solid) else solid
    first = before.copy()
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = False
    start = np.flatnonzero(solid & ~first)
    after = np.r_[solid[1:], False] if len(solid) else solid
    last = after.copy()
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = False
    end = np.flatnonzero(solid & ~last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    count = np.bincount(doc, minlength=len(off) - 1)
    at = np.r_[0, np.cumsum(count)]
    m = len(doc) - words + 1
    whole = doc[:m] == doc[words - 1 :] if m > 0 else np.zeros(0, bool)
    short = [(n, np.flatnonzero(count == n)) for n in range(1, words)]
    hashes = []
    for word, factor in zip(word_hashes(low, start, end), (_MIX, _MIX[::-1] * _MIX), strict=True):
        parts = []
        if m > 0:
            h = sum((word[i : m + i] * factor[i % 5] * np.uint64(2 * (i // 5) + 1) for i in range(1, words)), word[:m] * factor[0])
            parts.append(common.mix64(h[whole]))
        for n, d in short:
            h = np.full(len(d), n, np.uint64)
            for i in range(n):
                h = common.mix64(h * factor[0] + word[at[d] + i])
            parts.append(common.mix64(h ^ factor[4]))
        hashes.append(np.concatenate(parts))
    d = np.concatenate([*([doc[:m][whole]] if m > 0 else []), *(x for _, x in short)])
    s = np.lexsort((hashes[0], d))
    d, h, other = d[s], hashes[0][s], hashes[1][s]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new], other[new]


def set_names(d: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a name of each document's set, two longs of a hash each; equal sets have equal names, empty ones 0."""
    n = np.bincount(d, minlength=docs)
    at = np.r_[0, np.cumsum(n)]
    halves = []
    for seed, h in zip((1, 3), hashes, strict=True):
        total = np.r_[np.uint64(0), np.cumsum(common.mix64(h ^ _MIX[seed]))]
        half = common.mix64((total[at[1:]] - total[at[:-1]]) + n.astype(np.uint64) * _MIX[2])
        halves.append(np.where(n > 0, half, np.uint64(0)).view(np.int64))
    return n, np.stack(halves, 1)


def bitmaps(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Parity bitmaps of sets side by side; h[at[i]:at[i + 1]] are the tokens of set i."""
    bit = (common.mix64(h ^ _MIX[4]) >> np.uint64(40)) % np.uint64(64 * BITMAP)
    out = np.zeros((len(at) - 1, BITMAP), np.uint64)
    run = np.zeros(len(h) + 1, np.uint64)
    for w in range(BITMAP):
        here = (bit >> np.uint64(6)) == w
        run[1:] = np.bitwise_xor.accumulate(np.where(here, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)))
        out[:, w] = run[at[1:]] ^ run[at[:-1]]
    return out


def text_tag(text: Column) -> Column:
    """A hash of a text, which tells rows apart that share a key."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def size_classes(most: int, percent: int) -> np.ndarray:
    """First sizes of the classes up to that of most and the one beyond: sets that link are of one class or of neighbours."""
    first = [1, 100 // percent + 1]
    while first[-1] <= most:
        first.append(100 * first[-1] // percent + 1)
    return np.array([*first, 100 * first[-1] // percent + 1], np.int64)


def hash_groups(first: np.ndarray, percent: int) -> np.ndarray:
    """Groups of each class, powers of two, so that pairs of a class are pairs of smaller ones, too. 0: sets may share one token only."""
    want = np.maximum(first * (100 - percent) // (100 * GROUP), 1)
    least = -(-percent * first // 100) - 1
    return np.where(least < 1, 0, 2 ** np.floor(np.log2(np.maximum(np.minimum(want, least), 1))).astype(np.int64))


def prefix_keys(token: np.ndarray, df: np.ndarray, at: np.ndarray, n: np.ndarray, distinct: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(set, key, whether it leads there, tokens before it) of the index rows of sets side by side.

    token, df: those that other sets have too, at[i]:at[i + 1] of set i; n:
    sizes; distinct: of fingerprints.
    """
    count, lost = np.diff(at), n - distinct
    first = size_classes(int(n.max(initial=1)), percent)
    groups = hash_groups(first, percent)
    cls = np.searchsorted(first, n, "right") - 1
    g, k = groups[cls], np.maximum(groups[cls + 1], 1) + 1
    need = np.maximum(-(-percent * n // 100) - lost, 1)
    lead = np.maximum(-(-2 * percent * n // (100 + percent)) - lost, 1)
    if ((need <= g) & (lost > 0) & (count > 0)).any():
        raise ValueError("too many equal fingerprints in one set")
    owner = np.repeat(np.arange(len(n)), count)
    s = np.lexsort((token, df, owner))
    token, rare = token[s], df[s] <= RARE
    place = np.arange(len(s)) - at[:-1][owner]
    one = count - need + 1  # tokens that share one with any partner
    many = np.where(one > 0, np.minimum(count - need + k, count), 0)
    rares = np.bincount(owner[rare], minlength=len(n))
    most = np.where(one > rares, many, one)
    leads = np.where(count - lead + 1 > 0, count - lead + k, 0)
    some = place < most[owner]
    single = np.flatnonzero(some & (rare | (g == 0)[owner]))
    value = common.mix64(token.astype(np.uint64) ^ _MIX[3])
    out = [(owner[single], value[single], place[single] < leads[owner[single]], place[single])]
    rest = np.flatnonzero(some & ~rare)
    home = (value[rest] >> np.uint64(32)).astype(np.int64) & (np.maximum(g[owner[rest]], 1) - 1)
    rest = rest[np.lexsort((value[rest], home, owner[rest]))]
    home = (value[rest] >> np.uint64(32)).astype(np.int64) & (np.maximum(g[owner[rest]], 1) - 1)
    step = 1
    while step < len(rest):
        i = np.flatnonzero((owner[rest[step:]] == owner[rest[:-step]]) & (home[step:] == home[:-step]))
        if not len(i):
            break
        a, b = rest[i], rest[i + step]
        out.append((owner[a], common.mix64(value[a] * _MIX[0] + value[b] * _MIX[1]), np.maximum(place[a], place[b]) < leads[owner[a]], np.minimum(place[a], place[b])))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast where its rows are few enough; it should be staged."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75, words: int = WORDS) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id, text_tag.

    Documents link when 100 * shared >= percent * united shingles; component_id
    is the smallest key reachable by links, itself included. Null and empty
    texts, and those without words, have no shingles and are alone. A null key
    takes part but never names a component; a component of null keys only has a
    null id. Rows that repeat a key are documents of their own. Other columns
    aren't looked at. Shingles are compared by 64 bits and equal sets found by
    128 bits of hashes that are mixed from whole words; nothing else is inexact.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "jaccard-join")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), text_tag(F.col(text)).alias("tag"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 256
    while buckets < size // BUCKET_BYTES:
        buckets *= 2
    parts = min(buckets, 8 + size // PART_BYTES)
    kind = "bucket int, block long, data binary"

    def cut(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        ids, null, tags, sizes, names, parity, owner, token, held, docs_ = [], [], [], [], [], [], [], [], 0, 0

        def flush():
            name, n = np.concatenate(names), np.concatenate(sizes)
            d, h = np.concatenate(owner), np.concatenate(token)
            nodes, first, inverse = np.unique(name, axis=0, return_index=True, return_inverse=True)
            lead = np.zeros(len(name), bool)
            lead[first] = True
            bits = np.concatenate(parity)[first]
            keep = lead[d]
            d, h = inverse[d[keep]].astype(np.uint32), h[keep]
            fp = (h >> np.uint64(32)).astype(np.uint32)
            home = (h & np.uint64(buckets - 1)).astype(np.uint32)
            del h, keep
            s = np.lexsort((d, fp, home))
            d, fp, home = d[s], fp[s], home[s]
            del s
            once = np.ones(len(d), bool)
            once[1:] = (d[1:] != d[:-1]) | (fp[1:] != fp[:-1]) | (home[1:] != home[:-1])
            d, fp, home = d[once], fp[once], home[once]
            at = part << 24 | block
            # heads go to all buckets in turn: blocks of one task to distant ones, those of the next task beside them
            out = [((part + 61 * block) % buckets, at, b"h" + common.pack(np.concatenate(ids), np.concatenate(null).astype(np.uint8), np.concatenate(tags), inverse.astype(np.uint32), nodes.reshape(-1), n[first], np.bincount(d, minlength=len(nodes)), bits.reshape(-1)))]
            cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]) if len(home) else np.zeros(1, np.int64)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(home[i]), at, b"t" + common.pack(np.diff(fp[i:j], prepend=np.uint32(0)), d[i:j])))
            return common.blobs(out)

        for batch in batches:
            values, missing = common.long_column(batch.column(0))
            data, off = common.text_buffers(batch.column(1))
            tag = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in common.slices(off, SLICE):
                d, h, other = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n, name = set_names(d, (h, other), j - i)
                ids.append(values[i:j])
                tags.append(tag[i:j])
                null.append(missing[i:j])
                sizes.append(n)
                names.append(name)
                parity.append(bitmaps(np.r_[0, np.cumsum(n)], h))
                owner.append((d + docs_).astype(np.uint32))
                token.append(h)
                docs_ += j - i
                held += int(off[j] - off[i])
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, null, tags, sizes, names, parity, owner, token, held, docs_, block = [], [], [], [], [], [], [], [], 0, 0, block + 1
                    pa.default_memory_pool().release_unused()
        if docs_:
            yield flush()

    def frequencies(frame: pa.Table) -> pa.Table:
        bucket, block, data = (frame.column(c).to_pylist() for c in ("bucket", "block", "data"))
        out = [x for x in zip(bucket, block, data, strict=True) if x[2][:1] == b"h"]
        blocks = [b for b, x in zip(block, data, strict=True) if x[:1] == b"t"]
        if blocks:
            found = [common.unpack(x[1:]) for x in data if x[:1] == b"t"]
            fp = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in found])
            node = np.concatenate([x[1] for x in found])
            source = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x[0]) for x in found])
            s = np.argsort(fp, kind="stable")
            fp, node, source = fp[s], node[s], source[s]
            first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])
            df = np.repeat(np.diff(np.r_[first, len(fp)]), np.diff(np.r_[first, len(fp)]))
            keep = df > 1
            fp, node, source, df = fp[keep], node[keep], source[keep], df[keep].astype(np.uint32)
            s = np.argsort(source, kind="stable")
            fp, node, source, df = fp[s], node[s], source[s], df[s]
            for b in np.unique(source):
                i, j = np.searchsorted(source, [b, b + 1])
                out.append((bucket[0], blocks[b], b"t" + common.pack(np.array([bucket[0]]), fp[i:j], node[i:j], df[i:j])))
        return pa.Table.from_batches([common.blobs(out)])

    words_ = [f"b{w}" for w in range(BITMAP)]
    index_kind = "kind string, id long, tag long, hi long, lo long, n int, most int, key long, lead boolean, before int, " + ", ".join(f"{w} long" for w in words_)
    names_ = [c.split()[0] for c in index_kind.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds_ = [types[c.split()[1]] for c in index_kind.split(", ")]

    def prefixes(frame: pa.Table) -> pa.Table:
        data = frame.column("data").to_pylist()
        ids, null, tags, own, nodes, n, distinct, bits = common.unpack(next(x for x in data if x[:1] == b"h")[1:])
        nodes, bits = nodes.reshape(-1, 2), bits.view(np.int64).reshape(-1, BITMAP)

        def table(kind: str, count: int, **given) -> pa.Table:
            given = {"kind": np.full(count, kind)} | given
            return pa.table([pa.array(given[c], t) if c in given else pa.nulls(count, t) for c, t in zip(names_, kinds_, strict=True)], names=names_)

        out = [table("document", len(ids), id=pa.array(ids, mask=null.astype(bool)), tag=tags, hi=nodes[own, 0], lo=nodes[own, 1], n=n[own])]
        found = [common.unpack(x[1:]) for x in data if x[:1] == b"t"]
        if found:
            token = np.concatenate([x[1].astype(np.uint64) | x[0].astype(np.uint64) << np.uint64(32) for x in found])
            node, df = (np.concatenate([x[c] for x in found]) for c in (2, 3))
            s = np.argsort(node, kind="stable")
            token, df = token[s], df[s]
            at = np.searchsorted(node[s], np.arange(len(nodes) + 1))
            own, keys, lead, before = prefix_keys(token, df, at, n, distinct, percent)
            out.append(table("key", len(keys), hi=nodes[own, 0], lo=nodes[own, 1], key=keys.view(np.int64), lead=lead, before=before))
            own = np.unique(own)
            # tokens that other sets have too, and those lost to equal fingerprints: no partner shares more
            most = np.diff(at) + n - distinct
            out.append(table("set", len(own), hi=nodes[own, 0], lo=nodes[own, 1], n=n[own], most=most[own], **{w: bits[own, i] for i, w in enumerate(words_)}))
        return pa.concat_tables(out)

    dealt = common.deal(rows.mapInArrow(cut, kind), buckets, parts).groupBy("bucket").applyInArrow(frequencies, kind)
    found = scratch.stage(dealt.repartition(parts, "block").groupBy("block").applyInArrow(prefixes, index_kind), "prefixes")
    documents = found.where("kind = 'document'").select("id", "tag", "hi", "lo", "n")

    # copies of a set send its keys from several blocks; of keys with the same sets in the same roles one is enough
    index = found.where("kind = 'key'").groupBy("key", "hi", "lo").agg(F.max("lead").alias("lead"), F.max("before").alias("before"))
    alike = [F.bit_xor(F.xxhash64("hi", "lo", "lead", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    shared = index.groupBy("key").agg(F.count("*").alias("m"), F.max("lead").alias("some"), *alike).where("m > 1 and some")
    shared = shared.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    slim = scratch.stage(index.join(shared, "key"), "index")
    per_set = ["n", "most", *words_]
    sets_ = found.where("kind = 'set'").groupBy("hi", "lo").agg(*(F.max(c).alias(c) for c in per_set)).join(slim.select("hi", "lo").distinct(), ["hi", "lo"])
    first = documents.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.min(F.struct(F.coalesce("id", F.lit(-(2**63))).alias("i"), "tag")).alias("row"))
    # sets are numbered in order of their least keys, null ones last: a component is named by its least number
    numbered = sets_.join(first, ["hi", "lo"]).repartitionByRange(parts, F.col("rep").asc_nulls_last(), "hi", "lo").sortWithinPartitions(F.col("rep").asc_nulls_last(), "hi", "lo")
    numbered = scratch.stage(numbered.withColumn("node", F.monotonically_increasing_id()), "sets")
    cls = size_classes(int(numbered.agg(F.max("n")).first()[0] or 1), percent)
    sizes_ = F.array(*(F.lit(int(x)) for x in cls))
    class_ = F.size(F.filter(sizes_, lambda x: x <= F.col("n")))
    group = scratch.stage(slim.join(numbered.select("hi", "lo", "node", *per_set, class_.alias("class")), ["hi", "lo"]).drop("hi", "lo"), "group")
    scratch.drop(slim)

    def tokens(batches):
        for batch in batches:
            data, off = common.text_buffers(batch.column(1))
            for i, j in common.slices(off, SLICE):
                d, h, _ = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(d, minlength=j - i))].astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["node", "tokens"])

    wanted = _few(numbered.select(F.col("row.i").alias("id"), F.col("row.tag").alias("tag"), "node"))
    texts = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("id"), "tag", "text").join(wanted, ["id", "tag"]).select("node", "text")
    whole = texts.mapInArrow(tokens, "node long, tokens array<bigint>")
    whole = scratch.stage(whole.groupBy("node").agg(F.any_value("tokens").alias("tokens")), "tokens")

    comp, found_, last = scratch.stage(numbered.select("node", F.col("node").alias("comp")), "components"), None, False
    while not last:
        now = group.join(comp, "node")
        lead = F.min(F.when(F.col("lead"), F.struct(F.xxhash64("node"), "node"))).alias("one")
        each = now.groupBy("key", "comp").agg(F.count("*").alias("c"), lead).groupBy("key")
        live = each.agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("main"), F.min("one").alias("one")).where("m > main.c and one is not null")
        live = scratch.stage(live.select("key", "m", F.col("main.c").alias("c"), F.col("main.comp").alias("main"), F.col("one.node").alias("one")), "live")
        work = live.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * (F.col("m") - F.col("c"))).alias("pairs")).first()
        if not work["rows"]:
            break
        last = work["pairs"] <= MORE * work["rows"] or found_ is not None and found_ * MORE < work["rows"]
        is_hub = F.col("comp") != F.col("main") if last else F.col("node") == F.col("one")
        now = scratch.stage(now.join(live, "key").withColumn("is_hub", is_hub).drop("one", "main", "m", "c"), "round")
        scratch.drop(group)
        columns = ("node", "n", "comp", "most", "lead", "before", *words_)
        meets = F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))).alias("class")
        hub = now.where("is_hub").select("key", *(F.col(c).alias(f"hub_{c}") for c in columns), meets)
        # what a pair can share at most: by size, by tokens that others have before and from the key on, by the bits in which the bitmaps differ
        both = F.col("n") + F.col("hub_n")
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"hub_{w}"))) for w in words_[1:]), F.bit_count(F.col(words_[0]).bitwiseXOR(F.col(f"hub_{words_[0]}"))))
        position = F.least("before", "hub_before") + F.least(F.col("most") - F.col("before"), F.col("hub_most") - F.col("hub_before"))
        alike = (F.col("comp") != F.col("hub_comp")) & (F.col("lead") | F.col("hub_lead")) & (~F.col("is_hub") | (F.col("node") < F.col("hub_node")))
        for most in (F.least("n", "hub_n"), position, F.floor((both - differ) / 2)):
            alike = alike & ((100 + percent) * most >= percent * both)
        pairs = now.join(hub, ["key", "class"]).where(alike).select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        left = whole.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
        right = whole.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
        shared_ = F.size(F.array_intersect("ta", "tb"))
        linked = pairs.join(right, "b").join(left, "a").where(100 * shared_ >= percent * (F.size("ta") + F.size("tb") - shared_))
        new = scratch.stage(linked.select("a", "b"), "linked")
        found_ = new.count()
        if found_:
            ends = new.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
            labels = connected(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
            merged = labels.select(F.col("node").alias("comp"), F.col("comp").alias("into"))
            after = scratch.stage(comp.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp")), "components")
            scratch.drop(comp, labels)
            comp = after
        group = scratch.stage(now.where("not is_hub").drop("is_hub", "comp"), "group") if not last else now
        scratch.drop(now, live)
    leads = numbered.select(F.col("node").alias("comp"), F.col("rep").alias("least"))
    known = numbered.select("hi", "lo", "node").join(comp, "node").join(leads, "comp").select("hi", "lo", "least")
    known = scratch.stage(known, "named")
    # staged, so that the last join alone reads the rows of a set that has many, and can be split
    least = documents.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("own")).join(known, ["hi", "lo"], "left").select("hi", "lo", F.when(F.col("least").isNull(), F.col("own")).otherwise(F.col("least")).alias("least"))
    named = documents.join(scratch.stage(least, "least"), ["hi", "lo"], "left")
    return named.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), F.col("tag").alias("text_tag"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each component, that of the smallest key; rows without shingles and without a key stay.

    Of rows that repeat key and text that with the least other columns (as
    JSON) stays. Any column names will do; none of the rows' columns is changed.
    """
    scratch = common.Scratch(docs.sparkSession, "one-of-each")
    found = scratch.stage(jaccard_components(docs, text, key, **how).where(F.col(key).isNotNull()).select(F.col(key).alias("k"), "component_id", F.col("text_tag").alias("t")), "found")
    gone = _few(scratch.stage(found.where("k <> component_id").select("k", "t").distinct(), "gone"))
    again = _few(scratch.stage(found.where("k = component_id").groupBy("k", "t").agg(F.count("*").alias("n")).where("n > 1").select("k", "t"), "again"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("long").alias("k"), text_tag(F.col(text)).alias("t"))
    rows = rows.join(gone, ["k", "t"], "left_anti")
    order = Window.partitionBy("k", "t").orderBy(F.to_json("row"))
    first = rows.join(again, ["k", "t"], "left_semi").withColumn("i", F.row_number().over(order)).where("i = 1")
    return rows.join(again, ["k", "t"], "left_anti").select("row").unionByName(first.select("row")).select("row.*")
