"""Exact removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of WINDOW bytes over it also starts earlier. Every
WINDOW-byte string holds an anchor: the position of its least hashed K-byte
gram, which depends on its bytes alone. So equal strings have their anchors at
the same place, and only suffixes at anchors need to be sorted, of these only
the ones whose gram occurs twice.

1. Each block finds its anchors. Anchors of a block with the same bytes all
   around (the reach of any window over them) are repeats of the first one and
   are marked at once; so one block sends a hot passage once. They are found by
   a hash and compared byte by byte.
2. Fingerprints of the anchors' grams go by bucket; those that occur twice come
   back as positions in documents.
3. Tasks cut the suffixes at these positions, sort them into runs and
   front-code them (common prefix length with the one before, then the rest).
4. Each bucket merges its runs with a loser tree over common prefix lengths,
   which never compares bytes that are known to agree. From the prefix lengths
   to the right, and those of the sorted left contexts, the equal windows of
   every shift follow; all but the earliest are marked.
5. Marked ranges meet their documents again, and what is left is hashed.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 40
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
SLICE = 1 << 20
#: Text bytes of a block and suffixes of a run.
BLOCK_BYTES, RUN = 32 << 20, 60_000
#: Text bytes by which buckets and the tasks for them are counted.
BUCKET_BYTES, PART_BYTES = 2 << 20, 16 << 20
#: Places whose bytes are compared at once.
ROWS = 1 << 13


class Roller:
    """Hashes of byte ranges by differences of prefix sums, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _P)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _PINV)])
        out = np.empty(n, np.uint64)
        out[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * self.down[a]

    def rows(self, matrix: np.ndarray, some: int = 4096) -> np.ndarray:
        """Hashes of whole rows, a few at a time."""
        n, width = matrix.shape
        out = np.empty(n, np.uint64)
        for i in range(0, n, some):
            part = np.ascontiguousarray(matrix[i : i + some])
            at = np.arange(len(part)) * width
            out[i : i + some] = self.ranges(self.sums(part.reshape(-1)), at, at + width)
        return out


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of that width."""
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(data: np.ndarray, off: np.ndarray, roller: Roller, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors of windows inside documents, their gram hashes, and the prefix sums."""
    sums = roller.sums(data)
    n, w = len(data), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    h = common.mix64((sums[k:] - sums[:-k]) * roller.down[: n - k + 1])
    order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = sliding(order, w, np.minimum)  # of the window that starts there
    inside = np.zeros(n + 1, np.int32)
    starts, ends = off[:-1], off[1:] - window + 1
    some = ends > starts
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some], -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    most = sliding(np.r_[np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32)], w, np.maximum)
    at = np.flatnonzero(most[: len(order)] == order)
    return at, h[at], sums


class Merge:
    """Loser tree over front-coded runs. Yields (run, index, common prefix length with the one before)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.text = [r[0] for r in runs]
        self.lcps = [r[1] for r in runs]

    @staticmethod
    def _common(a: bytes, b: bytes, known: int) -> int:
        x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
        return len(a) - -(-x.bit_length() // 8)

    def __iter__(self):
        text, lcps = self.text, self.lcps
        k = 1
        while k < len(text):
            k *= 2
        at, ends = [0] * k, [len(t) for t in text] + [0] * (k - len(text))
        prefix = [0] * k  # with the last one out, for the candidates that lost or won
        tree = [-1] * k

        def beats(a: int, b: int) -> tuple[int, int]:
            """Winner and loser; the loser's prefix becomes that with the winner. An ended run loses."""
            if at[a] >= ends[a]:
                return b, a
            if at[b] >= ends[b]:
                return a, b
            pa_, pb = prefix[a], prefix[b]
            if pa_ > pb:
                return a, b
            if pb > pa_:
                return b, a
            x, y = text[a][at[a]], text[b][at[b]]
            n = self._common(x, y, pa_)
            if n == len(x):
                a, b = (a, b) if a < b else (b, a)
            elif x[n] > y[n]:
                a, b = b, a
            prefix[b] = n
            return a, b

        def build(node: int) -> int:
            if node >= k:
                return node - k
            w, tree[node] = beats(build(2 * node), build(2 * node + 1))
            return w

        w = build(1)
        while at[w] < ends[w]:
            yield w, at[w], prefix[w]
            at[w] += 1
            if at[w] < ends[w]:
                prefix[w] = lcps[w][at[w]]
            node = (w + k) >> 1
            while node:
                w, tree[node] = beats(w, tree[node])
                node >>= 1


def dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys in turn, equal where all keys are."""
    s = np.lexsort(keys[::-1])
    step = np.zeros(len(s), bool)
    for k in keys:
        step[1:] |= k[s][1:] != k[s][:-1]
    out = np.empty(len(s), np.int64)
    out[s] = np.cumsum(step)
    return out


def repeats(code: np.ndarray, rank: np.ndarray, place: np.ndarray, equal) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first of each code by rank and place, and of those after it; the same place again is neither.

    equal(some, others) compares the bytes that codes are hashes of. What has
    the code of a first one but other bytes is no repeat and counts as a first one.
    """
    s = np.lexsort((place, rank, code))
    first = np.r_[True, code[s][1:] != code[s][:-1]][: len(s)]
    lead = s[np.flatnonzero(first)][np.cumsum(first) - 1] if len(s) else s
    later = (rank[s] != rank[lead]) | (place[s] != place[lead])
    same = np.concatenate([np.zeros(0, bool), *(equal(s[later][i : i + ROWS], lead[later][i : i + ROWS]) for i in range(0, int(later.sum()), ROWS))])
    return np.append(s[first], s[later][~same]), s[later][same]


def equal_bytes(data: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a[x] and a[y] on, size[x] of them, are equal and as many."""
    ahead = np.arange(int(size[x].max(initial=0)))
    last = len(data) - 1
    same = (data[np.minimum(a[x][:, None] + ahead, last)] == data[np.minimum(a[y][:, None] + ahead, last)]) | (ahead >= size[x][:, None])
    return same.all(1) & (size[x] == size[y])


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix lengths of sorted fixed-width rows with the row before, and the remaining bytes."""
    n, width = rows.shape
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(n, np.uint8)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return lcp, rows[np.arange(width) >= lcp[:, None]]


def decoded(lcp: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, before, at = [], b"", 0
    for n in lcp.tolist():
        before = before[:n] + rest[at : at + width - n]
        at += width - n
        out.append(before)
    return out


def equal_windows(right: np.ndarray, left: np.ndarray, ahead: np.ndarray, behind: np.ndarray, age: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order of their right sides: the least and greatest shift d whose window (d bytes before the anchor) also starts earlier; reach + 1 and -1 if none.

    right: prefix lengths with the suffix before. left: left contexts read
    backwards. ahead, behind: bytes there are on either side. age: rank by place,
    equal for one place that was given twice.
    """
    n = len(right)
    low, high = np.full(n, reach + 1), np.full(n, -1)
    order = np.argsort(left.view(f"S{reach}").reshape(-1), kind="stable") if n else np.zeros(0, np.int64)
    backward = np.zeros(n, np.int64)
    lcp, _ = front_coded(left[order]) if n else (np.zeros(0, np.uint8), None)
    for d in range(reach + 1):
        ok = np.flatnonzero((behind >= d) & (ahead >= window - d))
        if len(ok) < 2:
            continue
        backward[order] = np.cumsum(lcp < d)
        code = backward * n + np.cumsum(right < window - d)
        s = ok[np.lexsort((age[ok], code[ok]))]
        first = np.r_[True, code[s][1:] != code[s][:-1]]
        eldest = age[s][np.flatnonzero(first)][np.cumsum(first) - 1]
        later = s[age[s] > eldest]
        low[later] = np.minimum(low[later], d)
        high[later] = np.maximum(high[later], d)
    return low, high


def removed_ranges(docs: DataFrame, window: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, tag, doc_id, text) of docs and the marked (id, tag, starts, ends) of each, as packed bytes, in no order."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "suffix-dedup")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("tag"), "doc_id", "text")
    reach = window - K
    size, buckets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 256
    while buckets < size // BUCKET_BYTES:
        buckets *= 2
    parts = min(buckets, 8 + size // PART_BYTES)
    kind = "bucket int, block long, data binary"
    marks_kind = "id long, tag long, starts binary, ends binary"

    def find(batches):
        from pyspark import TaskContext

        roller, part, block = Roller(), TaskContext.get().partitionId(), 0
        ids, tags, lens, place, gram, around, begin, texts, held = [], [], [], [], [], [], [], [], 0

        def flush():
            id_, tag, n = np.concatenate(ids), np.concatenate(tags), np.concatenate(lens)
            start = np.r_[0, np.cumsum(n)]
            p, g, c = np.concatenate(place), np.concatenate(gram), np.concatenate(around)
            rank = dense_rank(id_, tag)
            d = np.searchsorted(start, p, "right") - 1
            whole, left = np.concatenate(texts), np.concatenate(begin)
            right = np.minimum(p + window, start[d + 1])
            once, again = repeats(c, rank[d], p - start[d], lambda x, y: equal_bytes(whole, left, x, y, right - left) & (p[x] - left[x] == p[y] - left[y]))
            again, s = np.sort(again), once
            name = part << 24 | block
            a = p[again] - start[d[again]]  # of the anchor in its document
            end = n[d[again]] - a
            out = [(-1, name, common.pack(id_, tag, start)), (-2, name, common.pack(d[again].astype(np.uint32), a - np.minimum(a, reach), a - np.maximum(window - end, 0) + window))]
            g, p = g[s], p[s]
            home = (g & np.uint64(buckets - 1)).astype(np.int64)
            g = (g >> np.uint64(32)).astype(np.uint32)
            s = np.lexsort((g, home))
            cuts = np.searchsorted(home[s], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                x = s[cuts[b] : cuts[b + 1]]
                if len(x):
                    out.append((b, name, common.pack(np.diff(g[x], prepend=np.uint32(0)), p[x].astype(np.uint32))))
            return common.blobs(out)

        for batch in batches:
            i0, t0 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, off = common.text_buffers(batch.column(2))
            for i, j in common.slices(off, SLICE):
                x, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                p, h, sums = anchors(x, at, roller, window, K)
                d = np.searchsorted(at, p, "right") - 1
                a, b = np.maximum(p - reach, at[d]), np.minimum(p + window, at[d + 1])
                sides = ((p - a) << 32 | (b - p)).astype(np.uint64)
                around.append(common.mix64(roller.ranges(sums, a, b) + common.mix64(sides)))
                begin.append(a + held)
                texts.append(x)
                place.append(p + held)
                gram.append(h)
                ids.append(i0[i:j])
                tags.append(t0[i:j])
                lens.append(np.diff(at))
                held += len(x)
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, tags, lens, place, gram, around, begin, texts, held, block = [], [], [], [], [], [], [], [], 0, block + 1
        if ids:
            yield flush()

    found = scratch.stage(rows.where(F.octet_length("text") >= window).select("id", "tag", "text").mapInArrow(find, kind), "anchors")

    def twice(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [common.unpack(x) for x in frame["data"]]
        g = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts])
        source = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
        place = np.concatenate([x[1] for x in parts])
        s = np.argsort(g, kind="stable")
        same = g[s][1:] == g[s][:-1]
        keep = np.zeros(len(g), bool)
        keep[s[1:][same]] = keep[s[:-1][same]] = True
        blocks = frame["block"].to_numpy()
        out = [(0, int(blocks[b]), common.pack(place[keep & (source == b)])) for b in np.unique(source[keep])]
        return pd.DataFrame(out, columns=["bucket", "block", "data"])

    repeated = common.deal(found.where("bucket >= 0"), buckets, parts).groupBy("bucket").applyInPandas(twice, kind)

    def by_document(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[frame["bucket"] == -1]["data"].iloc[0]
        ids, tags, start = common.unpack(head)
        parts = [common.unpack(x)[0] for x in frame[frame["bucket"] >= 0]["data"]]
        p = np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)
        d = np.searchsorted(start, p, "right") - 1
        at, first = np.unique(d, return_index=True)
        places = np.split((p - start[d]).astype("<i4"), first[1:])
        return pd.DataFrame({"id": ids[at], "tag": tags[at], "places": [x.tobytes() for x in places[: len(at)]]})

    heads = found.where("bucket = -1")
    places = scratch.stage(heads.unionByName(repeated).groupBy("block").applyInPandas(by_document, "id long, tag long, places binary").dropDuplicates(["id", "tag"]), "places")

    def mark_rows(ids, tags, d, a, b):
        s = np.argsort(d, kind="stable")
        d, a, b = d[s], a[s], b[s]
        at, first = np.unique(d, return_index=True)
        cut = lambda x: [y.astype("<i4").tobytes() for y in np.split(x, first[1:])][: len(at)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(tags[at]), pa.array(cut(a), pa.binary()), pa.array(cut(b), pa.binary())], ["id", "tag", "starts", "ends"])

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        head = {b: d for b, d in zip(frame["bucket"], frame["data"], strict=True)}
        return pa.Table.from_batches(mark_rows(*common.unpack(head[-1])[:2], *common.unpack(head[-2]))).to_pandas()

    within = found.where("bucket < 0").groupBy("block").applyInPandas(local, marks_kind)

    def cut(batches):
        from pyspark import TaskContext

        roller, part, run = Roller(), TaskContext.get().partitionId(), 0
        held = []

        def flush():
            rows_, ahead, behind, ids, tags, place = (np.concatenate(x) for x in zip(*held, strict=True))
            sides = (ahead.astype(np.uint64) << np.uint64(8)) | behind
            digest = common.mix64(roller.rows(rows_) + common.mix64(sides))
            s, again = repeats(digest, dense_rank(ids, tags), place, lambda x, y: (rows_[x] == rows_[y]).all(1) & (ahead[x] == ahead[y]) & (behind[x] == behind[y]))
            out = []
            if len(again):
                p, b, a = place[again], behind[again].astype(np.int64), ahead[again].astype(np.int64)
                out.append((-1, part << 24 | run, common.pack(ids[again], tags[again], p - b, p - np.maximum(window - a, 0) + window)))
            right = rows_[s, reach:]
            g = common.mix64(roller.rows(right[:, :K]))
            home = (g & np.uint64(buckets - 1)).astype(np.int64)
            order = np.lexsort((np.argsort(np.argsort(np.ascontiguousarray(right).view(f"S{window}").reshape(-1), kind="stable")), home)) if len(s) else np.zeros(0, np.int64)
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                x = order[cuts[b] : cuts[b + 1]]
                if len(x):
                    lcp, rest = front_coded(right[x])
                    i = s[x]
                    out.append((b, part << 24 | run, common.pack(lcp, rest, rows_[i, :reach][:, ::-1].reshape(-1), ahead[i], behind[i], ids[i], tags[i], place[i].astype(np.int64))))
            return common.blobs(out)

        count = 0
        for batch in batches:
            i0, t0 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            data, off = common.text_buffers(batch.column(2))
            places_ = batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                p = np.frombuffer(places_[i], "<i4").astype(np.int64)
                n = int(off[i + 1] - off[i])
                wide = np.zeros(reach + n + window, np.uint8)
                wide[reach : reach + n] = data[off[i] : off[i + 1]]
                for q in range(0, len(p), RUN):
                    z = p[q : q + RUN]
                    rows_ = np.lib.stride_tricks.sliding_window_view(wide, reach + window)[z]
                    held.append((rows_, np.minimum(n - z, window).astype(np.uint8), np.minimum(z, reach).astype(np.uint8), np.full(len(z), i0[i]), np.full(len(z), t0[i]), z))
                    count += len(z)
                    if count >= RUN:
                        yield flush()
                        held, count, run = [], 0, run + 1
        if held:
            yield flush()

    # the bytes before a document's start and after its end are zeros here; ahead and behind tell them from zeros of the text
    runs = scratch.stage(rows.select("id", "tag", "text").join(places, ["id", "tag"]).select("id", "tag", "text", "places").mapInArrow(cut, kind), "runs")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [common.unpack(x) for x in frame["data"]]
        merged = list(Merge([(decoded(x[0], x[1].tobytes(), window), x[0].tolist()) for x in parts]))
        run, index, right = (np.array(x, np.int64) for x in zip(*merged, strict=True))
        at = np.r_[0, np.cumsum([len(x[0]) for x in parts])][run] + index
        left = np.concatenate([x[2].reshape(-1, reach) for x in parts])[at]
        ahead, behind, ids, tags, place = (np.concatenate([x[c] for x in parts])[at] for c in range(3, 8))
        age = dense_rank(ids, tags, place)
        low, high = equal_windows(right, np.ascontiguousarray(left), ahead.astype(np.int64), behind.astype(np.int64), age, window, reach)
        m = np.flatnonzero(high >= 0)
        return spans(ids[m], tags[m], place[m] - high[m], place[m] - low[m] + window)

    def spans(ids, tags, a, b) -> pd.DataFrame:
        s = np.lexsort((tags, ids))
        ids, tags, a, b = ids[s], tags[s], a[s], b[s]
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])][: len(ids)])
        part = lambda x: [y.astype("<i4").tobytes() for y in np.split(x, first[1:])][: len(first)]
        return pd.DataFrame({"id": ids[first], "tag": tags[first], "starts": part(a), "ends": part(b)})

    def repeated_in_run(frame: pd.DataFrame) -> pd.DataFrame:
        return spans(*(np.concatenate(x) for x in zip(*(common.unpack(x) for x in frame["data"]), strict=True)))

    marks = common.deal(runs.where("bucket >= 0"), buckets, parts).groupBy("bucket").applyInPandas(merge, marks_kind)
    again = runs.where("bucket < 0").groupBy("block").applyInPandas(repeated_in_run, marks_kind)
    everything = scratch.stage(marks.unionByName(again).unionByName(within), "marks")
    scratch.drop(found, places, runs)
    return rows, everything


def suffix_dedup(docs: DataFrame, window: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Null texts are empty; texts under ``window`` bytes stay whole. Earlier is
    the smaller key, or an earlier start in one document. A null key counts as
    the smallest; rows that repeat a key are ordered by a hash of their texts,
    and rows that repeat key and text are one document, returned as often as
    given. Remaining bytes may split characters; they are bytes, not text. Bytes
    are compared before any is removed. window: from K + 1 to 255.
    """
    if not K < window < 256:
        raise ValueError(f"window is from {K + 1} to 255")
    rows, marks = removed_ranges(docs, window, text, key)
    per = marks.groupBy("id", "tag").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))

    def keep(batches):
        for batch in batches:
            data, off = common.text_buffers(batch.column(1))
            raw = data.tobytes()
            out = []
            for i, (s, e) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                body = raw[off[i] : off[i + 1]]
                removed = spans = 0
                kept = body
                if s:
                    a, b = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (s, e))
                    o = np.argsort(a, kind="stable")
                    a, b = a[o], np.maximum.accumulate(b[o])
                    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
                    a, b = a[np.r_[0, cut]], b[np.r_[cut - 1, len(b) - 1]]
                    removed, spans = int((b - a).sum()), len(a)
                    kept = b"".join(body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True))
                out.append((len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(per, ["id", "tag"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(keep, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
