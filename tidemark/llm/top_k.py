"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's components are cut into 1, 4, then 16 segments. Of a segment of
length l with means m and deviation norms d of query and candidate, the inner
product is at most l * m_q * m_v + d_q * d_v (for vectors of given norms that
bounds the Euclidean distance from below). Bounds go coarse to fine; only
candidates whose bound reaches the k-th best score so far go on, and those that
pass all get their exact integer score.

Vectors are quantised once and staged in packed slices. Queries go in blocks;
as many blocks as a bounded number of bytes holds are sent to all tasks
together, and each such group takes one scan of the slices.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEVELS = (1, 4, 16)
#: Queries in a block, about, and bytes of the queries that tasks get at once (a block at least); bytes of a slice.
QUERY_BLOCK, QUERY_BYTES, SLICE = 2048, 32 << 20, 1 << 20
CHUNK = 512
#: Pairs that are bounded or scored at once.
PAIRS = 1 << 16


def quantized(vectors: list) -> list[np.ndarray | None]:
    """floor(1024 x) of each component as int64, or Python integers where they don't fit; None for null, empty or non-finite vectors."""
    out = []
    for v in vectors:
        try:
            a = np.floor(1024 * np.asarray(v, np.float64)) if v else None
        except TypeError:  # a null component
            a = None
        if a is None or not np.isfinite(a).all():
            out.append(None)
        else:
            out.append(a.astype(np.int64) if np.abs(a).max() < 2.0**62 else np.array([int(x) for x in a], object))
    return out


def packed(ids: list[int], vectors: list[np.ndarray]) -> bytes:
    """Vectors of one length as a blob: 4 or 8 bytes a component, doubles where whole numbers don't fit (they are whole, too)."""
    v = np.array(vectors)
    if v.dtype == object:
        v = v.astype(np.float64)
    elif len(v) and np.abs(v).max() < 2**31:
        v = v.astype(np.int32)
    return common.pack(np.array(ids, np.int64), v.reshape(-1))


def unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, flat = common.unpack(blob)
    v = flat.reshape(-1, width)
    if v.dtype == np.float64:
        return ids, np.array([[int(x) for x in r] for r in v.tolist()], object)
    return ids, v.astype(np.int64)


def _stats(v: np.ndarray, level: int, query: bool) -> np.ndarray:
    """Rows whose products are upper bounds of inner products: l * m (or m) and d of each segment."""
    parts = np.array_split(np.arange(v.shape[1]), min(level, v.shape[1]))
    means = np.stack([v[:, p].mean(1) for p in parts], 1)
    devs = np.stack([np.sqrt(((v[:, p] - m[:, None]) ** 2).sum(1)) for p, m in zip(parts, means.T, strict=True)], 1)
    return np.concatenate([means * [len(p) for p in parts] if query else means, devs], 1)


class Best:
    """The k best of each query so far: higher score first, then smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.float = q.astype(np.float64)
        self.stats = [_stats(self.float, s, True) for s in LEVELS]
        self.most = np.abs(self.float).max(initial=1)
        self.reach = np.full(len(ids), -np.inf)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)]  # query, vector, score

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        few = 2 * self.k + 1
        if len(ids) > few and not np.isfinite(self.reach).all():
            # a few rows first: without bounds every pair would be scored
            self.add(ids[:few], v[:few])
            ids, v = ids[few:], v[few:]
        f = v.astype(np.float64)
        slack = 1 + 1e-9 * self.most * np.abs(f).max(initial=1) * v.shape[1]
        stats = [_stats(f, s, False) for s in LEVELS]
        qi, vi = np.nonzero((self.stats[0] @ stats[0].T + slack >= self.reach[:, None]) & (self.ids[:, None] != ids[None, :]))
        for mine, theirs in zip(self.stats[1:], stats[1:], strict=True):
            keep = [np.einsum("ij,ij->i", mine[qi[i : i + PAIRS]], theirs[vi[i : i + PAIRS]]) + slack >= self.reach[qi[i : i + PAIRS]] for i in range(0, len(qi), PAIRS)]
            keep = np.concatenate([np.zeros(0, bool), *keep])
            qi, vi = qi[keep], vi[keep]
        if v.dtype == object or self.q.dtype == object or self.most * np.abs(f).max(initial=1) * v.shape[1] >= 2.0**62:
            score = np.array([sum(int(a) * int(b) for a, b in zip(self.q[i], v[j], strict=True)) for i, j in zip(qi, vi, strict=True)], object)
            self.rows[2] = self.rows[2].astype(object)
        else:
            parts = range(0, len(qi), PAIRS)
            score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", self.q[qi[i : i + PAIRS]], v[vi[i : i + PAIRS]]) for i in parts)])
        rows = [np.r_[a, b] for a, b in zip(self.rows, (qi, ids[vi], score), strict=True)]
        order = np.lexsort((rows[1], -rows[2], rows[0]))
        rows = [a[order] for a in rows]
        place = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        self.rows = [a[place < self.k] for a in rows]
        place = place[place < self.k]
        full = place == self.k - 1
        self.reach[self.rows[0][full]] = self.rows[2][full].astype(np.float64) * 1.0

    def table(self) -> pa.RecordBatch:
        low, high = -(2**63), 2**63 - 1
        score = [min(max(int(s), low), high) for s in self.rows[2]]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows[0]]), pa.array(self.rows[1]), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Queries are the rows whose key is divisible by ``every``; candidates are
    all rows with another key, ties to the smaller key, all where they are
    fewer than k. Rows with a null key and null, empty or non-finite vectors
    take no part; vectors meet only those of their own length. Rows that repeat
    a key are candidates of their own, and such a query answers once for its
    key with the first of them by its components. Scores beyond a long are
    held at its limits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "top-k")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    kind = "width int, query boolean, data binary"

    def cut(batches):
        held: dict[tuple[int, bool], tuple[list, list]] = {}

        def sent(key):
            ids, v = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([packed(ids, v)], pa.binary())], ["width", "query", "data"])

        for batch in batches:
            for i, a, asks in zip(batch.column(0).to_pylist(), quantized(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                if a is None:
                    continue
                key = (len(a), asks)
                ids, v = held.setdefault(key, ([], []))
                ids.append(i)
                v.append(a)
                if len(ids) * len(a) * 8 >= SLICE:
                    yield sent(key)
        for key in list(held):
            yield sent(key)

    candidates = rows.withColumn("asks", F.lit(False))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("asks", F.lit(True))
    slices = scratch.stage(candidates.unionByName(asked).mapInArrow(cut, kind), "slices")
    asked = scratch.stage(slices.where("query").select("width", "data", F.monotonically_increasing_id().alias("place")), "queries")
    # a row for each slice of queries: in groups of a bounded number of bytes
    groups, size = [], 0
    for r in asked.select("place", F.octet_length("data").alias("n")).orderBy("width", "place").collect():
        if not groups or size + r.n > QUERY_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(r.place)
        size += r.n
    at, kind = scratch.path("best"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(at)
    for places in groups:
        blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in asked.where(F.col("place").isin(places)).select("width", "data").collect():  # QUERY_BYTES, or one slice
            blocks.setdefault(r.width, []).append(unpacked(bytes(r.data), r.width))
        joined = {w: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for w, parts in blocks.items()}
        sent = spark.sparkContext.broadcast(joined)

        def search(batches, sent=sent):
            best = {w: [Best(ids[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK], k) for i in range(0, len(ids), QUERY_BLOCK)] for w, (ids, q) in sent.value.items()}
            for batch in batches:
                for w, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if w in best:
                        ids, v = unpacked(data.as_py(), w)
                        for i in range(0, len(ids), CHUNK):
                            for block in best[w]:
                                block.add(ids[i : i + CHUNK], v[i : i + CHUNK])
            for blocks in best.values():
                for block in blocks:
                    yield block.table()

        slices.where("not query").select("width", "data").mapInArrow(search, kind).write.mode("append").option("compression", "zstd").parquet(at)
        sent.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(kind).parquet(at).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
