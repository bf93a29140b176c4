"""What the operators of this subpackage share: staged tables, Arrow text buffers, blobs.

Staged tables are Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; they cut lineage, so a lost executor costs a re-read
and no recomputation.
"""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "tidemark.shared.dir"
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where the session names none and is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_OWN, at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES unless the session asks for less, so that long texts don't add up in memory.

    The setting is read when a plan runs, so it stays set in the session.
    """
    now = spark.conf.get(_BATCH, None)
    size = int(now.rstrip("b")) if now and now.rstrip("b").isdigit() else None
    if size is None or size > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Staged tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        bound_batches(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._staged_at = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes staged tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._staged_at)
            p.getFileSystem(conf).delete(p, True)


def deal(df: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """df dealt by the number in its column bucket to about so many tasks, the session's shuffle partitions at least.

    ``buckets`` and the number of tasks are powers of two, so every task gets
    as many buckets as any other; hashes of the numbers would put several into
    one task and none into another. A group by bucket needs no further shuffle.
    """
    want = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionById(min(buckets, 1 << (want - 1).bit_length()), "bucket")


def beside(rows: DataFrame, facts: DataFrame, keys: list[str], few: int, salts: int = 64) -> DataFrame:
    """rows with the other columns of facts, which has one row by keys and is staged; null keys are equal, rows without facts get nulls.

    Facts of at most ``few`` rows are broadcast. Of more, each goes to all
    ``salts`` shares of its rows, so that a key with most of the rows is no single task.
    """
    facts = facts.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in facts.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    if facts.limit(few + 1).count() <= few:
        facts = F.broadcast(facts)
    else:
        rows = rows.withColumn("_salt", (F.rand(1) * salts).cast("int"))
        facts = facts.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same.append(F.col("_salt") == F.col("_share"))
    return rows.join(facts, same, "left").drop("_salt", "_share", *(f"_key{i}" for i in range(len(keys))))


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one raises as Spark does."""
    return df.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty. Views, not copies, where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges (i, j) of at most that many bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def long_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and a null mask of an integer column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    mask = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), mask


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the bytes of wide integers go plane by plane, which compresses better."""
    parts = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode()
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        parts += [bytes([len(kind)]), kind, len(a).to_bytes(8, "little"), planes]
    return squeeze(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = memoryview(unsqueeze(blob))
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for _ in range(n):
        k = raw[at]
        kind = np.dtype(bytes(raw[at + 1 : at + 1 + k]).decode())
        at += 1 + k
        m = int.from_bytes(raw[at : at + 8], "little")
        at += 8
        size = m * kind.itemsize
        planes = np.frombuffer(raw[at : at + size], np.uint8).reshape(kind.itemsize, m)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if m else np.zeros(0, kind))
        at += size
    return out


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Packed parts of blocks as a batch of (bucket, block, data)."""
    kinds = (("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
