"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics of whole texts are staged, a small row for each document. Labelled
rows give means and deviations; each partition then sums its part of the normal
equations, and the parts are summed in two steps, so the driver gets one matrix
of fixed size. Calibration pools adjacent violators over a histogram of raw
scores on labelled rows that the fit didn't see.

Features, labels and weights are multiples of small powers of two and are summed
as integers, so the order of rows and the number of partitions don't matter to a
score. What floating point still decides (means, deviations, the angle of a
cosine) is rounded far above its noise.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_dedup import Roller

FEATURES, BINS, SLICE = 256, 1024, 256 << 10
#: Features and weights are multiples of 1 / UNIT, labels of 1 / LABEL. Sums of products are whole: below 2^53 in a batch or a score, below 2^63 for a billion labelled rows.
UNIT, LABEL = 1 << 18, 1 << 10
#: Labels are learnt where crc32(key as text) mod FOLDS is not 0; the last fold calibrates.
FOLDS = 5
NAMES = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digit", "stop", "odd", "pipe", "not_ascii", "newline",
    "distinct_words", "top_repeat", "adjacent_same", "distinct_pairs", "odd_end", "all_upper", "no_letter", "capital", "line_words",
)


def statistics(data: np.ndarray, off: np.ndarray, roller: Roller) -> np.ndarray:
    """A row of NAMES for each of the texts side by side; zeros for an empty one."""
    docs = len(off) - 1
    out = np.zeros((docs, len(NAMES)))
    if not len(data):
        return out
    size = np.diff(off)

    def per(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[off[1:]] - total[off[:-1]]

    upper = ((data >= 65) & (data <= 90)) | ((data >= 0x80) & (data <= 0x9F) & (np.r_[0, data[:-1]] == 0xC3))
    lower = (data >= 97) & (data <= 122)
    wide = data >= 0x80
    digit = (data >= 48) & (data <= 57)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    stop = (data == 46) | (data == 44) | (data == 59) | (data == 58)
    odd = ~(upper | lower | wide | digit | white | stop)
    solid = ~white
    first = np.r_[False, solid[:-1]]
    first[off[:-1][off[:-1] < len(data)]] = False
    start = np.flatnonzero(solid & ~first)
    last = np.r_[solid[1:], False]
    last[off[1:][off[1:] > 0] - 1] = False
    end = np.flatnonzero(solid & ~last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    words = np.bincount(doc, minlength=docs)
    n, m = np.maximum(size, 1), np.maximum(words, 1)
    length = end - start
    by = lambda x: np.bincount(doc, weights=x, minlength=docs)
    mean = by(length) / m
    run = np.r_[0, np.cumsum(upper)]
    ups = run[end] - run[start]
    run = np.r_[0, np.cumsum(lower | upper | wide)]
    letters = run[end] - run[start]
    run = np.r_[0, np.cumsum(lower)]
    lows = run[end] - run[start]
    h = common.mix64(roller.ranges(roller.sums(data), start, end) + length.astype(np.uint64))
    s = np.lexsort((h, doc))
    new = np.ones(len(s), bool)
    new[1:] = (doc[s][1:] != doc[s][:-1]) | (h[s][1:] != h[s][:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(s)])
    top = np.zeros(docs)
    np.maximum.at(top, doc[s][at], times)
    distinct = np.bincount(doc[s][at], minlength=docs)
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, bool)
    pair = common.mix64(h[:-1] * np.uint64(3) + h[1:])[doc[1:] == doc[:-1]] if len(h) else h
    pd_ = doc[1:][doc[1:] == doc[:-1]]
    s = np.lexsort((pair, pd_))
    new = np.ones(len(s), bool)
    new[1:] = (pd_[s][1:] != pd_[s][:-1]) | (pair[s][1:] != pair[s][:-1])
    pairs = np.bincount(pd_[s][new], minlength=docs)
    lines = per(data == 10) + 1
    # where a document has no words or pairs, the shares of distinct ones are 0
    out[:] = np.stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(by(length.astype(float) ** 2) / m - mean**2, 0)), per(upper) / n, per(digit) / n, per(stop) / n, per(odd) / n, per(data == 124) / n, per(wide) / n, per(data == 10) / n,
        distinct / m, top / m, by(same) / m, pairs / np.maximum(words - 1, 1), by(odd[end - 1]) / m, by((ups > 0) & (lows == 0)) / m, by(letters == 0) / m, by(upper[start]) / m, np.log1p(words / lines),
    ], 1)
    return out


@dataclass
class Model:
    """All that scoring needs; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    raw: np.ndarray  # of pooled blocks, increasing
    share: np.ndarray  # of label 1 in them, not decreasing
    seed: int = 11

    def features(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers of 1 / UNIT, and a last column of ones."""
        rng = np.random.default_rng(self.seed)
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        w = rng.standard_normal((x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
        return np.c_[np.rint(np.cos(z @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * (np.sqrt(2 / FEATURES) * UNIT)), np.ones(len(x))]

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        w = self.weights * UNIT
        return self.features(x) @ np.r_[np.rint(w[:-1]), np.rint(w[-1] * UNIT)] / UNIT**2

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_score(x), self.raw, self.share), 0, 1) if len(x) else np.zeros(0)


def pooled(n: np.ndarray, y: np.ndarray) -> list[tuple[int, int, float]]:
    """Adjacent violators pooled: (first bin, last bin, share) with shares not decreasing; bins without rows are left out."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n):
        blocks.append([i, i, n[i], y[i]])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return [(int(a), int(b), s / m) for a, b, m, s in blocks]


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, x: the statistics of each row's whole text."""

    def batches_(batches):
        roller = Roller()
        for batch in batches:
            data, off = common.text_buffers(batch.column(1))
            for i, j in common.slices(off, SLICE):
                x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i], roller)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "x"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches_, "id long, x array<float>")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(NAMES))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", ridge: float = 1e-3) -> Model:
    """Learns from labelled rows outside fold 0. Labels that repeat a key are averaged; null ones are left out.

    Without labelled rows every score is 0.5.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.avg("y").alias("y")).withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    scratch = common.Scratch(stats.sparkSession, "quality-fit")
    train = scratch.stage(stats.join(known, "id").select("x", "y", "fold"), "train")
    width = len(NAMES)
    sums = train.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{p}{i}") for i in range(width) for f, p in ((F.avg, "m"), (F.stddev_pop, "s")))).first()
    flat = Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), 0.0, 1.0, np.array([0.0]), np.array([0.5]))
    if not sums["n"]:
        return flat
    # in single precision: the order in which doubles were summed doesn't show
    flat.mean = np.array([sums[f"m{i}"] for i in range(width)], np.float32).astype(float)
    flat.scale = np.maximum(np.array([sums[f"s{i}"] for i in range(width)], np.float32).astype(float), 1e-6)

    def parts(batches):
        from pyspark import TaskContext

        a = np.zeros((FEATURES + 1, FEATURES + 2), np.int64)
        for batch in batches:
            f = flat.features(_matrix(batch, 0))
            y = np.rint(batch.column(1).to_numpy(zero_copy_only=False) * LABEL)
            a += (f.T @ np.c_[f, y]).astype(np.int64)  # whole numbers below 2^53 in a batch
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a), dtype=np.int32)), pa.array(np.full(len(a), TaskContext.get().partitionId() % 64, np.int32)), pa.array([r.tobytes() for r in a], pa.binary())], ["row", "part", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in frame["sums"]], axis=0)
        return pd.DataFrame({"row": frame["row"].iloc[:1], "part": frame["part"].iloc[:1], "sums": [total.tobytes()]})

    kind = "row int, part int, sums binary"
    some = train.where(F.col("fold") < FOLDS - 1).select("x", "y").mapInArrow(parts, kind)
    halves = some.groupBy("row", "part").applyInPandas(add, kind).groupBy("row").applyInPandas(add, kind)
    a = np.stack([np.frombuffer(r["sums"], np.int64) for r in sorted(halves.collect(), key=lambda r: r["row"])])  # FEATURES + 1 rows
    n = a[-1, -2]
    unit = np.r_[np.full(FEATURES, UNIT), 1.0]
    a = a / (unit[:, None] * np.r_[unit, LABEL])
    a, b = a[:, :-1], a[:, -1]
    penalty = np.full(len(a), ridge * max(n, 1))
    penalty[-1] = 1e-9
    flat.weights = np.linalg.solve(a / 1.0 + np.diag(penalty / FEATURES), b) if n else flat.weights
    low, high = flat.low, flat.high = -0.5, 1.5

    def binned(batches):
        for batch in batches:
            r = flat.raw_score(_matrix(batch, 0)) if batch.num_rows else np.zeros(0)
            bins = np.clip((r - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    counts = train.where(F.col("fold") == FOLDS - 1).select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("y") * LABEL)) / LABEL).alias("y")).collect()  # at most BINS rows
    hist = np.zeros((2, BINS))
    for r in counts:
        hist[:, r["bin"]] = r["n"], r["y"]
    blocks = pooled(*hist)
    if not blocks:
        flat.raw, flat.share = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return flat
    at = lambda i: low + (i + 0.5) * (high - low) / BINS
    ends = sorted({(at(i), s) for a_, b_, s in blocks for i in (a_, b_)})
    # a small slope keeps the order of raw scores where pooling made them equal
    raw = np.array([low, *(x for x, _ in ends), high])
    share = np.array([ends[0][1], *(s for _, s in ends), ends[-1][1]])
    flat.raw, flat.share = raw, np.clip(0.999 * share + 0.001 * (raw - low) / (high - low), 0, 1)
    return flat


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Per row of docs: key, held_out (fold 0), score (0 to 1), predicted (1 if score >= threshold).

    Null texts count as empty and get a score too. A null key has no fold, so
    held_out is false. Nothing but the text is an input of a score.
    """
    stats = common.Scratch(docs.sparkSession, "quality").stage(document_statistics(docs, text, key), "statistics")
    model = fit(stats, labels, key=key)

    def judge(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch, 1)))], ["id", "score"])

    scored = stats.mapInArrow(judge, "id long, score double")
    held = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    return scored.select(F.col("id").alias(key), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_texts(model: Model, text: Column) -> Column:
    """The score of a text column, for filtering documents where they are read."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        data, off = common.text_buffers(pa.array(texts, pa.large_string(), from_pandas=True))
        roller = Roller()
        parts = [model.score(statistics(data[off[i] : off[j]], off[i : j + 1] - off[i], roller)) for i, j in common.slices(off, SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)
