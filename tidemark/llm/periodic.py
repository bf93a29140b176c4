"""Maximal runs of repeated word sequences, by the runs theorem.

Every run (a stretch with smallest period p, at least 2p long, that can't be
extended) holds the longest Lyndon word of one of its places, in the order of
words or in the reverse one, and that word is p long. The longest Lyndon word
at a place ends where the next smaller suffix starts: the next smaller value of
the inverse suffix array. So each place gives one candidate in each order. A
candidate is extended to both sides by the longest common prefix of two suffixes
and the longest common suffix of two prefixes: range minima over LCP arrays of
the words and of the reversed words, with a sparse table over block minima.

A slice of texts is worked on as one array. A suffix ends with its text, whose
end comes before every word, and suffixes of different texts never tie, so runs
don't cross texts. Arrays are linear in the words of a slice; a text is never
cut, so a very long one is a slice by itself.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes of a slice; values of a block of range minima; cells that are compared at once.
SLICE, BLOCK, CELLS = 1 << 20, 16, 1 << 19


def suffix_ranks(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by doubling; key orders the first words (texts apart), end is that of each place's text.

    Only places whose suffix still ties with another are sorted again, so what doesn't repeat costs two sorts.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    step = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, step, 0))
    live, k = order[~(new & np.append(new[1:], True))], 1
    while len(live):
        ahead = live + k
        second = np.where(ahead < end[live], rank[np.minimum(ahead, n - 1)], -1)
        first = rank[live]
        order = np.argsort(first * (n + 1) + second + 1, kind="stable")
        live, first, second = live[order], first[order], second[order]
        step = np.arange(len(live))
        group = np.ones(len(live), bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        rank[live] = first + np.maximum.accumulate(np.where(new, step, 0)) - np.maximum.accumulate(np.where(group, step, 0))
        live = live[~(new & np.append(new[1:], True))]
        k *= 2
    return rank


def common_prefixes(code: np.ndarray, rank: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By rank: words that a suffix shares with the one before, 0 across texts.

    Where the words before both suffixes are equal, the value is one less than
    that of the place before; only the others are compared, and these sum to
    n log n words at most.
    """
    n = len(code)
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    before = np.full(n, -1)
    before[place[1:]] = place[:-1]
    before[(before < 0) | (start[np.maximum(before, 0)] != start)] = -1
    here = np.arange(n)
    follows = (before > start) & (here > start)
    follows[follows] = code[here[follows] - 1] == code[before[follows] - 1]
    lead = np.flatnonzero(~follows & (before >= 0))
    length = np.zeros(n, np.int64)
    live, width = lead, 8
    while len(live):
        rest = []
        some = max(1, CELLS // width)
        for i in range(0, len(live), some):
            a = live[i : i + some]
            x, y = a + length[a], before[a] + length[a]
            room = np.minimum(end[a] - x, end[a] - y)
            ahead = np.arange(width)
            same = (code[np.minimum(x[:, None] + ahead, n - 1)] == code[np.minimum(y[:, None] + ahead, n - 1)]) & (ahead < room[:, None])
            whole = same.all(1)
            length[a] += np.where(whole, width, same.argmin(1))
            rest.append(a[whole])
        live = np.concatenate(rest)
        width = max(8, min(2 * width, CELLS // max(len(live), 1)))
    source = np.maximum.accumulate(np.where(follows, 0, here))
    out = np.empty(n, np.int64)
    out[rank] = np.maximum(length[source] - (here - source), 0)
    return out


class RangeMinimum:
    """Minima of ranges: prefixes and suffixes of blocks, and a sparse table over the minima of blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-max(len(values), 1) // BLOCK)
        blocks = np.full(n * BLOCK, np.iinfo(np.int64).max)
        blocks[: len(values)] = values
        self.blocks = blocks.reshape(n, BLOCK)
        self.to = np.minimum.accumulate(self.blocks, 1).reshape(-1)
        self.of = np.minimum.accumulate(self.blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        self.table = [self.blocks.min(1)]
        while 2 << (len(self.table) - 1) <= n:
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least values from a to b, both included, a <= b."""
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.of[a], self.to[b])
        wide = np.flatnonzero(y - x > 1)
        level = np.frexp((y - x - 1)[wide].astype(float))[1] - 1
        for k in np.unique(level).tolist():
            i = wide[level == k]
            t = self.table[k]
            out[i] = np.minimum(out[i], np.minimum(t[x[i] + 1], t[y[i] - (1 << k)]))
        near = np.flatnonzero(x == y)
        if len(near):
            at = np.arange(BLOCK)
            inside = (at >= (a[near] % BLOCK)[:, None]) & (at <= (b[near] % BLOCK)[:, None])
            out[near] = np.where(inside, self.blocks[x[near]], np.iinfo(np.int64).max).min(1)
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place of a smaller value, len(values) if there is none: up and down a pyramid of pairwise minima."""
    n = len(values)
    levels = [values]
    while len(levels[-1]) > 1:
        x = levels[-1]
        x = np.append(x, np.iinfo(np.int64).max) if len(x) % 2 else x
        levels.append(np.minimum(x[::2], x[1::2]))
    base = np.cumsum([0, *(len(x) for x in levels)])
    flat, sizes = np.concatenate(levels), np.array([len(x) for x in levels])
    out = np.full(n, n)
    live, at, level = np.arange(n - 1), np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
    while len(live):
        # at is a place of the level: what is before it holds no smaller value
        found = flat[base[level] + at] < values[live]
        done = found & (level == 0)
        out[live[done]] = at[done]
        at, level = np.where(found, at * 2, at + 1), np.where(found, level - 1, level)
        up = ~found & (at % 2 == 0)
        at, level = np.where(up, at // 2, at), np.where(up, level + 1, level)
        keep = ~done & (level < len(levels))
        keep[keep] = at[keep] < sizes[level[keep]]
        live, at, level = live[keep], at[keep], level[keep]
    return out


def find_runs(code: np.ndarray, off: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of texts side by side, by start, then period; code: numbers of words, off: where texts start.

    Runs of at least ``least`` words and ``exponent`` periods; exponent is 2 or more.
    """
    n = len(code)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.diff(off)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start, end = off[:-1][text], off[1:][text]
    last, width = int(text[-1]), int(code.max()) + 1
    # later texts come first, so that the suffix after a text's last one is smaller
    words = suffix_ranks((last - text) * width + code, end)
    mirrored = suffix_ranks((last - text) * width + (width - 1 - code), end)
    forward = RangeMinimum(common_prefixes(code, words, start, end))
    back_code, back_start, back_end = code[::-1], (n - end)[::-1], (n - start)[::-1]
    back_rank = suffix_ranks(text[::-1] * width + back_code, back_end)
    backward = RangeMinimum(common_prefixes(back_code, back_rank, back_start, back_end))

    def shared(rank, minima, a, b):
        x, y = rank[a], rank[b]
        return minima(np.minimum(x, y) + 1, np.maximum(x, y))

    found = []
    for rank in (words, mirrored):
        root = np.arange(n)
        after = next_smaller(rank)
        ok = after < end
        root, after = root[ok], after[ok]
        right = code[root] == code[after]
        left = root > start[root]
        left[left] = code[root[left] - 1] == code[after[left] - 1]
        more = right | left
        root, after, right, left = root[more], after[more], right[more], left[more]
        ahead, behind = np.zeros(len(root), np.int64), np.zeros(len(root), np.int64)
        ahead[right] = shared(words, forward, root[right], after[right])
        behind[left] = shared(back_rank, backward, n - root[left], n - after[left])
        period = after - root
        length = period + ahead + behind
        ok = length >= np.maximum(least, exponent * period)
        found.append(np.stack([root - behind, period, length], 1)[ok])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def _slice(raw: bytes, off: np.ndarray, least: int, exponent: int) -> tuple:
    """Words of each text, runs of all texts and where each text's runs start, collapsed texts."""
    numbers: dict[bytes, int] = {}
    words = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    at = np.cumsum([0, *map(len, words)])
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for t in words for w in t), np.int64, int(at[-1]))
    start, length, period = find_runs(code, at, least, exponent)
    gone = np.zeros(len(code) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stays = np.cumsum(gone)[:-1] == 0
    owner = np.searchsorted(at, start, "right") - 1
    texts = [b" ".join(t) for t in words]
    for d in np.unique(owner).tolist():
        texts[d] = b" ".join(w for w, s in zip(words[d], stays[at[d] : at[d + 1]].tolist(), strict=True) if s)
    return np.diff(at), start - at[owner], length, period, np.bincount(owner, minlength=len(words)), texts


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 24, exponent: int = 3) -> DataFrame:
    """Per row of docs: key, n_words, runs (array of start, length, period, by start, then period), collapsed.

    Words are what stands between blanks (bytes 32 and 9 to 13), compared byte
    by byte and numbered from 0. A run is a stretch of words with smallest
    period ``period``, ``least`` words and ``exponent`` periods long at least,
    that no neighbouring word extends. collapsed: the words that no run holds
    after its first period, joined by blanks. Null and empty texts have no
    words, no runs and an empty collapsed text. Null keys and repeated rows come
    back as they are, a row each; other columns aren't looked at.
    """
    if exponent < 2 or least < 1:
        raise ValueError("runs have two periods and a word at least")
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    names = [key, "n_words", "runs", "collapsed"]

    def read(batches):
        for batch in batches:
            data, off = common.text_buffers(batch.column(1))
            raw = data.tobytes()
            for i, j in common.slices(off, SLICE):
                n, start, length, period, count, texts = _slice(raw, off[i : j + 1], least, exponent)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names)

    return rows.mapInArrow(read, f"`{key}` long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
