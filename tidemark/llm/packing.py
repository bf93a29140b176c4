"""Best-fit-decreasing packing of token sequences.

Lengths decide where pieces go, so the plan needs only the count of pieces per
length: at most ``capacity`` numbers, whatever the corpus. The plan is best-fit
decreasing over these counts. Open bins of equal room form a class; a segment
tree over rooms finds the tightest class with room in O(log capacity), and a
whole class takes pieces of a length at once. Its runs (length, first rank,
number, bin, offset) number O(capacity^2) at worst. Pieces then take their bins by their rank among the
pieces of their length; ranks come from prefix sums over blocks, never from a
sort of a whole length class.
"""

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with these go to the library whole.
_UNUSUAL = re.compile("[\x1c-\x1f\x85ɐ-‒―-‗‚‛„‟-‥‧-₫₭-\U0010ffff]")

class RoomTree:
    """Segment tree over rooms 0..capacity; a leaf holds whether open bins of that room exist."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = self.size + room
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room >= least of an open bin."""
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first rank, pieces, first bin, pieces per bin,
    offset): the piece of rank first + i goes to bin first_bin + i // per_bin,
    at offset + (i % per_bin) * length. Bins of one class stay contiguous in
    number, split where a length runs out.
    """
    tree, open_, runs, bins = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                n = -(-left // per)
                start, room, whole = bins, capacity, left // per
                bins += n
            else:
                start, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
                per = room // length
                whole = min(n, left // per)
            offset, again = capacity - room, []
            if whole:
                runs.append((length, rank, whole * per, start, per, offset))
                rank, left = rank + whole * per, left - whole * per
                again.append((room - per * length, start, whole))
            if whole < n and left and left < per:
                runs.append((length, rank, left, start + whole, left, offset))
                again.append((room - left * length, start + whole, 1))
                rank, left, whole = rank + left, 0, whole + 1
            if whole < n:
                again.append((room, start + whole, n - whole))
            for r, s, k in again:
                open_.setdefault(r, []).append((s, k))
                tree.set(r, True)
    return runs


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as the library gives them for a byte-level BPE file.

    Where the file's merges stand in the order of their ids, tiktoken merges by
    these ids as ranks, several times as fast; a text of every batch is then
    encoded by both, and a difference raises. Unusual texts and those with
    special strings go to the library itself.
    """

    def __init__(self, path: str):
        self.tok = _tokenizer(path)
        self.special = re.compile("(" + "|".join(re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()) + ")")
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not model.get("ignore_merges")
        if not plain or any(b <= a for a, b in pairwise(made)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        return tiktoken.Encoding("ranked", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        out, checked = [], False
        for t in texts:
            if self.fast is None or _UNUSUAL.search(t) or "<|" in t and self.special.search(t):
                out.append(self.slow(t))
                continue
            out.append(self.fast.encode_to_numpy(t, disallowed_special=()))
            if not checked:
                checked = True
                if not np.array_equal(out[-1], self.slow(t)):
                    raise ValueError("ids by ranks differ from the library's")
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Kept in the Python worker from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, block and rank among the block's pieces of that length."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    end = np.array([end_id], "<u4")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"]

    def encode(batches):
        from pyspark import TaskContext

        enc, block, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            values, null = common.long_column(batch.column(0))
            data, off = common.text_buffers(batch.column(1))
            for i, j in common.slices(off, 2 << 20):
                raw = data[off[i] : off[j]].tobytes()
                at = off[i : j + 1] - off[i]
                out = []
                for k, ids in enumerate(enc.batch([raw[at[k] : at[k + 1]].decode("utf-8", "replace") for k in range(j - i)])):
                    raw_ids = memoryview(np.concatenate([ids, end], dtype="<u4")).cast("B")
                    n = len(ids) + 1
                    first = n - (-(-n // capacity) - 1) * capacity
                    start, length, p = 0, first, 0
                    while start < n:
                        out.append((i + k, p, start, length, zlib.crc32(raw_ids[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                        start, length, p = start + length, capacity, p + 1
                a = np.array(out, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays([pa.array(values[a[:, 0]], mask=null[a[:, 0]]), pa.array(a[:, 1].astype(np.int32)), *(pa.array(a[:, c]) for c in (2, 3, 4)), pa.array(np.full(len(a), block, np.int64)), pa.array(a[:, 5])], names)

    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, block long, rank long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id, so a null or empty text is one piece of
    length 1. Longer ones are cut into pieces of capacity, the first one
    shorter where it doesn't divide. Ties between pieces of a length fall by
    block and order of reading. Null keys and repeated rows are packed as rows
    of their own; an empty table gives no rows. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "packing")
    cut = scratch.stage(pieces(docs, tokenizer, capacity, end_id, text, key), "pieces")
    per_block = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    lengths, firsts, numbers, bins, pers, offsets = (np.array([r[i] for r in runs], np.int64) for i in range(6))
    order = np.lexsort((firsts, lengths))
    lengths, firsts, bins, pers, offsets = (x[order] for x in (lengths, firsts, bins, pers, offsets))
    wide = int(max(counts.values(), default=0)) + 1
    starts = np.array([int(a) * wide + int(b) for a, b in zip(lengths, firsts, strict=True)], np.int64)

    def place(batches):
        for batch in batches:
            t = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank", "base")}
            rank = t["rank"] + t["base"]
            r = np.searchsorted(starts, t["length"] * wide + rank, "right") - 1
            i = rank - firsts[r]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins[r] + i // pers[r]), pa.array(offsets[r] + i % pers[r] * t["length"])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "block"])
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc_id", key)
