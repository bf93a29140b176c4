"""Token counts without ids: pieces are counted once per distinct pre-token.

Pass 1 cuts every text into the tokenizer's own pre-tokens and keeps, per block
of documents, a sparse matrix (document x local pre-token -> frequency) and the
block's distinct pre-tokens, dealt by hash to dictionary buckets. Each bucket
counts the pieces of each distinct pre-token once and answers every block that
asked. A join by block then multiplies matrix and counts and sums.
"""

import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Beyond these the tokenizer's own normalizer and pre-tokenizer run: elsewhere Unicode versions may differ.
_UNUSUAL = re.compile("[\x1c-\x1f\x85ɐ-‒―-‗‚‛„‟-‥‧-₫₭-\U0010ffff]")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")
#: Bytes of text in a block; each block's matrix and dictionary fit easily in a task.
BLOCK_BYTES = 32 << 20
#: Text bytes by which dictionary buckets are counted.
BUCKET_BYTES = 16 << 20


def check_supported(path: str) -> None:
    """Raises unless the file cuts texts as pre_tokens() does: lower case, these words, these special tokens, BPE of pre-tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    kinds = [x["type"] for x in steps]
    pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = next((x["pattern"].get("Regex") for x in pre if x["type"] == "Split"), None) or ""
    special = {x["content"] for x in spec["added_tokens"]}
    if kinds != ["NFC", "Replace", "Lowercase"] or pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}") != _WORDS.pattern or special != set(SPECIALS) or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path}: a tokenizer that cuts texts in another way")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Kept in the Python worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def pre_tokens(text: str, tok) -> tuple[list[str], int]:
    """Normalized pre-tokens of a text and the number of special tokens in it."""
    special = 0
    parts = [text]
    if "<|" in text:
        parts = _SPECIAL.split(text)
        special = len(parts) // 2
        parts = parts[::2]
    out: list[str] = []
    for p in parts:
        if _UNUSUAL.search(p):
            p = tok.normalizer.normalize_str(p)
            # offsets point into the normalized text, so slices are pre-tokens before the byte mapping
            out += [p[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(p)]
        else:
            out += _WORDS.findall(p.lower())
    return out, special


class _Ids(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null or empty text: 0 bytes, 0 tokens. Null keys and repeated rows come
    back as they are, a row each. A tokenizer file that cuts texts in another way
    than this module raises. Special strings count as one token, as the
    library's default has them. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "token-counts")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    check_supported(tokenizer)
    size, buckets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 16
    while buckets < size // BUCKET_BYTES:
        buckets *= 2

    def cut(batches):
        import xxhash
        from pyspark import TaskContext

        tok = _tokenizer(tokenizer)
        part, block = TaskContext.get().partitionId(), 0
        ids, heads, docs_, freq, held, n = _Ids(), [], [], [], 0, 0

        def flush():
            d, w = np.concatenate(docs_) if docs_ else np.zeros(0, np.int64), np.concatenate(freq) if freq else np.zeros(0, np.int64)
            pair, count = np.unique(d << 32 | w, return_counts=True)
            words = list(ids)
            home = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) % buckets for x in words), np.int64, len(words))
            order = np.argsort(home, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            name = part << 24 | block
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            h = np.array(heads, np.int64).reshape(-1, 4)
            w = rank[pair & 0xFFFFFFFF]
            d = pair >> 32
            s = np.lexsort((w, d))
            d, w, count = d[s], w[s], count[s]
            new = np.r_[True, d[1:] != d[:-1]][: len(d)]
            step = np.where(new, w, w - np.r_[0, w[:-1]][: len(w)])
            matrix = common.pack(h[:, 0], h[:, 1].astype(np.uint8), h[:, 2], h[:, 3].astype(np.uint32), np.searchsorted(d, np.arange(len(h) + 1)).astype(np.uint32), step.astype(np.uint32), count.astype(np.uint32))
            out = [(-1, name, matrix)]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((b, name, common.squeeze("\n".join(words[i] for i in order[cuts[b] : cuts[b + 1]]).encode("utf-8", "surrogatepass"))))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "block", "data"])

        for batch in batches:
            values, null = common.long_column(batch.column(0))
            data, off = common.text_buffers(batch.column(1))
            raw = data.tobytes()
            for i in range(batch.num_rows):
                found, special = pre_tokens(raw[off[i] : off[i + 1]].decode("utf-8", "replace"), tok)
                freq.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
                docs_.append(np.full(len(found), n, np.int64))
                heads.append((values[i], null[i], off[i + 1] - off[i], special))
                held, n = held + int(off[i + 1] - off[i]), n + 1
                if held >= BLOCK_BYTES:
                    yield flush()
                    ids, heads, docs_, freq, held, n, block = _Ids(), [], [], [], 0, 0, block + 1
        if n:
            yield flush()

    kind = "bucket int, block long, data binary"
    cuts = scratch.stage(rows.mapInArrow(cut, kind), "pre-tokens")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        tok = _tokenizer(tokenizer)
        tok.encode_special_tokens = True
        words = [common.unsqueeze(x).decode("utf-8", "surrogatepass").split("\n") for x in frame["data"]]
        distinct = list({x for w in words for x in w})
        known = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            known |= zip(some, (len(e) for e in tok.encode_batch(some, add_special_tokens=False)), strict=True)
        answers = [common.pack(np.fromiter(map(known.__getitem__, w), np.uint32, len(w))) for w in words]
        return pd.DataFrame({"bucket": frame["bucket"], "block": frame["block"], "data": answers})

    counted = common.deal(cuts.where("bucket >= 0"), buckets, buckets).groupBy("bucket").applyInPandas(count, kind)

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        pieces = [common.unpack(x)[0] for x in frame["data"].iloc[1:]]
        known = np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)
        values, null, n_bytes, special, at, step, times = common.unpack(frame["data"].iloc[0])
        at = at.astype(np.int64)
        step = step.astype(np.int64)
        run = np.cumsum(step)
        lengths = np.diff(at)
        base = np.r_[0, run][at[:-1]]
        word = run - np.repeat(base, lengths)
        total = np.r_[0, np.cumsum(known[word] * times if len(word) else np.zeros(0, np.int64))]
        n = total[at[1:]] - total[at[:-1]] + special
        out = pd.DataFrame({key: pd.array(values, "Int64"), "n_bytes": n_bytes, "n_tokens": n.astype(np.int64), "over_limit": n > limit})
        out.loc[null.astype(bool), key] = pd.NA
        return out

    both = cuts.where("bucket < 0").unionByName(counted)
    return both.groupBy("block").applyInPandas(multiply, f"`{key}` long, n_bytes long, n_tokens long, over_limit boolean")
