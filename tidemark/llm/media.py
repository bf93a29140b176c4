"""Media columns: ISO base media containers in a binary column.

``wrap`` stores bytes losslessly as a track of 8 x 8 frames of 8-bit grey
samples. ``probe`` walks the nested boxes of any container, decodes the sample
tables and returns codec, duration and the byte ranges of keyframes; it never
looks inside the samples. ``samples`` reads the stored sample bytes back.
"""

import hashlib
import struct
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FRAME, SIDE, TIMESCALE, KEY_EVERY, CHUNK_FRAMES = 64, 8, 25, 16, 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """A container that can't be read; probe() reports its message."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of FRAME."""
    return raw + bytes(-len(raw) % FRAME if raw else FRAME)


def wrap(payload: bytes) -> bytes:
    """A container whose samples are the payload's frames; its length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    last = n - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != CHUNK_FRAMES else [])
    wide = len(payload) > 0xF0000000
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))

    def movie(first: int) -> bytes:
        offsets = first + FRAME * CHUNK_FRAMES * np.arange(chunks, dtype=np.int64)
        keys = np.arange(1, n + 1, KEY_EVERY)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
        head = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, track)

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    size = len(kind) + len(movie(0))
    if wide:
        return kind + movie(size + 16) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    return kind + movie(size + 8) + struct.pack(">I4s", 8 + len(payload), b"mdat") + payload


def boxes(raw: bytes, start: int = 0, end: int | None = None):
    """(kind, body start, end) of the boxes side by side; sizes of 64 bits and to the end of the file included."""
    end = len(raw) if end is None else end
    while start < end:
        if start + 8 > end:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise Malformed("a box header is cut off")
            size, body = struct.unpack_from(">Q", raw, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if start + size > end or size < body - start:
            raise Malformed(f"a box of {size} bytes doesn't fit")
        yield kind, body, start + size
        start += size


def _walk(raw: bytes, start: int = 0, end: int | None = None, depth: int = 0):
    """Every box with its path, containers entered."""
    if depth > 16:
        raise Malformed("boxes are nested too deeply")
    for kind, a, b in boxes(raw, start, end):
        yield (kind,), a, b
        if kind in CONTAINERS:
            for path, c, d in _walk(raw, a, b, depth + 1):
                yield (kind, *path), c, d


def _table(raw: bytes, a: int, b: int, kind: str, columns: int = 1) -> np.ndarray:
    n = struct.unpack_from(">I", raw, a + 4)[0]
    size = n * columns * np.dtype(kind).itemsize
    if a + 8 + size > b:
        raise Malformed("a sample table is cut off")
    out = np.frombuffer(raw, kind, n * columns, a + 8).astype(np.int64)
    return out.reshape(n, columns) if columns > 1 else out


def probe(raw: bytes) -> dict:
    """codec, timescale, duration, offsets and sizes of samples, keys (indexes of sync samples) of the first track with samples."""
    try:
        track: dict[bytes, tuple[int, int]] = {}
        seen = False
        for path, a, b in _walk(raw):
            if path[-1] == b"trak":
                if b"stsz" in track or b"stz2" in track:
                    break
                track, seen = {}, True
            elif seen and b"trak" in path:
                track[path[-1]] = (a, b)
        need = {b"stsd", b"stsz", b"stsc", b"mdhd", b"stts"} - track.keys()
        if need or not (track.keys() & {b"stco", b"co64"}):
            raise Malformed("no track with sample tables")
        codec = raw[(at := track[b"stsd"][0]) + 12 : at + 16].decode("latin-1")
        a, b = track[b"mdhd"]
        timescale, declared = struct.unpack_from(">IQ", raw, a + 20) if raw[a] == 1 else struct.unpack_from(">II", raw, a + 12)
        a, b = track[b"stsz"]
        one, n = struct.unpack_from(">II", raw, a + 4)
        sizes = np.full(n, one, np.int64) if one else np.frombuffer(raw, ">u4", n, a + 12).astype(np.int64)
        chunks = _table(raw, *track[b"co64"], ">u8") if b"co64" in track else _table(raw, *track[b"stco"], ">u4")
        runs = _table(raw, *track[b"stsc"], ">u4", 3).reshape(-1, 3)
        last = np.r_[runs[1:, 0], len(chunks) + 1]
        per = np.repeat(runs[:, 1], np.maximum(last - runs[:, 0], 0))
        if len(per) != len(chunks) or per.sum() != n:
            raise Malformed("chunks and samples don't agree")
        upto = np.r_[0, np.cumsum(sizes)]
        first = np.r_[0, np.cumsum(per)][:-1]
        offsets = upto[:-1] - np.repeat(upto[first] if n else upto[:0], per) + np.repeat(chunks, per)
        if n and (offsets + sizes).max() > len(raw):
            raise Malformed("samples lie beyond the file")
        steps = _table(raw, *track[b"stts"], ">u4", 2).reshape(-1, 2)
        keys = _table(raw, *track[b"stss"], ">u4") - 1 if b"stss" in track else np.arange(n)
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise Malformed("a sync sample doesn't exist")
        return {"codec": codec, "timescale": timescale, "duration": int((steps[:, 0] * steps[:, 1]).sum()) or declared, "offsets": offsets, "sizes": sizes, "keys": keys}
    except (struct.error, ValueError) as e:
        if isinstance(e, Malformed):
            raise
        raise Malformed("a table is cut off") from e


def samples(raw: bytes, found: dict) -> bytes:
    """All sample bytes in order; samples that follow each other are read at once."""
    offsets, ends = found["offsets"], found["offsets"] + found["sizes"]
    if not len(offsets):
        return b""
    cuts = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    at = [0, *cuts.tolist(), len(offsets)]
    return b"".join(raw[offsets[i] : ends[j - 1]] for i, j in pairwise(at))


def key_ranges(found: dict) -> np.ndarray:
    """Byte ranges (start, end) of the keyframes that probe() found."""
    a = found["offsets"][found["keys"]]
    return np.stack([a, a + found["sizes"][found["keys"]]], 1)


def _ranges(each: list[np.ndarray | None]) -> pa.Array:
    """Ranges of each row as one list column, null where there are none to tell."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *(x for x in each if x is not None)])
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in each)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=pa.array([x is None for x in each], pa.bool_()))


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``info``: codec, timescale, duration, n_samples, keyframes (byte ranges, end exclusive), error.

    Null media gives a null info; a malformed container gives its error and
    nulls. Other columns stay; one that is named info is replaced.
    """
    kind = "struct<codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>,error:string>"

    @F.arrow_udf(kind)
    def info(cells: pa.Array) -> pa.Array:
        codec, timescale, duration, n, keys, error = ([None] * len(cells) for _ in range(6))
        for i, cell in enumerate(cells):
            if not cell.is_valid:
                continue
            try:
                x = probe(cell.as_buffer().to_pybytes())
            except Malformed as e:
                error[i] = str(e)
                continue
            codec[i], timescale[i], duration[i], n[i], keys[i] = x["codec"], x["timescale"], x["duration"], len(x["offsets"]), key_ranges(x)
        columns = [pa.array(codec, pa.string()), *(pa.array(c, pa.int64()) for c in (timescale, duration, n)), _ranges(keys), pa.array(error, pa.string())]
        return pa.StructArray.from_arrays(columns, ["codec", "timescale", "duration", "n_samples", "keyframes", "error"], mask=cells.is_null())

    return df.withColumn("info", info(F.col(media)))


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text's UTF-8 bytes as a stored container. Null texts are empty, one frame of zeros."""

    def encode(batches):
        for batch in batches:
            data, off = common.text_buffers(batch.column(1))
            for i, j in common.slices(off, 4 << 20):
                raw = data[off[i] : off[j]].tobytes()
                at = off[i : j + 1] - off[i]
                media = [wrap(padded(raw[a:b])) for a, b in pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"`{key}` long, n_bytes long, media binary")


def media_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores texts as media, reads the stored bytes back and computes per row: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; codec, timescale, duration, keyframes (byte ranges in the stored form, end exclusive).

    Equal texts get equal values. Null keys and repeated rows come back as they
    are. feature: codec, timescale, duration, samples, keyframes, and SHA-256
    (16 digits) of the keyframe byte ranges, joined by colons.
    """
    stored = common.Scratch(docs.sparkSession, "media").stage(text_media(docs, text, key), "media")

    def read(batches):
        names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "keyframes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            out, keys = [], []
            for k, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = cell.as_buffer().to_pybytes()
                x = probe(raw)
                payload, ranges = samples(raw, x), key_ranges(x)
                digest = hashlib.sha256(ranges.astype(">i8").tobytes()).hexdigest()[:16]
                feature = f"{x['codec'].strip()}:{x['timescale']}:{x['duration']}:{len(x['offsets'])}:{len(ranges)}:{digest}"
                out.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, x["codec"], x["timescale"], x["duration"]))
                keys.append(ranges)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, _ranges(keys)], names)

    kind = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(read, f"`{key}` long, {kind}, codec string, timescale long, duration long, keyframes array<struct<start:bigint,end:bigint>>")
