"""Content-addressed WARC archive.

Payload bytes are stored once per verified strong digest (SHA-256, checked
against a second one of another family and the length), each compressed by
itself; exact record headers stand in a table of their own, each with the digest
of its payload. Original records are put together again by a join on the digest,
and what is known of a record is read from its bytes.
"""

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_FIELD = re.compile(rb"^([A-Za-z-]+): (.*?)\r?$", re.M)
_HEADERS = "key long, kind string, refers_to long, digest string, header string"
_PAYLOADS = "digest string, body binary"


def base32_sha1(payload: bytes) -> str:
    """Upper-case base32 SHA-1 without prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def headers(kind: Column, uri: Column, key: Column, content: Column, digest: Column, length: Column, refers: Column) -> Column:
    """The header block of a WARC/1.1 record, up to and with its empty line. Record ids come from key and content digest, so reruns agree."""

    def name(x: Column) -> Column:
        h = F.md5(F.concat_ws(":", F.lit("warc"), x.cast("string"), content))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    clean = F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "")
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(F.coalesce(key.cast("string"), F.lit("null")))),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(refers))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def _hashed(rows: DataFrame) -> DataFrame:
    """key, uri, digest, check, n, sha1 and the compressed body of (key, uri, payload)."""

    def hash_(batches):
        for batch in batches:
            out = []
            for cell in batch.column(2):
                raw = (cell.as_py() or "").encode()
                out.append((hashlib.sha256(raw).hexdigest(), hashlib.blake2b(raw, digest_size=16).hexdigest(), len(raw), base32_sha1(raw), common.squeeze(raw)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["key", "uri", "digest", "check", "n", "sha1", "body"])

    return rows.mapInArrow(hash_, "key long, uri string, digest string, check string, n long, sha1 string, body binary")


def write_archive(pages: DataFrame, at: str, payload: str = "html", key: str = "page_id", uri: str = "url", least: int = 0) -> None:
    """Writes at/headers and at/payloads.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    largest key is the response, others revisit it; shorter ones are responses
    each, but share their stored bytes. Null payloads are empty ones. Rows
    without a key are responses (they can't be referred to); of rows that
    repeat the largest key each is a response. Other columns are not read.
    """
    scratch = common.Scratch(pages.sparkSession, "digests")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), F.col(payload).cast("string").alias("payload"))
    hashed = scratch.stage(_hashed(rows), "digests")
    slim = hashed.drop("body")
    groups = slim.groupBy("digest").agg(F.max("key").alias("response"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    # equal digests must be equal payloads: another hash and the length agree, or the write fails
    sound = F.assert_true((F.col("c0") == F.col("c1")) & (F.col("n0") == F.col("n1")), F.lit("payloads of one digest differ"))
    joined = slim.join(groups.where(sound.isNull()).select("digest", "response"), "digest")
    kind = F.when((F.col("n") >= least) & (F.col("key") < F.col("response")), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(kind == "revisit", F.col("response"))
    heads = joined.select("key", kind.alias("kind"), refers.alias("refers_to"), "digest", headers(kind, F.col("uri"), F.col("key"), F.col("digest"), F.col("sha1"), F.col("n"), refers).alias("header"))
    heads.write.option("compression", "zstd").parquet(f"{at}/headers")
    # each digest's bytes once; copies meet inside tasks first
    hashed.groupBy("digest").agg(F.any_value("body").alias("body")).write.option("compression", "zstd").parquet(f"{at}/payloads")
    scratch.drop(hashed)


def read_headers(spark, at: str) -> DataFrame:
    return spark.read.schema(_HEADERS).parquet(f"{at}/headers")


def read_payloads(spark, at: str) -> DataFrame:
    """digest and body, verified on reading; a damaged payload fails the read."""

    def verify(batches):
        for batch in batches:
            bodies = [_opened(d.as_py(), b.as_py()) for d, b in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["digest", "body"])

    common.bound_batches(spark)
    return spark.read.schema(_PAYLOADS).parquet(f"{at}/payloads").mapInArrow(verify, _PAYLOADS)


def _opened(digest: str, body: bytes | None) -> bytes:
    raw = common.unsqueeze(body)
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("a stored payload doesn't match its digest")
    return raw


def read_records(spark, at: str) -> DataFrame:
    """key, record: the exact bytes of each WARC record, revisits with an empty block. Payloads are joined to responses and verified."""
    heads = read_headers(spark, at)
    stored = spark.read.schema(_PAYLOADS).parquet(f"{at}/payloads")
    common.bound_batches(spark)

    def build(batches):
        for batch in batches:
            key, head, digest, body = (batch.column(i) for i in range(4))
            records = [h.encode() + (_opened(d, b) if b is not None else b"") + b"\r\n\r\n" for h, d, b in zip(head.to_pylist(), digest.to_pylist(), body.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([key, pa.array(records, pa.binary())], ["key", "record"])

    whole = heads.where("kind = 'response'").join(stored, "digest").select("key", "header", "digest", "body")
    again = heads.where("kind = 'revisit'").select("key", "header", "digest", F.lit(None).cast("binary").alias("body"))
    return whole.unionByName(again).mapInArrow(build, "key long, record binary")


def archive_report(spark, at: str, key: str = "page_id") -> DataFrame:
    """Per record, read from its bytes: key, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the payload facts of the response whose record id it names.
    """

    def parse(batches):
        for batch in batches:
            out = []
            for cell in batch.column(1):
                head, _, block = cell.as_py().partition(b"\r\n\r\n")
                fields = {a.decode().lower(): b.decode() for a, b in _FIELD.findall(head)}
                payload = block[: int(fields["content-length"])]
                if block[len(payload) :] != b"\r\n\r\n":
                    raise ValueError("a record's length doesn't fit its block")
                response = fields["warc-type"] == "response"
                if response and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
                    raise ValueError("a record's payload doesn't match its digest")
                out.append((fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), len(payload), fields["warc-payload-digest"].removeprefix("sha1:")))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["key", "kind", "record", "refers", "n", "sha1"])

    scratch = common.Scratch(spark, "warc-report")
    records = scratch.stage(read_records(spark, at).mapInArrow(parse, "key long, kind string, record string, refers string, n long, sha1 string"), "records")
    facts = records.where("kind = 'response'").groupBy(F.col("record").alias("refers")).agg(F.max("key").alias("refers_to"), F.max("n").alias("whole"))
    # responses name no record, so only revisits are joined
    names = [F.col("key").alias(key), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type")]
    first = records.where("kind = 'response'").select(*names, F.lit(None).cast("long").alias("refers_to"))
    again = records.where("kind <> 'response'").drop("n").join(facts.withColumnRenamed("whole", "n"), "refers", "left")
    return first.unionByName(again.select(*names, "refers_to"))
