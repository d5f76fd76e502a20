"""WARC: pages as records of monolithic gzip archives, normalised to one gzip member a record with an offset index."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common

#: Raw bytes after which an archive ends, and payload bytes from which an equal one is a revisit.
ARCHIVE_BYTES, REVISIT_BYTES = 8 << 20, 1000
#: Repeated payloads whose digests may be broadcast (20 bytes and a number each).
BROADCAST_DIGESTS = 300_000
LEVEL = 6


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of REVISIT_BYTES or more the largest page_id is referred to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    long_ = F.octet_length("html") >= REVISIT_BYTES
    keyed = rows.withColumn("sha", F.when(long_, F.unhex(F.sha1("html"))))
    same = keyed.filter(long_).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    same = common.cut(same, "same")
    if same.count() <= BROADCAST_DIGESTS:
        found = keyed.join(F.broadcast(same), "sha", "left")
    else:
        short = keyed.filter("sha is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
        found = common.join_hot(keyed.filter("sha is not null"), same, ["sha"], "n", "left").select(*short.columns).unionByName(short)
    return found.select("page_id", "url", "html", F.when(F.col("refers_to") != F.col("page_id"), F.col("refers_to")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if refers_to is not None else payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI: " + " ".join((url or "").split()), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def write_archives(rows: DataFrame) -> DataFrame:
    """One row an archive: a single gzip stream over its records, as crawlers write that don't mind random access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, parts, size = zlib.compressobj(LEVEL, wbits=31), [], 0
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page, url, html.encode(), refers)
                parts.append(pack.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, pack.flush()])], pa.binary())], ["archive"])
                    pack, parts, size = zlib.compressobj(LEVEL, wbits=31), [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, pack.flush()])], pa.binary())], ["archive"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(common.tidy(run), "archive binary")


def records(stream: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """Whole records of a gzip file of any number of members, inflated once and a step at a time."""
    inflate, held = zlib.decompressobj(wbits=31), bytearray()
    rest, at = b"", 0
    while True:
        if inflate.eof and rest:
            inflate = zlib.decompressobj(wbits=31)
        if rest:
            held += inflate.decompress(rest)
            rest = inflate.unused_data
        elif at < len(stream):
            held += inflate.decompress(stream[at : at + step])
            rest = inflate.unused_data
            at += step
        else:
            break
        begin = 0
        while (head := held.find(b"\r\n\r\n", begin)) >= 0:
            length = int(next(x for x in bytes(held[begin:head]).split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
            stop = head + 4 + length + 4
            if len(held) < stop:
                break
            yield bytes(held[begin:stop])
            begin = stop
        del held[:begin]
    if held:
        raise ValueError("the archive ends within a record")


MEMBERS = "members binary, offsets array<struct<at:long,size:long>>"


def normalise(archives: DataFrame) -> DataFrame:
    """Each archive with every record a gzip member of its own, and the sidecar index: each member's place and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                parts, index, at = [], [], 0
                for raw in records(cell.as_buffer().to_pybytes()):
                    parts.append(zlib.compress(raw, LEVEL, wbits=31))
                    index.append({"at": at, "size": len(parts[-1])})
                    at += len(parts[-1])
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([index], pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())])))], ["members", "offsets"])

    return archives.mapInArrow(common.tidy(run), MEMBERS)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    return fields, body[: int(fields["content-length"])]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, member_at long, member_size long"


def read_records(normalised: DataFrame) -> DataFrame:
    """Records read by the index, each from its own member: a response's digest and length are those of its payload."""

    def number(x: str | None) -> int | None:
        digits = (x or "").rstrip(">").rpartition(":")[2]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            for cell, index in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                file, rows = memoryview(cell.as_buffer()), []
                for place in index:
                    fields, body = parse(zlib.decompress(file[place["at"] : place["at"] + place["size"]], wbits=31))
                    stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                    if fields["warc-type"] == "response":
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                        if digest != stated:
                            raise ValueError("a payload does not have its digest")
                    else:
                        size, digest = int(fields["x-payload-length"]), stated
                    rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to")), fields["warc-target-uri"], place["at"], place["size"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])

    return normalised.mapInArrow(common.tidy(run), READ)


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archives as written and as normalised, both tables in the shared folder.

    Null html is an empty payload, a null url an empty URI; of rows with one page_id each is a record, and rows
    that repeat a page whole stay responses; a null page_id is never referred to.
    """
    common.tune(pages.sparkSession)
    raw = common.cut(write_archives(decide(pages)), "archives", "none")
    return raw, common.cut(normalise(raw), "members", "none")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = archive(common.table(spark, sf_dir, "pages"))
    return read_records(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to FROM q
"""
