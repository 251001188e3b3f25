"""WARC archives: records with equal payloads become revisits of one response, and archives are read back.

Headers alone (page id and payload digest, no payload) are shuffled by digest; the largest page id of a
digest is the response. The answer is joined to the pages by page id and digest, so a payload that a third of all
pages share weighs no more than its headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import put_file, shared_files, slices, small_batches

#: Compressed bytes that are unpacked at a time.
WINDOW = 16_384
#: Salts over which the pages of a digest are dealt.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Per different (page_id, digest): page_id, digest, refers_to, which is null for responses, and refers_uri, the url of what
    is referred to (of several with its page_id and payload, the largest).

    Payloads are the html in UTF-8 (null: empty). Of equal payloads of at least least_bytes bytes the one with the
    largest page_id is the response; smaller ones are all responses. A null page_id is smaller than any
    other; pages that repeat page_id and payload have one answer.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    headers = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    firsts = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"))
    # A digest that very many pages share is joined to salt by salt.
    dealt = headers.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    known = dealt.select("digest", "salt").distinct().join(firsts, "digest", "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return dealt.join(known, ["digest", "salt"]).select("page_id", "digest", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_uri"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header_value(text: str) -> str:
    """One line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def sha1_label(data: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(data).digest()).decode()}"


def member(headers: list[str], block: bytes) -> bytes:
    """A record with the digest and length of its block, compressed as a gzip member of its own."""
    lines = ["WARC/1.1", *headers, f"WARC-Block-Digest: {sha1_label(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    fields = b"software: orrery\r\nformat: WARC File Format 1.1\r\n"
    return member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_uri: str | None, date: str) -> bytes:
    """The record of a page: a response, or a revisit of the page refers_to. The whole run writes one date, so a
    response is as old as what revisits it."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    again = refers_to is not None
    headers = [
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest.hexdigest())}",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {header_value(url)}"]),
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest.hexdigest())}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"] if again else []),
        *([f"WARC-Refers-To-Target-URI: {header_value(refers_uri)}"] if again and refers_uri is not None else []),
        "Content-Type: application/http;msgtype=response",
    ]
    return member(headers, http if again else http + payload)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        unpacker, parts = zlib.decompressobj(wbits=31), []
        while not unpacker.eof and at < len(archive):  # in windows: what a member leaves of one is small
            window = view[at : at + WINDOW]
            parts.append(unpacker.decompress(window))
            at += len(window) - len(unpacker.unused_data)
        whole = b"".join(parts) + unpacker.flush()
        head, _, body = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        yield fields, body[: int(fields["content-length"])]


def write_archives(pages: DataFrame, least_bytes: int = 1000, bytes_per_file: int = 16_000_000, date: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record per row of pages, repeated ones too; returns the folder and the list of the archives (name, n_records: of
    pages). date, by default now, stands in every header. Null html is an empty payload; a null url or page_id has no
    header. An empty table has no archives.

    An archive ends when its payloads reach bytes_per_file; that much a task holds. Attempts write under names of their
    own, and only archives of those that succeeded are listed.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_files(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    found = resolve(pages, least_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to", "refers_uri")
    joined = whole.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            put_file(folder, name, b"".join([info(name, date), *held]))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["name", "n_records"])

        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "refers_uri")), strict=True):
                held.append(record(*row, date))
                size += len(row[2])
                if size >= bytes_per_file:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    joined.select("page_id", "url", "payload", "refers_to", "refers_uri").mapInArrow(run, "name string, n_records long").write.parquet(f"{folder}-list")
    return folder, spark.read.parquet(f"{folder}-list")


def read_archives(folder: str, listed: DataFrame) -> DataFrame:
    """Per record of the listed archives: page_id, url, record_id, payload_bytes, payload_digest (hex), record_type,
    refers_to (page id) and payload (null for revisits). Length and digest of responses are taken from the payload
    that was read, those of revisits from the headers."""
    spark = listed.sparkSession
    small_batches(spark)
    names = ["page_id", "url", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def parsed(fields: dict[str, str], block: bytes) -> tuple:
        number = lambda name: int(fields[name]) if name in fields else None
        common = (number("x-page-id"), fields.get("warc-target-uri"), fields["warc-record-id"])
        if fields["warc-type"] == "revisit":
            digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
            return (*common, number("x-payload-length"), digest, "revisit", number("x-refers-to-page-id"), None)
        payload = block.partition(b"\r\n\r\n")[2]
        return (*common, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows, size = [], 0
                for fields, block in records(content):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    rows.append(parsed(fields, block))
                    size += len(block)
                    if size > 4_000_000 or len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    own = files.join(listed.select("name"), "name", "left_semi").select("content")
    return own.mapInArrow(run, "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
