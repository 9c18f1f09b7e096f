"""WARC archives: a writer with one gzip member a record, and a reader whose tasks each scan a byte range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrace.storage import materialize, shared_path

MAGIC = b"\x1f\x8b\x08"
#: Names and values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIRST_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_READ = 1 << 20


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_of(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits are four letters."""
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(sha1_hex, 5 * i + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda x, k: F.substring(F.lit(ALPHABET), F.shiftright(x, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(words, lambda x: F.concat(*[letter(x, k) for k in range(4)])), "")


def roles(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", min_bytes: int = 0, max_broadcast: int = 200_000
) -> DataFrame:
    """``(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to)`` for every page.

    Only digests and ids are shuffled to find the payloads that occur twice; these come back by a broadcast if
    they are at most ``max_broadcast``, which is counted, else by a join that moves the pages.

    Of equal payloads of at least ``min_bytes`` the row with the largest id is the response and the others revisit
    it; smaller ones are all responses. A null html is an empty payload. A row without an id revisits the largest
    id of its payload, if there is one; repeated rows with the largest id are all responses.
    """

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("payload_bytes", F.octet_length(payload).cast("bigint")).withColumn("payload_digest", base32(F.sha1(payload)))
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    repeated = repeated.agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    repeated = materialize(repeated.select("payload_digest", "largest"), "repeated-payloads")
    if repeated.count() <= max_broadcast:
        repeated = F.broadcast(repeated)
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, html: str | None, n: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + payload_of(html) if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, path: str) -> None:
    """Write ``roles`` rows as archives at ``path``, one gzip member a record, through Spark's committed text sink.

    A member ends in the high byte of its length, zero below 16 MiB. That byte is the sink's line separator, so
    the files hold the members and nothing else. A longer record gets an empty member after it, which ends in zero.
    """

    empty = gzip.compress(b"", mtime=0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                member = gzip.compress(record(page_id, row.url, row.html, row.payload_bytes, row.payload_digest, row.record_type, refers_to), 6, mtime=0)
                if member[-1]:
                    member += empty
                out.append(member[:-1])
            yield pd.DataFrame({"value": out})

    cols = records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    cols.mapInPandas(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Window:
    """A byte window over an open file that moves forward; it keeps what lies behind the last ``drop``."""

    def __init__(self, file, size: int, start: int) -> None:
        self.file, self.size, self.base, self.buf = file, size, start, bytearray()
        file.seek(start)

    def grow(self) -> bool:
        more = self.file.read(_READ) if self.base + len(self.buf) < self.size else b""
        self.buf += more
        return bool(more)

    def drop(self, to: int) -> None:
        del self.buf[: to - self.base]
        self.base = to


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The data and end of a gzip member at ``at`` if it decodes and is empty or begins with a WARC version line."""
    inflate, out, pos, seen = zlib.decompressobj(31), [], at, 0
    try:
        while not inflate.eof:
            if pos >= w.base + len(w.buf) and not w.grow():
                return None
            chunk = w.buf[pos - w.base : pos - w.base + (_READ if seen else 512)]
            out.append(inflate.decompress(chunk))
            pos += len(chunk)
            if seen < 8:
                begin = b"".join(out)[:8]
                seen = len(begin)
                if not VERSION.startswith(begin[:7]):
                    return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, pos - len(inflate.unused_data)) if not data or _FIRST_LINE.match(data) else None


def scan(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each record that starts in [start, end); the last one may end beyond. Empty members are no records."""
    w, at = _Window(file, size, start), start
    while at < end:
        hit = w.buf.find(MAGIC, at - w.base)
        if hit < 0:
            at = max(at, w.base + len(w.buf) - len(MAGIC) + 1)
            w.drop(at)
            if not w.grow():
                return
            continue
        at = w.base + hit
        if at >= end:
            return
        w.drop(at)
        if found := _member(w, at):
            if found[0]:
                yield at, found[0]
            at = found[1]
        else:
            at += 1


def parse(data: bytes) -> dict:
    """Headers of one record and, for a response, its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x else None
    kind = headers["WARC-Type"]
    told = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {
        "page_id": number(headers.get("WARC-Record-ID")),
        "url": headers.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if kind == "response" else told,
        "payload_digest": payload_digest(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": number(headers.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20, payload: bool = False, max_tasks: int = 100_000) -> DataFrame:
    """Records of the archives at ``path``; with ``payload`` also the payload, null for revisits.

    Spark lists the files; each is cut into ranges of ``split_bytes``. Ranges are dealt to as many partitions as
    there are ranges (at most ``max_tasks``, which then read several), so each is a task of its own. A task holds
    one record at a time, whole. It looks for gzip magic in its range, takes a candidate only if its header and the record's first line decode,
    and owns the records that start inside. Within a range it goes from the end of one record to the next, so
    bytes that look like a member inside another are not met. An empty folder gives no rows.
    """
    fields = FIELDS + (", payload binary" if payload else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for name, size, start in zip(pdf["path"], pdf["length"], pdf["start"], strict=True):
                uri = name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_file(inner) as file:
                    held, weight = [], 0
                    for _, data in scan(file, size, start, min(size, start + split_bytes)):
                        held.append(parse(data))
                        weight += len(data) if payload else 256
                        if weight >= 4 << 20:
                            yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            held, weight = [], 0
                    yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start"))
    n_ranges = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    return ranges.repartition(min(int(n_ranges), max_tasks)).mapInPandas(run, fields)


def archive(pages: DataFrame, min_bytes: int = 0, split_bytes: int = 4 << 20) -> DataFrame:
    """Write all pages as archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(roles(pages, min_bytes=min_bytes), path)
    return read(spark, path, split_bytes)
