"""WARC archives: writing captures, reading records, and assembling transactions.

Each capture becomes three records, request, response (or revisit) and metadata;
the request and the metadata name the response in WARC-Concurrent-To.  Records
are text with a two-line record end, so Spark's text writer makes the archive
files, in the shared folder.  Files are read back as binary, cut at Content-Length,
and the records of one transaction meet on the concurrent-to identifier, whichever
file they are in; that gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import rows
from pagewright.plans.session import scratch_path, table

NAME = "op5_warc"

#: Captures in one archive file, at most, and bytes of their payloads, unless one alone has more; a file is read as a whole.
FILE_CAPTURES, FILE_BYTES = 1000, 256 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"


def base32(digest: Column) -> Column:
    """A SHA-1 in hexadecimal digits as base 32: each five digits give four characters."""

    def four(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (row, key, url, payload, payload_bytes, payload_digest, refers_to, refers_to_url); row holds all columns of ``pages``.

    Of rows with equal payloads of ``least_bytes`` bytes at least, that with the
    largest key is kept as it is (refers_to null) and others refer to it and its
    url (of several urls of that key, the largest).  A null payload is an empty
    one.  Rows that repeat the largest key are all kept as they are; a null key
    refers to the largest, unless all are null.  The largest keys are aggregated
    before the shuffle, and the join on the digest can be split.
    """
    own = rows.packed(pages, key=key, url=url, payload=payload)
    full = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    hashed = own.withColumn("sha1", F.sha1(full))
    first = hashed.groupBy("sha1").agg(F.max(F.struct("key", "url")).alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("sha1", "first")
    joined = hashed.join(first, "sha1", "left").withColumns({"payload_bytes": F.octet_length(full).cast("long"), "payload_digest": base32(F.col("sha1"))})
    other = F.col("first.key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key")) & (F.col("payload_bytes") >= least_bytes)
    told = joined.withColumns({"refers_to": F.when(other, F.col("first.key")), "refers_to_url": F.when(other, F.col("first.url"))})
    return told.drop("first", "sha1")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)) for name, value in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), F.concat_ws("", *lines), F.lit("Content-Length: "), size, F.lit(_EOL + _EOL), block)


def _safe(value: Column) -> Column:
    """``value`` for a header line: line ends as percent escapes."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", captured: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one capture per row of ``pages``, as compressed archives below ``path``.

    A revisit names what it repeats by target URI and date.  Captures with payloads
    of which FILE_CAPTURES might pass FILE_BYTES are in files of fewer captures.
    Repeated rows are captures of their own; null urls are empty; an empty table
    gives archives without records; other columns are not read and may have any
    names and types.
    """
    large = FILE_BYTES // FILE_CAPTURES
    most = rows.chosen(pages, payload=payload).agg(F.max(F.octet_length("payload"))).first()[0] or 0
    made = with_revisits(rows.chosen(pages, key=key, url=url, payload=payload), "key", "url", "payload")
    made = made.withColumn("id", F.md5(F.concat_ws("|", F.col("key").cast("string"), F.monotonically_increasing_id())))
    part = lambda name: F.concat(F.lit("<urn:capture:"), F.col("id"), F.lit(f":{name}>"))
    target, digest = _safe(F.col("url")), F.concat(F.lit("sha1:"), F.col("payload_digest"))
    revisit = F.col("refers_to").isNotNull()
    base = [("WARC-Target-URI", target), ("WARC-Date", F.lit(captured))]
    ask = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", part("request")), ("WARC-Concurrent-To", part("response")), *base, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{_EOL}{_EOL}")),
    )
    head = F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}{_EOL}")
    answer = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", part("response")),
            *base,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To-Target-URI", F.when(revisit, _safe(F.col("refers_to_url")))),
            ("WARC-Refers-To-Date", F.when(revisit, captured)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.coalesce(F.col("payload"), F.lit("")))),
    )
    fields = F.concat_ws(
        _EOL,
        F.concat(F.lit("pageId: "), F.col("key").cast("string")),
        F.concat(F.lit("payloadBytes: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("refersTo: "), F.col("refers_to").cast("string")),
        F.lit(""),
    )
    about = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", part("metadata")), ("WARC-Concurrent-To", part("response")), *base, ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    end = _EOL + _EOL
    text = F.concat(ask, F.lit(end), answer, F.lit(end), about)
    fits = F.col("payload_bytes") <= large
    for chosen, captures in ((made.where(fits), FILE_CAPTURES), (made.where(~fits), FILE_BYTES // most)) if most > large else ((made, FILE_CAPTURES),):
        out = chosen.select(text.alias("value")).write.mode("append").option("lineSep", end).option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, captures)).text(path)


RECORD = "type string, record_id string, concurrent_to string, target_uri string, date string, payload_digest string, refers_to_uri string, fields map<string,string>, payload binary, payload_bytes bigint"
#: Packed bytes of an archive that are unpacked at a time.
CHUNK = 1 << 16


def _unpacked(content: bytes) -> Iterator[bytes]:
    """What the gzip members of ``content`` hold, in pieces, or ``content`` itself if it is not packed.

    Where packed bytes are damaged the archive ends.
    """
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    member = zlib.decompressobj(31)
    for at in range(0, len(content), CHUNK):
        left = content[at : at + CHUNK]
        while left:
            try:
                piece = member.decompress(left)
            except zlib.error:
                return
            yield piece
            left = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)


class _Pieces:
    """Pieces of bytes as one; what has been read is given up, so no more than a record is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held += piece
        return piece is not None

    def upto(self, end: bytes) -> bytes | None:
        """What comes before ``end``, which is read as well; None if there is no such end."""
        seen = 0
        while (at := self.held.find(end, seen)) < 0:
            seen = max(0, len(self.held) - len(end))
            if not self._more():
                return None
        return self.take(at + len(end))[:at]

    def seek(self, mark: bytes) -> bool:
        """Gives up what comes before the next ``mark``; whether there is one."""
        while (at := self.held.find(mark)) < 0:
            del self.held[: max(0, len(self.held) - len(mark))]
            if not self._more():
                return False
        del self.held[:at]
        return True

    def take(self, size: int) -> bytes | None:
        """The next ``size`` bytes, or None if there are fewer."""
        while len(self.held) < size:
            if not self._more():
                return None
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parse_records(content: bytes, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, cut at Content-Length; a truncated last record is left out.

    A record whose Content-Length is no whole number is left out, and what lies
    between records: reading goes on at the next record's first line.
    """
    data = _Pieces(_unpacked(content))
    while data.seek(b"WARC/1.") and (front := data.upto(b"\r\n\r\n")) is not None:
        lines = front.decode(errors="replace").split(_EOL)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = head.get("content-length") or "0"
        if not re.fullmatch("[0-9]{1,18}", size):
            continue
        block = data.take(int(size))
        if block is None:
            return
        data.take(4)
        kind = head.get("warc-type")
        row = {"type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to_uri": head.get("warc-refers-to-target-uri")}
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
            made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row |= {"payload_digest": made if kind == "response" else (head.get("warc-payload-digest") or "").removeprefix("sha1:"), "payload_bytes": len(payload)}
            row |= {"payload": payload} if with_payload else {}
        elif kind == "metadata":
            row["fields"] = [(k, v.strip()) for k, _, v in (x.partition(":") for x in block.decode(errors="replace").split(_EOL)) if k]
        yield row


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of RECORD from the archives below ``path``; the digest of a response is that of the bytes read.

    Without ``with_payload`` payloads stay in the task that has read them.  A task
    holds an archive as it is packed, and of its contents one record and one batch.
    """
    schema = pa.schema([(c, pa.string()) for c in ("type", "record_id", "concurrent_to", "target_uri", "date", "payload_digest", "refers_to_uri")])
    schema = schema.append(pa.field("fields", pa.map_(pa.string(), pa.string()))).append(pa.field("payload", pa.binary())).append(pa.field("payload_bytes", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                held, size = [], 0
                for row in parse_records(content, with_payload):
                    held.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row (capture_id, request, response, metadata) per capture.

    Records meet on WARC-Concurrent-To, or their own identifier without one; of
    several records of a kind in one capture the smallest stays.  A part that is
    missing is null; without records there are no captures.
    """
    body = F.struct("record_id", "type", "target_uri", "date", "refers_to_uri", "payload_digest", "payload_bytes", "payload")
    by = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    short = F.struct("record_id", "target_uri", "date")
    return by.groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "request", short)).alias("request"),
        F.min(F.when(F.col("type").isin("response", "revisit"), body)).alias("response"),
        F.min(F.when(F.col("type") == "metadata", F.struct("record_id", F.array_sort(F.map_entries("fields")).alias("fields")))).alias("metadata"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path)
    captures = assemble(read_records(spark, path, with_payload=False))
    field = lambda name: F.map_from_entries("metadata.fields")[name]
    kind = rows.kind(pages, "page_id")
    return captures.select(
        field("pageId").cast(kind).alias("page_id"),
        F.when(F.col("response.type") == "response", F.col("response.payload_bytes")).otherwise(field("payloadBytes").cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        field("refersTo").cast(kind).alias("refers_to"),
    )


_FOURS = " || ".join(
    f"substr('{_BASE32}', (((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {s}) & 31) + 1)::INTEGER, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
ORACLE_SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
sized AS (SELECT *, {_FOURS} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM sized
"""
