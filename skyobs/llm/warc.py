"""Legacy ARC archives to WARC: parse, convert, write with revisits, read back."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.llm.runtime import in_batches, spread_join

# Fixed values of the ARC 1 and 2 formats: fields of a record's header line, in order.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
# Fixed values of the WARC 1.0 and 1.1 formats.
CRLF, REVISIT_PROFILE = b"\r\n", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Uncompressed bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 4 << 20
#: The HTTP header in which a capture of a page states the page's id; when the captures begin; seconds over which they spread.
NUMBER_HEADER, CAPTURED, SPREAD = "X-Page-Id", datetime(2001, 1, 1, tzinfo=UTC), 1 << 28
_ID_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record").int >> 64 << 64


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes
    place: int = 0


    @property
    def opens_file(self) -> bool:
        """Whether this is the version block of a file."""
        return self.place == 0 and self.fields["url"].startswith("filedesc://")


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""


def arc_file_header(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 -\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'code': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in ARC_FIELDS[version])}\n".encode()
    given = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "code": "200", "offset": "0", "filename": name}
    return _arc_line(version, given, len(body)) + body + b"\n"


def _arc_line(version: int, given: dict[str, str], length: int) -> bytes:
    values = (given | {"length": str(length)}).get
    return (" ".join((values(f) or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_record(version: int, given: dict[str, str], body: bytes) -> bytes:
    return _arc_line(version, given, len(body)) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an uncompressed ARC file, its version block first, cut by their declared lengths.

    The version block is the first record, if its url begins with filedesc://; its text names the version,
    or else the number of fields in its line does. Without one, the number of fields of the first line
    tells the version. Any later record is a capture, whatever its url. A line with the wrong number of
    fields, a length that is no number or runs past the end, raises ValueError.
    """
    at, version, place = 0, None, 0
    by_width = {len(v): k for k, v in ARC_FIELDS.items()}
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the header line doesn't end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line:  # between records
            at = end + 1
            continue
        parts = line.split(" ")
        if version is None:
            version = by_width.get(len(parts))
        if version == 1 and len(parts) > 5:  # a content type with parameters
            parts = [*parts[:3], " ".join(parts[3:-1]), parts[-1]]
        if version is None or len(parts) != len(ARC_FIELDS[version]):
            raise ValueError(f"not a header line: {line[:80]}")
        fields = dict(zip(ARC_FIELDS[version], parts, strict=True))
        if not (fields["length"].isascii() and fields["length"].isdigit()) or end + 1 + int(fields["length"]) > len(data):
            raise ValueError(f"wrong length in {line[:80]}")
        body = data[end + 1 : end + 1 + int(fields["length"])]
        at = end + 1 + len(body)
        found = ArcRecord(version, fields, body, place)
        if found.opens_file:
            stated = body.split(b" ", 1)[0]
            version = int(stated) if stated in (b"1", b"2") else version
        yield found
        place += 1


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(number: int | None, url: str, date: str, digest: str) -> str:
    """A URN that is the same in every run; a number that is given can be read from it again."""
    if number is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"
    return f"<urn:uuid:{uuid.UUID(int=_ID_SPACE | number & (1 << 64) - 1)}>"


def number_of(urn: str | None) -> int | None:
    """The number in an identifier that record_id made from one."""
    if not urn:
        return None
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 != _ID_SPACE >> 64:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a shorter start of it, as an ISO 8601 time in UTC."""
    full = arc_date + "00000101000000"[len(arc_date) :]
    if len(full) != 14 or not (full.isascii() and full.isdigit()):
        raise ValueError(f"not a time: {arc_date[:40]}")
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Header block with its empty line, and payload; no header block: all is payload."""
    if body.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (at := body.find(mark)) >= 0:
                return body[: at + len(mark)], body[at + len(mark) :]
    return b"", body


def header_value(head: bytes, name: str) -> str | None:
    """The value of the first header of that name in an HTTP header block."""
    mark = name.lower().encode() + b":"
    return next((line[len(mark) :].strip().decode("latin-1") for line in head.split(b"\n") if line[: len(mark)].lower() == mark), None)


def page_number(head: bytes) -> int | None:
    """The page id that a capture states."""
    value = header_value(head, NUMBER_HEADER)
    return int(value) if value and value.lstrip("-").isdigit() else None


def convert(arc: ArcRecord, number: int | None = None, refers_to: int | None = None) -> WarcRecord:
    """The WARC record equivalent to an ARC record.

    The version block becomes 'warcinfo'. HTTP captures become 'response', or 'revisit' without their
    payload if refers_to is given; others become 'resource'. Identifier, time, content type, block and
    payload digests are synthesised; the time is the capture's.
    """
    if arc.opens_file:
        block = b"".join(f"{k}: {v}".encode() + CRLF for k, v in (("format", "WARC File Format 1.0"), ("description", f"converted from an ARC file of version {arc.version}"), ("arc-file", arc.fields["url"].removeprefix("filedesc://"))))
        date = warc_date(arc.fields["date"])
        headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, arc.fields["url"], date, base32_sha1(block)), "WARC-Date": date, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/warc-fields"}
        return WarcRecord(headers | {"Content-Length": str(len(block))}, block)
    head, payload = split_http(arc.body)
    digest, date = base32_sha1(payload), warc_date(arc.fields["date"])
    kind = "resource" if not head else "response" if refers_to is None else "revisit"
    block = head if kind == "revisit" else arc.body
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(number, arc.fields["url"], date, digest),
        "WARC-Date": date,
        "WARC-Target-URI": arc.fields["url"],
        "WARC-IP-Address": arc.fields["ip"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response" if head else arc.fields["type"],
    }
    if kind == "revisit":
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, "", "", "")}
    return WarcRecord(headers | {"Content-Length": str(len(block))}, block)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = b"".join(f"{k}: {v}".encode() + CRLF for k, v in record.headers.items())
    return b"WARC/1.0" + CRLF + lines + CRLF + record.block + CRLF + CRLF


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of uncompressed WARC bytes, cut by their declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        start, length = end + 4, int(headers["Content-Length"])
        if start + length + 4 > len(data):
            raise ValueError("the record is cut off")
        yield WarcRecord(headers, data[start : start + length])
        at = start + length + 4


def gunzip_members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    while data:
        member = zlib.decompressobj(31)
        content = member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        yield content
        data = member.unused_data


def gzip_member(data: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def unpacked(content: bytes) -> bytes:
    """An archive's uncompressed bytes; plain ones are themselves."""
    return b"".join(gunzip_members(content)) if content[:2] == b"\x1f\x8b" else content


def page_as_arc(number: int | None, url: str | None, html: bytes, version: int, date: str) -> bytes:
    """A legacy capture of a page: an ARC record of an HTTP response that states the page's id."""
    stated = "" if number is None else f"{NUMBER_HEADER}: {number}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{stated}Content-Length: {len(html)}\r\n\r\n".encode()
    return arc_record(version, {"url": url or "-", "ip": "0.0.0.0", "date": date, "type": "text/html", "code": "200"}, head + html)


def capture_date(number: int | None) -> str:
    """When a page is said to have been captured: a second for each id."""
    return (CAPTURED + timedelta(seconds=(number or 0) % SPREAD)).strftime("%Y%m%d%H%M%S")


def arc_files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Legacy archives (file string, content binary) of pages: a version block and many captures each, a gzip member a record.

    A file ends at about ARCHIVE_BYTES, so a task holds one file and one slice of pages at a time. Files
    whose first page has an odd id are of version 1, others of version 2. A file's name begins with the
    partition it was made from and its number there, so no two are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size, version, begun = 0, 2, ""

        def close() -> pa.RecordBatch:
            name = f"{task:06d}-{made:06d}.arc.gz"
            content = gzip_member(arc_file_header(version, name, begun)) + b"".join(held)
            return pa.RecordBatch.from_pydict({"file": [name], "content": pa.array([content], pa.binary())})

        for batch in batches:
            for number, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    version, begun = (1 if (number or 0) % 2 else 2), capture_date(number)
                legacy = page_as_arc(number, url, html, version, capture_date(number))
                held.append(gzip_member(legacy))
                size += len(legacy)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return in_batches(pages.select(F.col(id_col).cast("long").alias("number"), F.col(url_col).alias("url"), html.alias("html")), run, "file string, content binary")


def arc_source(spark: SparkSession, path: str) -> DataFrame:
    """ARC files under a path, plain or gzipped, as (file string, content binary) rows for arc_records and to_warc."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def arc_records(files: DataFrame) -> DataFrame:
    """A row for each capture in ARC files (file, content): file, place (from 1 after a version block), version, url, ip, date, type, number, payload_bytes, digest, error.

    date is as the file states it. number is the page id that a capture states, or null. A null or unreadable
    file gives a row with place -1 and the reason in error after those of the records before the flaw.
    """
    names = ["file", "place", "version", "url", "ip", "date", "type", "number", "payload_bytes", "digest", "error"]
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c for c in batch.columns), strict=True):
                rows: list[tuple] = []
                try:
                    for arc in parse_arc(unpacked(content.as_py() or b"")):
                        if arc.opens_file:
                            continue
                        head, payload = split_http(arc.body)
                        f = arc.fields
                        rows.append((name.as_py(), arc.place, arc.version, f["url"], f["ip"], f["date"], f["type"], page_number(head), len(payload), base32_sha1(payload), None))
                except (ValueError, zlib.error) as e:
                    rows.append((name.as_py(), -1, *[None] * 8, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return in_batches(files.select("file", "content"), run, "file string, place long, version int, url string, ip string, date string, type string, number long, payload_bytes long, digest string, error string")


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """file, place and original of the records that revisit another: the smallest number of those with equal payloads.

    Payloads under least_bytes revisit nothing; neither do equals whose numbers are all null, nor records with the
    smallest number itself. The digests are grouped by partial aggregates; hot ones are spread.
    """
    slim = records.filter(F.col("error").isNull() & (F.col("payload_bytes") >= least_bytes)).select("file", "place", "number", "digest")
    first = slim.groupBy("digest").agg(F.min("number").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = spread_join(slim, first, "digest", "n", ["file", "place"])
    return found.filter("original is not null and not (number <=> original)").select("file", "place", "original")


def to_warc(files: DataFrame, again: DataFrame) -> DataFrame:
    """Archives (archive string, records long, content binary), one for each ARC file; again is what `revisits` found.

    Files are dealt by name with the list of their revisits, which is bounded by the file; pages never are.
    An unreadable file raises ValueError.
    """
    listed = again.groupBy("file").agg(F.collect_list(F.struct("place", "original")).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, found in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("file", "content", "again")), strict=True):
                originals = {r["place"]: r["original"] for r in found.as_py() or []}
                members = []
                for arc in parse_arc(unpacked(content.as_py() or b"")):
                    number = None if arc.opens_file else page_number(split_http(arc.body)[0])
                    members.append(gzip_member(warc_bytes(convert(arc, number, originals.get(arc.place)))))
                archive = name.as_py().removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
                yield pa.RecordBatch.from_pydict({"archive": [archive], "records": pa.array([len(members)], pa.int64()), "content": pa.array([b"".join(members)], pa.binary())})

    return in_batches(files.join(listed, "file", "left"), run, "archive string, records long, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record but 'warcinfo' of (content binary) archives: number, record_type, payload_bytes, payload_digest, refers_to, record_id, date, url.

    payload_bytes of a revisit is the length that its HTTP header states, as its payload isn't stored. A
    payload that doesn't have the digest that its record states raises ValueError.
    """
    names = ["number", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "date", "url"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in parse_warc(unpacked(content.as_py() or b"")):
                    h = r.headers
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(r.block)
                    length = int(header_value(head, "Content-Length") or 0) if h["WARC-Type"] == "revisit" else len(payload)
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} is wrong")
                    rows.append((number_of(h["WARC-Record-ID"]), h["WARC-Type"], length, digest, number_of(h.get("WARC-Refers-To")), h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return in_batches(archives.select("content"), run, "number long, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, date string, url string")


def write_files(archives: DataFrame, folder: str, name_col: str = "archive") -> DataFrame:
    """Write each archive to a file of its own in a folder that all executors mount, and return name and bytes.

    A file appears under its name once it is whole, so tasks that run again do no harm. The rows are written
    when the result is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                draft = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(draft, "wb") as f:
                    f.write(content)
                os.replace(draft, os.path.join(folder, os.path.basename(name)))
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([len(content)], pa.int64())})

    return in_batches(archives.select(name_col, "content"), run, "name string, bytes long")


def write_and_read(pages: DataFrame, folder: str) -> DataFrame:
    """Capture pages in ARC files, convert those to WARC archives and read all of them back; see read_archives.

    The new folder may be in any file system that Spark writes; it holds a table of each kind, with one row
    an archive. Null html is an empty payload, null urls become '-', null ids get identifiers from url and
    digest and are responses unless an equal page has an id. Pages with the same id and payload are all
    responses. Other columns are ignored; an empty table gives an empty one.
    """
    spark: SparkSession = pages.sparkSession
    arc_files(pages).write.mode("errorifexists").option("compression", "uncompressed").parquet(f"{folder}/arc")
    files = spark.read.schema("file string, content binary").parquet(f"{folder}/arc")
    records = arc_records(files).select("file", "place", "number", "digest", "payload_bytes", "error")
    records.write.parquet(f"{folder}/records")
    known = spark.read.schema(records.schema).parquet(f"{folder}/records")
    to_warc(files, revisits(known)).write.option("compression", "uncompressed").parquet(f"{folder}/warc")
    return read_archives(spark.read.schema("archive string, records long, content binary").parquet(f"{folder}/warc"))
