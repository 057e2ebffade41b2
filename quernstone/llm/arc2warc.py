"""Conversion of legacy ARC archives to WARC records.

An ARC file is a sequence of records: a header line, as many bytes of content as it declares, and a line feed. The
first record ("filedesc://") carries the version block, which says whether header lines are those of version 1
(URL IP-address Archive-date Content-type Archive-length) or version 2 (URL IP-address Archive-date Content-type
Result-code Checksum Location Offset Filename Archive-length). Fields are separated by single spaces and the last is
the length; a URL with blanks is taken as all that stands before the last fields.

Each record becomes one WARC/1.0 record: the version block a warcinfo, HTTP responses (content that begins with a
status line) response, dns: lookups and other content resource. Record identifiers are name-based UUIDs of URL, date
and digest, so that a conversion that is repeated gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quernstone.llm.common import arrow_map

FIELDS = {"1": 5, "2": 10}
CERTAIN = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:\S.* \S+ (?:\d{14}|\d{12}|\d{8}) \S+(?: \d{3} \S+ \S+ \d+ \S+)? \d+")
STATUS = re.compile(rb"HTTP/\d(?:\.\d)? +(\d{3})")
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")

SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("position", pa.int64()), ("warc_type", pa.string()), ("warc_record_id", pa.string()), ("warc_date", pa.string()),
    ("warc_target_uri", pa.string()), ("warc_ip_address", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("http_status", pa.int32()),
    ("warc_block_digest", pa.string()), ("warc_payload_digest", pa.string()), ("error", pa.string()), ("warc", pa.binary()),
])
DDL = (
    "page_id long, position long, warc_type string, warc_record_id string, warc_date string, warc_target_uri string, warc_ip_address string, content_type string, "
    "content_length long, http_status int, warc_block_digest string, warc_payload_digest string, error string, warc binary"
)


def digest(data: bytes | memoryview) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(stamp: str) -> str | None:
    """W3C date of a stamp of 14, 12 or 8 digits, missing parts as zero; None for any other."""
    if not re.fullmatch(r"\d{14}|\d{12}|\d{8}", stamp):
        return None
    try:
        return datetime.strptime(stamp.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def header(line: bytes, fields: int) -> tuple[str, list[str], int] | None:
    """URL, the other fields but the length, and the length; None if the line is not such a header."""
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", fields - 1)
    if len(parts) != fields or not parts[0] or not parts[-1].isdigit():
        return None
    return parts[0], parts[1:-1], int(parts[-1])


def certain(line: bytes) -> bool:
    """Whether a line is a header beyond doubt: a URL with a scheme, a stamp of digits at the place of the date, a media type, a length. Asked where a header is looked for in the midst of other text."""
    return CERTAIN.fullmatch(line.rstrip(b"\r")) is not None


def inflate(data: bytes) -> tuple[bytes, bool]:
    """Data of all gzip members in a row, and whether the last one broke off; data that is not compressed as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            return b"".join(out), True
        if not member.eof:
            return b"".join(out), True
        data = member.unused_data.lstrip(b"\0")
    return b"".join([*out, data]), False


def convert(data: bytes) -> Iterator[tuple]:
    """Rows (without page_id) of the records of one ARC file or fragment, plain or as gzip members.

    A fragment without a version block is of version 1, or of version 2 where its first header only parses so. Where a
    header should stand and none does, everything up to the next line that is one beyond doubt gives a row of error
    malformed_header, with the first such line as its URI, and reading goes on there. Content shorter than declared
    gives what there is with error truncated (and WARC-Truncated). A date that cannot be read leaves warc_date null with
    error bad_date; the record, which must have a date, gets that of the record before it, or the epoch if there is none.
    A gzip member that breaks off or is damaged gives what could be read and a row of error bad_gzip at the end.
    """
    data, broken = inflate(data)
    at, position, fields, known = 0, 0, None, "1970-01-01T00:00:00Z"
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        if fields is None:
            fields = FIELDS["2"] if header(line, FIELDS["2"]) and re.search(rb" \d{3} \S+ \S+ \d+ \S+ \d+\r?$", line) else FIELDS["1"]
        got = header(line, fields)
        if got is None:
            yield (position, None, None, None, line.decode("utf-8", "replace"), None, None, None, None, None, None, "malformed_header", None)
            position += 1
            at = end + 1
            while at < len(data):
                end = data.find(b"\n", at)
                end = len(data) if end < 0 else end
                if certain(data[at:end]) and header(data[at:end], fields):
                    break
                at = end + 1
            continue
        url, others, length = got
        body = data[end + 1 : end + 1 + length]
        short = len(body) < length
        error = "truncated" if short else None
        at = end + 1 + length
        status, payload, kind, mime = None, body, "resource", others[2]
        if url.startswith("filedesc:"):
            kind, mime = "warcinfo", "application/warc-fields"
            version = body.split(b"\n", 1)[0].split(b" ", 1)[0].decode("ascii", "replace")
            fields = FIELDS.get(version, fields)
            names = body.split(b"\n", 2)
            name = url.partition("://")[2]
            body = b"software: arc2warc\r\nformat: WARC File Format 1.0\r\narc-version: " + version.encode() + b"\r\narc-file: " + name.encode() + (b"\r\narc-origin: " + names[0].split(b" ", 2)[2].strip() if names[0].count(b" ") >= 2 else b"") + b"\r\n"
            payload = body
        elif (m := STATUS.match(body)) is not None:
            kind, mime, status = "response", "application/http; msgtype=response", int(m[1])
            head = re.search(rb"\r?\n\r?\n", body)
            payload = body[head.end() :] if head else b""
        elif url.startswith("dns:"):
            mime = "text/dns"
        date = iso_date(others[1])
        error = error or ("bad_date" if date is None else None)
        known = date or known
        block = digest(body)
        own = digest(payload) if payload is not body else block
        name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, others[1], block)))}>"
        ip = others[0] if kind != "warcinfo" and others[0] not in ("", "-", "0.0.0.0") else None
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {known}"]
        if kind == "warcinfo":
            lines.append(f"WARC-Filename: {url.partition('://')[2]}")
        else:
            lines.append(f"WARC-Target-URI: {url}")
        if ip:
            lines.append(f"WARC-IP-Address: {ip}")
        if short:
            lines.append("WARC-Truncated: unspecified")
        lines += [f"WARC-Block-Digest: {block}", f"WARC-Payload-Digest: {own}", f"Content-Type: {mime}", f"Content-Length: {len(body)}"]
        warc = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
        yield (position, kind, name, date, url, ip, mime, len(body), status, block, own, error, warc)
        position += 1
    if broken:
        yield (position, *[None] * 10, "bad_gzip", None)


def warc_records(archives: DataFrame) -> DataFrame:
    """WARC records, one row each, of every (page_id, arc) row, arc being the bytes of an ARC file or fragment.

    Null or empty arc has no records; a null page_id is passed through; repeated rows give their records each. See
    convert for malformed input, which gives rows with error set and never fails. Content of any length is used
    whole. Columns other than page_id and arc are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows, size = [], 0
            for page, arc in zip(got["page_id"].to_pylist(), got["arc"]):
                data = arc.as_py()
                for row in convert(data or b""):
                    rows.append((page, *row))
                    size += len(row[-1] or b"")
                if size > 8 << 20:
                    yield table(rows)
                    rows, size = [], 0
            if rows:
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    return arrow_map(archives.select(F.col("page_id").cast("long").alias("page_id"), "arc"), run, DDL)


def arc_fragment(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of an ARC fragment that holds a page as an HTTP response: a version block and the page, of version 1 for even ids and 2 for odd."""
    body = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), "utf-8"), F.encode(html, "utf-8"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(page_id, F.lit(500_000_000))), "yyyyMMddHHmmss")
    ip = F.concat(F.lit("10."), (F.pmod(page_id, F.lit(250)) + 1).cast("string"), F.lit(".0.1"))
    two = F.pmod(page_id, F.lit(2)) == 1
    length = F.octet_length(body).cast("string")
    legend = F.when(two, F.lit("2 0 crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")).otherwise(F.lit("1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n"))
    name = F.concat(F.lit("filedesc://"), page_id.cast("string"), F.lit(".arc"))
    ahead = F.concat_ws(" ", name, F.lit("0.0.0.0"), stamp, F.lit("text/plain"), F.when(two, F.lit("200 - - 0 -")), F.octet_length(legend).cast("string"))
    line = F.concat_ws(" ", url, ip, stamp, F.lit("text/html"), F.when(two, F.concat_ws(" ", F.lit("200"), F.md5(body), F.lit("- 0"), F.concat(page_id.cast("string"), F.lit(".arc")))), length)
    return F.concat(F.encode(F.concat(ahead, F.lit("\n"), legend, F.lit("\n"), line, F.lit("\n")), "utf-8"), body, F.encode(F.lit("\n"), "utf-8"))


def convert_pages(pages: DataFrame) -> DataFrame:
    """WARC records of every page, by way of its ARC fragment. Pages with null page_id, url or html have no archive."""
    kept = pages.filter("page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL")
    return warc_records(kept.select("page_id", arc_fragment(F.col("page_id").cast("long"), F.col("url"), F.col("html")).alias("arc")))
