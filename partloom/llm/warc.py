"""Legacy archive converter: ARC records to equivalent WARC records.

An archive is a row of a table: its name and its bytes, a chain of gzip
members, one for each record, as in .arc.gz and .warc.gz files.  Rows hold a
bounded number of records, so archives of any total size convert in parallel.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import materialize, small_batches

#: Header fields of the two ARC versions, and the record kinds' media types (fixed by the formats).
ARC_FIELDS = {
    b"1": ["url", "ip", "date", "content_type", "length"],
    b"2": ["url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_RESPONSE = "application/http; msgtype=response"
GZIP_LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    offset: int
    block: bytes

    @property
    def payload_at(self) -> int:
        """Where the payload starts: behind the HTTP head, if there is one."""
        if self.block[:5] != b"HTTP/":
            return 0
        end = self.block.find(b"\r\n\r\n")
        return end + 4 if end >= 0 else len(self.block)


def write_arc(name: str, version: bytes, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """records: url, ip, 14-digit date, content type, block."""
    title = version + b" 0 partloom\n" + ARC_TITLES[version] + b"\n"
    dashes = b" 200 - - 0 " + name.encode() if version == b"2" else b""
    first = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain".encode() + dashes
    members = [first + b" %d\n" % len(title) + title + b"\n"]
    for url, ip, date, kind, block in records:
        line = " ".join([url.replace(" ", "%20").replace("\n", "%0A") or "-", ip, date, kind]).encode()
        members.append(line + dashes + b" %d\n" % len(block) + block + b"\n")
    return b"".join(gzip.compress(m, GZIP_LEVEL, mtime=0) for m in members)


def members(data: bytes, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, inflated piece by piece, so that
    a long archive isn't copied for each of its records."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, used, out = zlib.decompressobj(31), 0, []
        while not one.eof:
            piece = view[at + used : at + used + step]
            if not len(piece):
                raise ValueError(f"the gzip member at {at} is cut off")
            out.append(one.decompress(piece))
            used += len(piece) - len(one.unused_data)
        yield at, b"".join(out)
        at += used


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block; ValueError says what is wrong."""
    fields: list[str] | None = None
    for offset, content in members(data):
        line, _, rest = content.partition(b"\n")
        if fields is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("no version block")
            fields = ARC_FIELDS.get(rest[:1])
            if fields is None:
                raise ValueError(f"unknown ARC version {rest[:1]!r}")
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if len(parts) != len(fields):
            raise ValueError(f"a header line of {len(parts)} fields at {offset}")
        head = dict(zip(fields, parts, strict=True))
        if not head["length"].isdigit():
            raise ValueError(f"no length in the header line at {offset}")
        length = int(head["length"])
        if length > len(rest):
            raise ValueError(f"the record at {offset} is shorter than it declares")
        yield ArcRecord(head["url"], head["ip"], head["date"], head["content_type"], offset, rest[:length])


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def record_id(archive: str, offset: int) -> str:
    """The same record of the same archive always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """An ARC date of 8 to 14 digits as WARC's form of it."""
    d = date.ljust(14, "0") if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


class Original(NamedTuple):
    """What a revisit says of the record it refers to."""

    record_id: str
    page: int | None
    url: str
    date: str


def _record(lines: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *lines, f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", GZIP_LEVEL, mtime=0)


def warc_info(archive: str) -> bytes:
    """The record that an archive's version block becomes."""
    lines = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(archive, 0)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Filename: {archive}", "Content-Type: application/warc-fields"]
    return _record(lines, b"software: partloom\r\nformat: WARC File Format 1.1\r\n")


def to_warc(archive: str, record: ArcRecord, original: Original | None = None) -> bytes:
    """A response record (a resource without an HTTP head), or with original a
    revisit of it, which keeps the HTTP head alone."""
    head, payload = record.block[: record.payload_at], record.block[record.payload_at :]
    http = bool(head)
    lines = [
        f"WARC-Type: {'revisit' if original else 'response' if http else 'resource'}",
        f"WARC-Record-ID: {record_id(archive, record.offset)}",
        f"WARC-Warcinfo-ID: {record_id(archive, 0)}",
        f"WARC-Date: {warc_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Type: {HTTP_RESPONSE if http else record.content_type}",
    ]
    if original:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {original.record_id}", f"WARC-Refers-To-Target-URI: {original.url}", f"WARC-Refers-To-Date: {warc_date(original.date)}", f"WARC-Payload-Length: {len(payload)}"]
        if original.page is not None:
            lines.append(f"WARC-Refers-To-Page: {original.page}")
    return _record(lines, head if original else record.block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, with its digest tested."""
    for offset, content in members(data):
        head, _, rest = content.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at {offset}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"no length of the record at {offset}")
        block = rest[: int(fields["content-length"])]
        if "sha1:" + base32_sha1(block) != fields.get("warc-block-digest"):
            raise ValueError(f"block digest of the record at {offset}")
        yield fields, block


def arc_archives(pages: DataFrame, *, records: int = 256) -> DataFrame:
    """archive, data: pages (page_id, url, html) as ARC archives of both versions.

    An archive's name is a digest of its pages and its place in the job, so the
    same table read the same way gives the same archives.  A null html is an empty payload; null addresses are "-"; a null page_id is
    left out of the record and comes back null.  Other columns are not read.
    """
    small_batches(pages.sparkSession, records)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            rows = []
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                tag = b"" if page is None else b"X-Page: %d\r\n" % page
                head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n%sContent-Length: %d\r\n\r\n" % (tag, len(payload))
                rows.append((url or "-", "0.0.0.0", "20000101000000", "text/html", head + payload))
            said = hashlib.sha1(b"\0".join(x for url, *_, block in rows for x in (url.encode(), block))).hexdigest()
            name = f"{said[:16]}{said[-1]}-{TaskContext.get().partitionId():x}-{number:x}"
            data = write_arc(name, b"12"[int(said[-1], 16) % 2 :][:1], rows)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "data"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return materialize(rows.mapInArrow(write, "archive string, data binary"), "arc")


_INDEX = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, url string, date string"


def arc_index(archives: DataFrame) -> DataFrame:
    """archive, offset, page_id, payload_bytes, payload_digest, url, date of every
    record; a broken archive has none."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["archive"].to_pylist(), batch["data"].to_pylist(), strict=True):
                try:
                    out = [
                        (name, r.offset, _page(r.block[: r.payload_at]), len(r.block) - r.payload_at, base32_sha1(r.block[r.payload_at :]), r.url, r.date)
                        for r in read_arc(data)
                    ]
                except (ValueError, zlib.error):
                    continue
                if out:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["archive", "offset", "page_id", "payload_bytes", "payload_digest", "url", "date"])

    return archives.select("archive", "data").mapInArrow(index, _INDEX)


def _page(head: bytes) -> int | None:
    tag = http_field(head, "X-Page") or ""
    return int(tag) if tag.removeprefix("-").isdigit() else None


def convert(archives: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """archive, data, error: the same records as WARC archives.

    Of records with equal payloads (SHA-1 and length) of at least
    min_revisit_bytes, the one with the largest page is the response (a null
    page comes before any other; ties go to the later archive name, then
    offset), and the others revisit it.  Smaller ones are all responses.  An
    archive that can't be read has null data and says why in error; it doesn't
    stop the others.  Archives' names are all different.
    """
    index = materialize(arc_index(archives), "arc-index")
    at = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "archive", "offset")
    key = ["payload_digest", "payload_bytes"]
    index = index.where(F.col("payload_bytes") >= min_revisit_bytes).select(*key, at.alias("at"), F.struct("url", "date").alias("said"))
    groups = index.groupBy(*key).agg(F.max("at").alias("original"), F.min("at").alias("least"), F.max_by("said", "at").alias("said"))
    groups = groups.where(F.col("least") < F.col("original")).drop("least")
    revisits = index.drop("said").join(groups, key).where(F.col("at") < F.col("original"))
    to = F.struct("at.offset", F.col("original.archive").alias("of"), F.col("original.offset").alias("of_offset"), F.col("original.page_id").alias("page"), "said.url", "said.date")
    plan = revisits.groupBy("at.archive").agg(F.collect_list(to).alias("revisits"))  # an archive's records are bounded

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, revisits in zip(*(batch[c].to_pylist() for c in ("archive", "data", "revisits")), strict=True):
                originals = {r["offset"]: Original(record_id(r["of"], r["of_offset"]), r["page"], r["url"], r["date"]) for r in revisits or []}
                try:
                    made, error = warc_info(name) + b"".join(to_warc(name, r, originals.get(r.offset)) for r in read_arc(data)), None
                except (ValueError, zlib.error) as e:
                    made, error = None, str(e)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([made], pa.binary()), pa.array([error], pa.string())], ["archive", "data", "error"])

    small_batches(archives.sparkSession, 16)
    joined = archives.join(plan, "archive", "left").select("archive", "data", "revisits")
    return materialize(joined.mapInArrow(write, "archive string, data binary, error string"), "warc")


def _read_back(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    split = block.find(b"\r\n\r\n") + 4 if block[:5] == b"HTTP/" else 0
    head, payload = (block[:split], block[split:]) if split != 3 else (block, b"")
    if kind == "revisit":
        n = int(fields.get("warc-payload-length") or http_field(head, "Content-Length") or 0)
    else:
        n = len(payload)
        if base32_sha1(payload) != digest or head and int(http_field(head, "Content-Length") or n) != n:
            raise ValueError("a payload doesn't match its record")
    to = fields.get("warc-refers-to-page")
    return _page(head), n, digest, kind, None if to is None else int(to)


def warc_pages(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error of
    every record read back (but the archives' own), whole payloads tested
    against their digests.  An archive that can't be read gives one row of nulls
    that says why in error; it doesn't stop the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, error in zip(batch["data"].to_pylist(), batch["error"].to_pylist(), strict=True):
                try:
                    out = [] if error else [(*_read_back(f, b), None) for f, b in read_warc(data) if f.get("warc-type") != "warcinfo"]
                except (ValueError, zlib.error) as e:
                    error = str(e)
                if error:
                    out = [(None,) * 5 + (error,)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
    return archives.select("data", "error").mapInArrow(read, schema)


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Every page written as ARC, converted to WARC and read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to, error.

    A null html is an empty payload; a null page_id comes back null and is the
    response only where all its equals are null too; of rows that repeat a page
    and its payload one is the response.  Other columns are not read; an empty
    table gives an empty result.
    """
    return warc_pages(convert(arc_archives(pages)))
