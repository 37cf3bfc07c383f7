"""Legacy ARC archives turned into WARC archives, and both read and written by Spark jobs.

An ARC file begins with a version block.  Version 1 describes a record by five fields in one line,
version 2 by ten; the last one declares how many bytes follow, and nothing else tells where a record ends.
From each line and its bytes the converter synthesises what WARC asks for: an identifier (from
the digest of the archive, offset, address and date, so that it comes out the same again), the date in ISO
form, the type, and SHA-256 digests of block and payload.  Of responses with equal payloads the first
keeps its payload; the others become revisits that hold the HTTP head and refer to it.

Archives are read twice.  The first pass yields a line per record, by which equal payloads meet; the second
one writes.  Payloads are never shuffled unless there are more than a million revisits.

Archives are written by Spark's text sink, one row per file: a row is the whole content of an archive of
about ``FILE_BYTES``, and the line separator is what ends a record of the format.  So they go wherever Spark
can write, under its commit protocol, compressed as one gzip member; members per record are read as well.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm.common import MOST_IDS, chosen, release, settled, with_key
from catchment.session import fresh_path, remove_path

FILE_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
PIECE = 1 << 16  # bytes of a compressed file that are handed over at a time
LEAST_PAYLOAD = 100  # bytes from which equal payloads are revisits
TAG = "X-Page-Id"  # HTTP header that carries the id of a page

# Fields of a record line by version, and the media type and profile of records (fixed values of the formats).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP_TYPE = "application/http; msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARC_LINE = {
    1: re.compile(rb"(\S.*?) ([0-9A-Fa-f.:]+|-) (\d{4,17}) (.*?) ?(\d+)\r?"),
    2: re.compile(rb"(\S.*?) ([0-9A-Fa-f.:]+|-) (\d{4,17}) (.*?) (\d{1,3}|-) (\S+) (\S+) (\d+|-) (\S+) (\d+)\r?"),
}
_HEAD_END = re.compile(rb"\r?\n\r?\n")


class ArcRecord(NamedTuple):
    offset: int
    version: int
    url: str
    ip: str
    date: str
    media_type: str
    block: bytes


class Reject(NamedTuple):
    offset: int
    reason: str


def inflated(content: bytes) -> bytes:
    """Content of a file, of all its gzip members if it is compressed; what follows the last member is left out."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts, at, member = [], 0, None
    while at < len(content) and (member or content[at:at + 2] == b"\x1f\x8b"):
        member = member or zlib.decompressobj(31)
        piece = content[at:at + PIECE]  # what is left over after a member is at most this long
        try:
            parts.append(member.decompress(piece))
        except zlib.error:
            break
        at += len(piece) - len(member.unused_data)
        member = None if member.eof else member
    return b"".join(parts)


def arc_records(data: bytes) -> Iterator[ArcRecord | Reject]:
    """Records of an ARC file in order; lines that are no record line and cut records are told as rejects.

    The version comes from the version block, or where that is missing from the line itself.  After a
    wrong length the next line that reads as a record is looked for, so one bad record costs no other.
    """
    at, version, lost = 0, None, False
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        first = version is None and line.startswith(b"filedesc:")
        # Ten fields also fit the pattern of five, whose media type takes the rest.
        order = (version,) if version else (2, 1)
        found, used = next(((m, v) for v in order if (m := _ARC_LINE[v].fullmatch(line))), (None, 0))
        if found is None:
            if not lost:
                yield Reject(at, "no record line")
            lost, at = True, end + 1
            continue
        lost = False
        url, ip, date, media_type = (f.decode("utf-8", "backslashreplace") for f in found.groups()[:4])
        block = data[end + 1:end + 1 + int(found[found.re.groups])]
        if len(block) < int(found[found.re.groups]):
            yield Reject(at, "shorter than declared")
            at = end + 1
            lost = True
            continue
        if first:
            named = block.split(None, 1)[:1]
            version = int(named[0]) if named and named[0] in (b"1", b"2") else None
        yield ArcRecord(at, version or used, url, ip, date, media_type, block)
        at = end + 1 + len(block)


def iso_date(digits: str) -> str:
    """``20040131120000`` as ``2004-01-31T12:00:00Z``; missing parts are the earliest, an impossible date is 1970."""
    padded = (digits + "00000101000000"[len(digits):])[:14]
    try:
        return datetime.strptime(padded, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    digest = hashlib.sha256("\n".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    # Version 8 of UUIDs: contents of one's own choice.
    return f"<urn:uuid:{digest[:8]}-{digest[8:12]}-8{digest[13:16]}-a{digest[17:20]}-{digest[20:32]}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with the blank line, and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = _HEAD_END.search(block)
    return (block[:end.end()], block[end.end():]) if end else (block, b"")


def header_values(head: bytes) -> dict[str, str]:
    """Fields of a head by lower-case name, the first of each name; the first line and bad lines are passed over."""
    values: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            values.setdefault(name.strip().lower(), value.strip())
    return values


def tag_of(head: bytes, header: str) -> int | None:
    value = header_values(head).get(header.lower(), "")
    number = int(value) if re.fullmatch(r"-?\d{1,19}", value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def warc_type(record: ArcRecord, is_http: bool) -> tuple[str, str]:
    """WARC type and content type of an ARC record."""
    if record.url.startswith("filedesc:"):
        return "warcinfo", "application/warc-fields"
    if is_http:
        return "response", HTTP_TYPE
    return ("response", "text/dns") if record.url.startswith("dns:") else ("resource", record.media_type or "application/octet-stream")


LINE = (
    "archive string, offset bigint, version int, record_id string, type string, content_type string, date string, uri string, ip string, "
    "tag bigint, head_bytes bigint, payload_bytes bigint, payload_digest string, trouble string"
)
_NAMES = [c.split()[0] for c in LINE.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in LINE.split(", ")]


def _lines(path: str, content: bytes, tag_header: str) -> Iterator[tuple[tuple, bytes]]:
    """What WARC needs to know of each record of a file, with the block."""
    name = path.rsplit("/", 1)[-1]
    print_of_file = hashlib.sha256(content).hexdigest()
    for r in arc_records(inflated(content)):
        if isinstance(r, Reject):
            yield (name, r.offset, *[None] * 11, r.reason), b""
            continue
        if r.url.startswith("filedesc:"):
            name = r.url.removeprefix("filedesc:").lstrip("/") or name
        head, payload = split_http(r.block)
        kind, content_type = warc_type(r, bool(head))
        block = r.block
        if kind == "warcinfo":
            head, payload = b"", f"description: converted from version {r.version} of ARC\r\nisPartOf: {name}\r\n".encode()
            block = payload
        yield (
            name, r.offset, r.version, record_id(print_of_file, r.offset, r.url, r.date), kind, content_type, iso_date(r.date), r.url, r.ip,
            tag_of(head, tag_header), len(head), len(payload), hashlib.sha256(payload).hexdigest(), None,
        ), block


def _batches(rows: Iterable[tuple[tuple, bytes]], names: list[str], kinds: list[pa.DataType], with_block: bool) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``BATCH_BYTES`` of blocks or a thousand rows."""
    lines, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], names=names)

    for line, block in rows:
        lines.append((*line, block) if with_block else line)
        weight += len(block) if with_block else 0
        if weight >= BATCH_BYTES or len(lines) >= 1000:
            yield batch()
            lines, weight = [], 0
    if lines:
        yield batch()


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return chosen(spark.read.format("binaryFile").load(path), path=("path", "string"), content=("content", "binary"))


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, content in zip(*batch.columns):
            yield path.as_py(), content.as_py() or b""
        release()


def read_arc(spark: SparkSession, path: str, with_block: bool = False, tag_header: str = TAG) -> DataFrame:
    """A row per record of all ARC files below ``path``, compressed or not, as ``LINE`` has it.

    ``date``, ``record_id``, ``type`` and digests are those of the WARC record to be.  A row with ``trouble`` tells where a
    file could not be read and why.  ``with_block`` adds the ``block``.  Files are units of reading.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for path, content in _each_file(batches) for row in _lines(path, content, tag_header))
        names, kinds = (_NAMES + ["block"], _KINDS + [pa.binary()]) if with_block else (_NAMES, _KINDS)
        yield from _batches(rows, names, kinds, with_block)

    return _contents(spark, path).mapInArrow(run, LINE + (", block binary" if with_block else ""))


def revisits(lines: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``record_id`` of responses whose payload an earlier one has, with the id, address and date of that one.

    The first is the one with the smallest tag, then date, archive and offset; records without a tag come last.
    Records of archives that are equal byte by byte have equal ids and stand for one another.
    """
    own = lines.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    turn = F.struct(F.col("tag").isNull().alias("untagged"), "tag", "date", "archive", "offset", "record_id", "uri")
    firsts = settled(
        own.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(turn).alias("first")).where("n > 1")
        .select("payload_digest", "n", F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri"),
                F.col("first.date").alias("refers_date"))
    )
    met = with_key(own.select("record_id", "payload_digest"), firsts, "payload_digest", "inner")
    return met.where("record_id != refers_to").select("record_id", "refers_to", "refers_uri", "refers_date").distinct()


def warc_record(line: dict, block: bytes) -> bytes:
    """A WARC record without the two line ends after it."""
    kind = line["type"]
    if line["refers_to"] is not None:
        kind, block = "revisit", block[:line["head_bytes"]]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", line["record_id"]),
        ("WARC-Date", line["date"]),
        ("WARC-Filename" if kind == "warcinfo" else "WARC-Target-URI", line["archive"] if kind == "warcinfo" else line["uri"]),
        ("WARC-IP-Address", line["ip"] if line["ip"] not in ("-", "0.0.0.0") else None),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + line["payload_digest"]),
        ("WARC-Profile", SAME_PAYLOAD if kind == "revisit" else None),
        ("WARC-Refers-To", line["refers_to"]),
        ("WARC-Refers-To-Target-URI", line["refers_uri"]),
        ("WARC-Refers-To-Date", line["refers_date"]),
        ("Content-Type", line["content_type"]),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block


def _images(records: Iterable[bytes], end: bytes, most: int) -> Iterator[bytes]:
    """Contents of files: whole records until ``most`` bytes, without the last ``end``, which the sink adds."""
    parts, weight = [], 0
    for record in records:
        if parts and weight + len(record) > most:
            yield end.join(parts)
            parts, weight = [], 0
        parts.append(record)
        weight += len(record) + len(end)
    if parts:
        yield end.join(parts)


def _image_batches(images: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for image in images:
        yield pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], names=["image"])


def _write(images: DataFrame, path: str, end: str) -> None:
    # The cast keeps bytes as they are, whether or not they are text.
    texts = images.select(F.col("image").cast("string").alias("image"))
    texts.write.option("lineSep", end).option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def convert_arc(spark: SparkSession, source: str, path: str, least: int = LEAST_PAYLOAD, tag_header: str = TAG, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ARC files below ``source`` as WARC files to ``path``; returns the rejects, settled.

    Rejects are ``archive``, ``offset`` and ``trouble``; all other records are in the new archives.
    """
    lines = settled(read_arc(spark, source, tag_header=tag_header))
    again = settled(revisits(lines.where("trouble IS NULL"), least))
    few = again.limit(MOST_IDS + 1).count() <= MOST_IDS
    records = read_arc(spark, source, True, tag_header).where("trouble IS NULL").join(F.broadcast(again) if few else again, "record_id", "left")
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    line = dict(zip(names, row))
                    yield warc_record(line, line["block"])

        yield from _image_batches(_images(each(), b"\r\n\r\n", file_bytes))

    _write(records.mapInArrow(run, "image binary"), path, "\r\n\r\n")
    return lines.where("trouble IS NOT NULL").select("archive", "offset", "trouble")


def warc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes] | Reject]:
    """Offset, fields by lower-case name and block of every record of a WARC file, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        fields = header_values(data[at:end]) if end >= 0 else {}
        length = fields.get("content-length", "")
        if not length.isdecimal() or end + 4 + int(length) > len(data):
            yield Reject(at, "no length" if not length.isdecimal() else "shorter than declared")
            at += 5
            continue
        block = data[end + 4:end + 4 + int(length)]
        yield at, fields, block
        at = end + 4 + len(block)


WARC_LINE = (
    "record_id string, type string, date string, uri string, tag bigint, payload_bytes bigint, payload_digest string, refers_to string, "
    "intact boolean, trouble string"
)


def read_warc(spark: SparkSession, path: str, tag_header: str = TAG) -> DataFrame:
    """A row per record of all WARC files below ``path``.

    ``payload_bytes`` and ``payload_digest`` are measured on the payload; a revisit holds none, so it has the
    declared digest and null bytes.  ``intact`` tells whether declared digests equal measured ones.
    """
    names = [c.split()[0] for c in WARC_LINE.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in WARC_LINE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
        for _, content in _each_file(batches):
            for r in warc_records(inflated(content)):
                if isinstance(r, Reject):
                    yield (*[None] * 9, r.reason), b""
                    continue
                _, fields, block = r
                kind = fields.get("warc-type")
                declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                intact = fields.get("warc-block-digest") in (None, "sha256:" + hashlib.sha256(block).hexdigest())
                head, payload = split_http(block)
                digest, size = declared, None
                if kind != "revisit":
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    intact &= declared in ("", digest)
                yield (fields.get("warc-record-id"), kind, fields.get("warc-date"), fields.get("warc-target-uri"), tag_of(head, tag_header), size,
                       digest, fields.get("warc-refers-to"), intact, None), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), names, kinds, False)

    return _contents(spark, path).mapInArrow(run, WARC_LINE)


def resolved(records: DataFrame) -> DataFrame:
    """Rows of ``read_warc`` whose revisits have ``payload_bytes`` and ``refers_tag`` of the response they refer to."""
    wanted = records.where("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("n"))
    held = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("refers_bytes"), F.col("tag").alias("refers_tag")).dropDuplicates(["refers_to"])
    met = with_key(records, settled(held.join(wanted, "refers_to")), "refers_to", "left")
    return met.withColumn("payload_bytes", F.coalesce("payload_bytes", "refers_bytes")).drop("refers_bytes")


def write_arc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES,
) -> None:
    """Pages as legacy archives, versions 1 and 2 by turns: the input of the converter where there is only a table.

    Each page is the answer of a web server with its html in UTF-8 (null: empty); a null id is left out of the
    head.  White space in addresses is encoded; a null or empty address is ``about:blank``.  Dates count seconds from 2004 by id.
    """
    pages = chosen(pages, page_id=(id_col, "bigint"), url=(url_col, "string"), html=(html_col, "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        yield from _image_batches(_arc_images(rows, part, file_bytes))

    _write(pages.mapInArrow(run, "image binary"), path, "\n")


def _arc_images(rows: Iterable[tuple], part: int, most: int) -> Iterator[bytes]:
    parts, weight, number = [], 0, 0
    for page_id, url, html in rows:
        payload = html or b""
        tag = "" if page_id is None else f"{TAG}: {page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{tag}Content-Length: {len(payload)}\r\n\r\n".encode()
        if parts and weight + len(payload) > most:
            yield b"\n".join(parts)
            parts, weight, number = [], 0, number + 1
        version = 1 + (part + number) % 2
        name = f"pages-{part:05d}-{number:05d}.arc"
        if not parts:
            block = f"{version} 0 catchment\n{ARC_FIELDS[version]}\n".encode()
            parts.append(_arc_line(version, f"filedesc://{name}", "20040101000000", "text/plain", 0, name, len(block)) + block)
            weight = len(parts[0]) + 1
        date = (datetime(2004, 1, 1) + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
        address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
        block = head + payload
        parts.append(_arc_line(version, address, date, "text/html", weight, name, len(block)) + block)
        weight += len(parts[-1]) + 1
    if parts:
        yield b"\n".join(parts)


def _arc_line(version: int, url: str, date: str, media_type: str, offset: int, name: str, length: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {media_type}{more} {length}\n".encode("utf-8", "replace")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every page, read from its WARC record.

    Pages become legacy archives, these become WARC archives, and those are read back.  Null html is an empty
    payload.  Payloads below ``least`` bytes are responses whatever they equal.  Of rows that repeat a
    page id one is the response.  Pages without an id come after all others; what refers to one has a null
    ``refers_to``.  An empty table gives an empty result.  Other columns are not looked at.  The archives are
    removed once the rows are settled.
    """
    spark = pages.sparkSession
    legacy, modern = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    try:
        write_arc(pages, legacy, id_col, url_col, html_col, file_bytes)
        rejects = convert_arc(spark, legacy, modern, least, file_bytes=file_bytes)
        records = settled(read_warc(spark, modern))
        bad = rejects.count() + records.where("trouble IS NOT NULL OR NOT intact").count()
        if bad:
            raise ValueError(f"{bad} records did not survive the archives")
        found = settled(resolved(records.where("type IN ('response', 'revisit')")))
    finally:
        remove_path(spark, legacy)
        remove_path(spark, modern)
    return found.select(
        F.col("tag").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_tag").alias("refers_to")
    )


def archive_sql(least: int = LEAST_PAYLOAD) -> str:
    """The same as one query over ``pages``."""
    return f"""
WITH own AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM own
), turns AS (
  SELECT *, row_number() OVER same AS turn, first_value(page_id) OVER same AS first_id
  FROM digests WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {least} AND turn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {least} AND turn > 1 THEN first_id END AS refers_to
FROM turns"""
