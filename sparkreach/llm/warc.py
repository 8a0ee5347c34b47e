"""ARC to WARC: legacy archives are parsed by their version's header line and converted.

An ARC file starts with a version block that names the fields of its URL records: version 1 has URL, IP-address,
Archive-date, Content-type and Archive-length; version 2 puts Result-code, Checksum, Location, Offset and Filename
before the length. A record is one header line, then as many bytes as its last field says, then a newline. Fields are
taken from the right, as old URLs may hold blanks. The converter makes of each a WARC/1.1 record: a record id (UUID of
URL, date, file and place), an ISO date, the type and SHA-1 digests in base 32. Of records with equal payloads one is a
response and the others revisit it: that of the smallest page id, or, where no record has one, the first by date, URL,
file and place. A page id is carried in an HTTP header of the block where write_arc made it; other archives have none.

A record is a gzip member of its own, so archives can be entered at any record. They are written by Spark's text writer,
whose line separator is an empty gzip member, so they go to whatever store the path names (and have Spark's file names),
and are read by binaryFile: a file's compressed bytes and one record are in memory at a time. Payloads do not move
until it is known which records revisit others; then each file meets the list of its own.

Cases: null html is an empty payload; null urls are written as `-`, blanks in urls are escaped when written; a null page
id is kept, and never the one that others refer to if there is one; rows with the same smallest page id are all
responses; repeated rows are pages of their own; payloads are kept whole, at any length; an empty table gives no records; further columns are ignored. Malformed records (header lines with too few
fields or a bad length, unknown versions, files that end within a record) are rows of `problems`; reading goes on at
the next header line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

# fixed values: the header fields of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20000101000000"
END = b"\r\n\r\n"
GZIP = 31  # zlib's code for gzip members
LEVEL = 2
FED = 1 << 14
SPACE = re.compile(r"[\x00-\x20\x7f]")
CHUNK = 1 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- ARC


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 sparkreach\n{ARC_FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 " + name if version == 2 else "")
    return f"{head} {len(body)}\n".encode() + body


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, name: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    where = SPACE.sub(lambda m: f"%{ord(m.group()):02X}", url or "-")
    more = f" 200 {hashlib.md5(payload).hexdigest()} - 0 {name}" if version == 2 else ""
    return f"{where} 0.0.0.0 {DATE} text/html{more} {len(http) + len(payload)}\n".encode("utf-8", "surrogatepass") + http + payload + b"\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return z.compress(record) + z.flush()


class Reader:
    """Lines and counted bytes from the chunks of a gzip or plain stream; at: the place in the plain bytes."""

    def __init__(self, data: bytes):
        self.chunks, self.held, self.at = self.inflate(data), b"", 0

    @staticmethod
    def inflate(data: bytes) -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        view, at = memoryview(data), 0
        while at < len(view):  # members follow each other
            z = zlib.decompressobj(GZIP)
            while not z.eof and at < len(view):
                part = view[at : at + FED]
                try:
                    yield z.decompress(part, CHUNK)
                except zlib.error:
                    return  # as if the file ended here
                at += len(part) - len(z.unconsumed_tail) - len(z.unused_data)
            if more := z.flush():
                yield more

    def take(self, n: int) -> bytes | None:
        """None: the stream ends before."""
        parts, size = [self.held], len(self.held)
        while size < n:
            more = next(self.chunks, None)
            if more is None:
                self.held = b"".join(parts)
                return None
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        self.held = held[n:]
        self.at += n
        return held[:n]

    def until(self, mark: bytes) -> bytes | None:
        """What comes before mark, which is passed over; None at the end, where held keeps what is left."""
        parts, tail = [self.held], b""
        while True:
            seen = tail + parts[-1]
            if (i := seen.find(mark)) >= 0:
                held = b"".join(parts)
                i += len(held) - len(seen)
                self.held = held[i + len(mark) :]
                self.at += i + len(mark)
                return held[:i]
            tail = seen[1 - len(mark) :] if len(mark) > 1 else b""
            more = next(self.chunks, None)
            if more is None:
                self.held = b"".join(parts)
                return None
            parts.append(more)


def arc_fields(line: bytes, names: list[str]) -> dict | None:
    """The header line's fields, taken from the right; None if it is none."""
    values = line.rstrip(b"\r").decode("utf-8", "surrogateescape").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdecimal() or not values[0]:
        return None
    head = dict(zip(names, values, strict=True))
    return head if head["Archive-date"].isdecimal() else None


def arc_records(data: bytes) -> Iterator[tuple[int, dict | None, bytes, str | None]]:
    """(place, fields, block, problem) of each URL record, by the version block's list of fields. A problem has no fields."""
    r, names, lost = Reader(data), None, False
    while True:
        place = r.at
        line = r.until(b"\n")
        if line is None:
            if r.held.strip():
                yield place, None, b"", "the archive ends within a header line"
            return
        if not line.strip():
            continue
        if line.startswith(b"filedesc://") and line.rsplit(b" ", 1)[-1].strip().isdigit():
            block = r.take(int(line.rsplit(b" ", 1)[1]))
            about = (block or b"").decode("utf-8", "replace").split("\n")
            version = about[0].split(" ")[0]
            names = ARC_FIELDS[int(version)].split(" ") if version.isdecimal() and int(version) in ARC_FIELDS else None
            if names is None:
                yield place, None, b"", f"unknown ARC version: {version[:20]}"
                return
            lost = False
            continue
        if names is None:
            yield place, None, b"", "the archive has no version block"
            return
        head = arc_fields(line, names)
        if head is None:
            if not lost:
                yield place, None, b"", "no header line"
            lost = True  # until the next header line
            continue
        lost = False
        block = r.take(int(head["Archive-length"]))
        if block is None:
            yield place, None, b"", "the archive ends within a record"
            return
        yield place, head, block, None


def http_parts(block: bytes) -> tuple[dict, bytes, bytes]:
    """Headers by lower-case name, their bytes, payload; no headers if the block has none."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, end, payload = block.partition(END)
    names = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {a.strip().lower().decode("latin-1"): b.strip().decode("latin-1") for a, _, b in names}, head + end, payload


def page_of(block: bytes) -> int | None:
    """The page id that write_arc gave, if any."""
    http = http_parts(block)[0].get("x-page-id", "")
    return int(http) if http.lstrip("-").isdecimal() else None


# ---- WARC


def record_id(url: str, date: str, file: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {file} {place}'.encode('utf-8', 'surrogateescape').decode('latin-1'))}>"


def iso(date: str) -> str:
    """ARC dates have 14 digits, or fewer: then the rest is the start of the period."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block + END


def converted(head: dict, block: bytes, file: str, place: int, first: dict | None) -> bytes:
    """The WARC record of an ARC record; a revisit of first keeps the HTTP headers and leaves the payload out."""
    http, top, payload = http_parts(block)
    own = top if first is not None else block
    url, date, page = head["URL"], head["Archive-date"], page_of(block)
    headers = [("WARC-Record-ID", record_id(url, date, file, place)), ("WARC-Date", iso(date)), ("WARC-Target-URI", url.replace(" ", "%20")), ("WARC-IP-Address", head["IP-address"])]
    headers += [("Content-Type", "application/http;msgtype=response" if http else head["Content-type"]), ("WARC-Block-Digest", f"sha1:{digest(own)}"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if first is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first["url"], first["date"], first["file"], first["place"]))]
        headers += [("WARC-Refers-To-Target-URI", first["url"].replace(" ", "%20")), ("WARC-Refers-To-Date", iso(first["date"]))]
        if first["page_id"] is not None:
            headers.append(("X-Refers-To-Page-Id", str(first["page_id"])))
    kind = "revisit" if first is not None else "response" if http else "resource"
    return warc_record(kind, headers, own)


def warc_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of each record."""
    r = Reader(data)
    while (head := r.until(END)) is not None:
        first, *lines = head.lstrip(b"\r\n").decode("utf-8", "surrogateescape").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        headers = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
        block = r.take(int(headers["content-length"]))
        if block is None or r.take(4) != END:
            raise ValueError("the record has another length than declared")
        yield headers, block
    if r.held.strip():
        raise ValueError("the archive ends within a header")


# ---- Spark


def mapped(df: DataFrame, rows, schema: str, names: list[str], types: list) -> DataFrame:
    """rows(batches) yields tuples, sent on in batches of about 4 MB."""

    def run(batches):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate(types)], names=names)

        for x in rows(batches):
            held.append(x)
            size += 64 + sum(len(v) for v in x if isinstance(v, bytes))
            if size >= 4 << 20:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return df.mapInArrow(run, schema)


def write_archives(df: DataFrame, path: str) -> None:
    """value: the records, as gzip members. Members of no bytes stand between them."""
    options = {"lineSep": member(b"").decode("latin-1"), "encoding": "ISO-8859-1", "compression": "none"}
    df.select(F.col("value").cast("string").alias("value")).write.options(**options).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def write_arc(pages: DataFrame, path: str) -> None:
    """pages as ARC files, one a task; tasks of even number write version 1, others version 2."""

    def rows(batches):
        task = TaskContext.get().partitionId()
        version, name = 1 + task % 2, f"part-{task:05d}.arc.gz"
        yield (member(arc_version_block(version, name)),)
        for b in batches:
            for page_id, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                yield (member(arc_record(version, page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), name)),)

    write_archives(mapped(pages.select("page_id", "url", "html"), rows, "value binary", ["value"], [pa.binary()]), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """file, place, page_id, url, date, digest (of the payload), problem of the records."""

    def rows(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for place, head, block, problem in arc_records(data.as_py()):
                    if problem:
                        yield file, place, None, None, None, None, problem
                    else:
                        yield file, place, page_of(block), head["URL"].encode("utf-8", "surrogateescape").decode("latin-1"), head["Archive-date"], digest(http_parts(block)[2]), None

    names = ["file", "place", "page_id", "url", "date", "digest", "problem"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
    return mapped(files(spark, path), rows, "file string, place bigint, page_id bigint, url string, date string, digest string, problem string", names, types)


def convert(spark: SparkSession, arc: str, warc: str) -> DataFrame:
    """ARC files in folder arc to WARC files in folder warc. Returns file, place and problem of the malformed records."""
    seen = written(read_arc(spark, arc), "records")
    good = seen.where("problem IS NULL")
    known = F.struct("page_id", "url", "date", "file", "place")
    order = F.struct(F.col("page_id").isNull(), "page_id", "date", "url", "file", "place")
    first = written(good.groupBy("digest").agg(F.min_by(known, order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    again = good.join(first, "digest").where(F.when(F.col("first.page_id").isNotNull(), ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).otherwise((F.col("file") != F.col("first.file")) | (F.col("place") != F.col("first.place"))))
    revisits = written(again.groupBy("file").agg(F.collect_list(F.struct("place", "first")).alias("revisits")), "revisits")

    def rows(batches):
        task = TaskContext.get().partitionId()
        about = b"software: sparkreach\r\nformat: WARC File Format 1.1\r\n"
        yield (member(warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", DATE, "", task)), ("WARC-Date", iso(DATE)), ("Content-Type", "application/warc-fields")], about)),)
        for b in batches:
            for file, data, known in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                to = {x["place"]: x["first"] | {"url": x["first"]["url"].encode("latin-1").decode("utf-8", "surrogateescape")} for x in known.as_py() or ()}
                for place, head, block, problem in arc_records(data.as_py()):
                    if not problem:
                        yield (member(converted(head, block, file, place, to.get(place))),)

    joined = files(spark, arc).join(revisits, "file", "left")
    write_archives(mapped(joined.select("file", "content", "revisits"), rows, "value binary", ["value"], [pa.binary()]), warc)
    return seen.where("problem IS NOT NULL").select("file", "place", "problem")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records; digests and lengths are checked."""

    def rows(batches):
        for b in batches:
            for data in b.column(1):
                for head, block in warc_records(data.as_py()):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    payload = http_parts(block)[2]
                    said, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    if head["warc-block-digest"] != f"sha1:{digest(block)}" or kind != "revisit" and (said != digest(payload) or len(payload) != size):
                        raise ValueError(f"{head['warc-record-id']}: another digest or length than declared")
                    page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    yield int(page) if page else None, size, said, kind, int(refers) if refers else None

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return mapped(files(spark, path), rows, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], types)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages to ARC, ARC to WARC, WARC read back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
