"""WARC archives: a writer that Spark's own files carry, and a reader that salvages damaged archives.

Records are rows of text that end in the two line ends the format asks for, so Spark's text writer makes valid archives
on any file system, with its commit protocol; ``maxRecordsPerFile`` bounds a file. Each record is a gzip member of its
own, so that damage costs the records it touches; the reader takes plain archives, one member per record and many per
member alike.

The reader takes the bytes of a file, checks each record's version line, headers, length, end and block digest, and each
member's checksum. After a failed check it searches for the next version line (or gzip member), goes on from there, and
reports the bytes passed over as a quarantined gap. Gaps and records cover the archive without rest.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import slices

#: Payloads from this size on are stored once. Records of a file at most, if none is larger than LARGE bytes; of larger ones
#: a file has the fewer the larger the largest is, so that a file has about FILE_ROWS * LARGE bytes of payload at most.
REVISIT_BYTES, FILE_ROWS, LARGE = 1000, 2000, 500_000
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f].{6}", re.S)
END = b"\r\n\r\n"
#: A member's last byte, which the text writer adds as the end of a line: the highest of the length, zero for less than 16 MiB.
LAST, LAST_BYTES = "\0", 1 << 24


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        """What follows the headers of a response, or the whole block of other kinds."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(END)[2]
        return self.block


@dataclass
class Salvage:
    """Records in order and gaps ``(offset, length, why)``, both by bytes of the decompressed archive, or of the file for damaged members."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def members(data: bytes) -> Iterator[tuple[int, bytes, str]]:
    """Offset, content and fault ('' if none) of each gzip member; content before a fault is kept."""
    at = 0
    while at < len(data):
        m = MEMBER.match(data, at)
        if not m:
            found = MEMBER.search(data, at + 1)
            end = found.start() if found else len(data)
            yield at, b"", f"{end - at} bytes are no gzip member"
            at = end
            continue
        unzip, out, fault = zlib.decompressobj(31), b"", ""
        parts, k = [], at
        try:
            while not unzip.eof and k < len(data):
                before = unzip.copy()
                parts.append(unzip.decompress(data[k : k + 65_536]))
                k += 65_536
            if not unzip.eof:
                fault = "the member ends early"
        except zlib.error as e:
            fault = str(e)
            parts.extend(_up_to_fault(before, data[k : k + 65_536]))
        out = b"".join(parts)
        if fault:
            found = MEMBER.search(data, at + 1)
            end = found.start() if found else len(data)
        else:
            end = min(k, len(data)) - len(unzip.unused_data)
        yield at, out, fault
        at = end


def _up_to_fault(unzip, piece: bytes) -> Iterator[bytes]:
    """What a piece that fails gives before its fault, byte by byte."""
    try:
        for i in range(len(piece)):
            yield unzip.decompress(piece[i : i + 1])
    except zlib.error:
        return


def member_line(record: bytes) -> bytes:
    """A record as a gzip member without its last byte ``LAST``; an empty member follows one whose length has another."""
    out = gzip.compress(record, 6, mtime=0)
    return (out if len(record) < LAST_BYTES else out + gzip.compress(b"", mtime=0))[:-1]


def salvage(data: bytes) -> Salvage:
    """All sound records of an archive, and the gaps between them."""
    out = Salvage()
    if not MEMBER.match(data) and not VERSION.match(data) and (m := MEMBER.search(data)) and not VERSION.search(data, 0, m.start()):
        out.gaps.append((0, m.start(), "no version line or member"))
        for at, length, why in _zipped(data[m.start() :], out, m.start()):
            out.gaps.append((at, length, why))
    elif MEMBER.match(data):
        for at, length, why in _zipped(data, out, 0):
            out.gaps.append((at, length, why))
    else:
        _plain(data, 0, out)
    return out


def _zipped(data: bytes, out: Salvage, base: int) -> Iterator[tuple[int, int, str]]:
    for at, content, fault in members(data):
        if content:
            _plain(content, base + at, out)
        if fault:
            nxt = MEMBER.search(data, at + 1)
            yield base + at, (nxt.start() if nxt else len(data)) - at, fault


def _plain(data: bytes, base: int, out: Salvage) -> None:
    at = 0
    while at < len(data):
        record, end, why = _record(data, at)
        if record is not None:
            record.offset += base
            out.records.append(record)
            at = end
            continue
        m = VERSION.search(data, at + 1)
        end = m.start() if m else len(data)
        out.gaps.append((base + at, end - at, why))
        at = end


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    if not VERSION.match(data, at):
        return None, at, "no version line"
    head = data.find(END, at)
    if head < 0:
        return None, at, "headers don't end"
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "a header without a colon"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return None, at, "no length"
    start = head + len(END)
    end = start + int(headers["content-length"])
    if data[end : end + len(END)] != END:
        return None, at, "the block doesn't end where its length says"
    block = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != hashlib.sha1(block).hexdigest():
        return None, at, "the block's digest differs"
    return Record(headers, block, at), end + len(END), ""


def _header(name: str, value) -> F.Column:
    """A header line, or nothing for null; line ends in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each page to gzip archives at ``path``, a folder on any file system that Spark knows.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` that with the largest id is the response and the others
    revisit it. Digests are counted before anything is joined; the digests that several pages have join back in two ways:
    those of more than a thousandth of all pages, at most a thousand, by broadcast, the rest by a shuffle.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    groups = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).where("n > 1")
    n_rows, largest = rows.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    many = max(1000, n_rows // 1000)
    hot = groups.where(F.col("n") > many).select("digest", "original")
    hot_rows = [(r.digest, r.original) for r in hot.collect()]
    spark = pages.sparkSession
    hot = spark.createDataFrame(hot_rows, "hot_digest string, hot_original long")
    cold = groups.where(F.col("n") <= many).select(F.col("digest").alias("cold_digest"), F.col("original").alias("cold_original"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when((F.col("size") >= REVISIT_BYTES) & F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))
    rows = rows.withColumn("key", key).join(cold, F.col("key") == F.col("cold_digest"), "left")
    original = F.coalesce("hot_original", "cold_original")
    revisit = original.isNotNull() & ~original.eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END.decode()))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    rows = rows.select("id", "url", "size", "digest", original.alias("original"), revisit.alias("revisit"), block.alias("block"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        _header("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("size")),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([member_line(x) for x in part.column(0).to_pylist()], pa.binary())], names=["value"])

    def write(some: DataFrame, files_rows: int, mode: str) -> None:
        records = some.select(F.concat(head, F.col("block"), F.lit(END.decode())).cast("binary").alias("value")).mapInArrow(pack, "value binary")
        records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", LAST).option("compression", "none").option("maxRecordsPerFile", files_rows).mode(mode).text(path)

    # files are read whole, so that none may hold too many bytes
    if largest <= LARGE:
        write(rows, FILE_ROWS, "error")
    else:
        write(rows.where(F.col("size") <= LARGE), FILE_ROWS, "error")
        write(rows.where(F.col("size") > LARGE), max(1, FILE_ROWS * LARGE // largest), "append")


RECORD = "file string, offset long, type string, record_id string, refers_to string, uri string, payload_digest string, payload_length long, payload binary, gap_length long, why string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives at ``path`` and, as rows of type 'gap', what was quarantined. Files are read whole, one task at a time each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                found = salvage(data)
                rows = [_row(file, r) for r in found.records] + [{"file": file, "offset": at, "type": "gap", "gap_length": n, "why": why} for at, n, why in found.gaps]
                for start in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[start : start + 500], schema=SCHEMA)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,gz,txt}").load(path).select("path", "content").mapInArrow(run, RECORD)


SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])


def _row(file: str, r: Record) -> dict:
    h = r.headers
    length = h.get("x-payload-length", "")
    return {
        "file": file, "offset": r.offset, "type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"),
        "payload_digest": h.get("warc-payload-digest"), "payload_length": int(length) if length.isdigit() else len(r.payload), "payload": r.payload,
    }


def gaps(records: DataFrame) -> DataFrame:
    """The log of what was quarantined: ``file``, ``offset``, ``gap_length`` and ``why``."""
    return records.where("type = 'gap'").select("file", "offset", "gap_length", "why")


def page_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Pages as read back: ``page_id``, ``payload_bytes``, ``payload_digest`` (of the payload itself for responses), ``record_type`` and ``refers_to``.

    Defined cases: null html is an empty payload; a null id has a record without one; pages with equal payloads and equal
    largest ids are all responses; repeated rows give one row each; an empty table gives an empty table; other columns
    are ignored. Gaps have no page; ``gaps`` tells of them, and with ``strict`` the first one fails the query.
    """
    if strict:
        told = F.concat(F.lit("quarantined bytes in "), "file", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), F.coalesce("why", F.lit("")))
        records = records.where(F.when(F.col("type") == "gap", F.raise_error(told).cast("boolean")).otherwise(True))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS long)")
    digest = F.when(F.col("type") == "response", F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    size = F.when(F.col("type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_length"))
    return records.where("type <> 'gap'").select(number("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
