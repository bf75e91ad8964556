"""WARC archives: a writer with revisit records, and a reader that salvages what is left of damaged files.

An archive is written by tasks as whole files of bounded size: gzip members, one per record, put one after another.  The
reader takes each file's bytes and walks them member by member or, where they are not packed, record by record.  Where a check
fails (no version line, a header that cannot be read, a length that runs past the end, a missing end mark, a digest that
differs, a member that does not inflate), it looks for the next member or version line, whichever comes first, goes on there,
and reports the bytes between as a quarantined gap.  A member may hold any number of records; they are walked in the same way,
and a broken member's whole records, as far as it inflates, are kept.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, materialize, scratch_dir

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
#: Payloads from this size on may be revisits.
LEAST_REVISIT = 1000
#: A file is closed at this size; only a record larger than that makes a larger file.
FILE_BYTES = 8 << 20
NO_DATE = "1970-01-01T00:00:00Z"


def record(kind: str, record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit has no block; its payload's length and digest are in its header."""
    block = b"" if kind == "revisit" else payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\\r\\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@dataclass
class Salvage:
    """Records as (offset, header fields, block), and gaps as (start, end, reason), of one file."""

    records: list[tuple[int, dict[str, str], bytes]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record that begins at ``at``; ValueError says which check fails."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise ValueError("no version line")
    stop = data.find(END, line.end() - 2)
    if stop < 0:
        raise ValueError("header without end")
    fields = {}
    for text in data[line.end() : stop].split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            raise ValueError("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise ValueError("no content length")
    start = stop + len(END)
    end = start + int(fields["content-length"])
    if data[end : end + len(END)] != END:
        raise ValueError("no end mark after the block")
    block = data[start:end]
    said = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if said and hashlib.sha1(block).hexdigest() != said:
        raise ValueError("block digest differs")
    return fields, block, end + len(END)


def salvage_plain(data: bytes) -> Salvage:
    """Records and gaps of bytes that are not packed."""
    found, at, bad, why = Salvage(), 0, None, ""
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
        except ValueError as error:
            if bad is None:
                bad, why = at, str(error)
            line = VERSION_LINE.search(data, at + 1)
            at = line.start() if line else len(data)
            continue
        if bad is not None:
            found.gaps.append((bad, at, why))
            bad = None
        found.records.append((at, fields, block))
        at = end
    if bad is not None:
        found.gaps.append((bad, len(data), why))
    return found


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member that begins at ``at`` holds, its end, and what is wrong with it, or nothing; fed by pieces, as what is
    left over is copied."""
    unpack, parts, fed, why = zlib.decompressobj(31), [], at, ""
    while not unpack.eof and not why:
        if fed >= len(data):
            why = "member without end"
            break
        try:
            parts.append(unpack.decompress(data[fed : fed + 16384]))
        except zlib.error:
            why = "member does not inflate"
            parts.append(_before_error(data, at, fed))
        fed = min(len(data), fed + 16384)
    return b"".join(parts), fed - len(unpack.unused_data), why


def _before_error(data: bytes, at: int, fed: int) -> bytes:
    """What a broken member gives of the piece that begins at ``fed``, byte by byte up to the error."""
    unpack, out = zlib.decompressobj(31), []
    for k in range(at, fed, 16384):
        unpack.decompress(data[k : k + 16384])
    try:
        for k in range(fed, min(len(data), fed + 16384)):
            out.append(unpack.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def salvage(data: bytes) -> Salvage:
    """What can be read of an archive's bytes; empty bytes have no records and no gaps.

    A record in a member has the member's offset.  A gap within a sound member has the member's place, and its reason tells
    the bytes of the content.  A broken member is a gap even where records of it were kept.
    """
    found, at, bad, why = Salvage(), 0, None, ""
    marks = re.compile(re.escape(MAGIC) + b"|" + VERSION_LINE.pattern)

    def sound(until: int) -> None:
        nonlocal bad
        if bad is not None:
            found.gaps.append((bad, until, why))
        bad = None

    while at < len(data):
        if data[at] == 0 and not data[at:].strip(b"\0"):
            break  # padding
        wrong, inner = "", None
        if data.startswith(MAGIC, at):
            content, end, wrong = inflate(data, at)
            inner = salvage_plain(content)
            if not inner.records and not wrong:
                wrong = inner.gaps[0][2] if inner.gaps else "empty member"
            after = at + 1 if end >= len(data) and wrong else end
        else:
            try:
                fields, block, end = parse_record(data, at)
            except ValueError as error:
                wrong, after = str(error), at + 1
        if wrong:
            if inner:
                found.records += [(at, fields, block) for _, fields, block in inner.records]
            if bad is None:
                bad, why = at, wrong
            mark = marks.search(data, at + 1 if wrong.startswith("member") else after)
            at = mark.start() if mark else len(data)
            continue
        sound(at)
        if inner:
            found.records += [(at, fields, block) for _, fields, block in inner.records]
            found.gaps += [(at, end, f"{reason}, bytes {a} to {b} of the member's content") for a, b, reason in inner.gaps]
        else:
            found.records.append((at, fields, block))
        at = end
    sound(len(data.rstrip(b"\0")) if bad is not None and at < len(data) else len(data))
    return found


def plan(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, payload, payload_digest, record_type, refers_to``: what to write for each page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("payload_digest", F.length("payload").alias("size")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    large = materialize(large.select("payload_digest", "size", "first_id"), "warc-repeated")
    joined = rows.withColumn("size", F.length("payload")).join(large, ["payload_digest", "size"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes archives of ``pages`` into the folder ``path``: gzip members, each file ended by a zero byte of padding."""
    bound_batches(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                made = member(record(row["record_type"], row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"]))
                held.append(made)
                size += len(made)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    files = plan(pages, id_col, url_col, html_col).mapInArrow(pack, "archive binary")
    # the text writer puts out a string's bytes as they are; each file takes one
    files.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """``file, offset, gap_end, reason, record_type, record_id, url, payload_bytes, payload_digest, refers_to, block``.

    A record's row has a null ``gap_end``; a quarantined gap's row has its first byte in ``offset``, its end in ``gap_end``,
    the first failed check in ``reason``, and nulls elsewhere.
    """
    bound_batches(spark)
    schema = "file string, offset long, gap_end long, reason string, record_type string, record_id long, url string, payload_bytes long, payload_digest string, refers_to long, block binary"

    def number(text: str) -> int | None:
        digits = re.search(r"-?\d+", text)
        return int(digits[0]) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split()[0] for x in schema.split(",")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = salvage(data.as_py())
                rows = [(file, at, None, None, h.get("warc-type"), number(h.get("warc-record-id", "")), h.get("warc-target-uri"), number(h.get("x-payload-length", str(len(block)))), h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h.get("warc-refers-to", "")), block) for at, h, block in found.records]
                rows += [(file, start, end, why, *[None] * 7) for start, end, why in found.gaps]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1000]), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from archives written and read.

    A null html is an empty payload.  Of records with equal payloads of at least 1000 bytes the one with the largest id is
    the response; rows that repeat that id are all responses.  A page without id can only revisit.  Digest and length of a
    response are taken from the block that was read.  Other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col)
    read = read_archives(spark, path).where("gap_end is null")
    response = F.col("record_type") == "response"
    return read.select(
        F.col("record_id").alias("page_id"),
        F.when(response, F.length("block").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("block")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     n AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest FROM p),
     f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM n)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
