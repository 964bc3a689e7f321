"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

Every record is a gzip member of its own. Spark's text writer puts them into
files on any file system it reaches; its line separator is an empty gzip member,
so a file is an ordinary .warc.gz. The reader checks every member and record.
After a failed check it searches for the next member or version line that
passes, goes on from there, and logs the bytes between as a quarantined gap. It
does so in files and in what members hold, as far as they can be inflated.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.sources.staging import new_folder

LEAST_REVISIT = 100
RECORDS_PER_FILE = 4000
#: Larger payloads are written apart, fewer to a file, so that a file of either kind holds FILE_BYTES at most, or one record.
LARGE, FILE_BYTES = 1 << 16, 1 << 28
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_PIECE = 1 << 16
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31)
EMPTY_MEMBER = _EMPTY.compress(b"") + _EMPTY.flush()
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """The bytes of a response record, or of a revisit that names the record with the same payload."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"" if revisit else _HTTP % len(payload) + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, revisit and refers_to of every page.

    Of pages with equal payloads of LEAST_REVISIT bytes or more those with the
    smallest page_id are responses. Digests are compared without their pages,
    so a payload that many pages share moves no text.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", body.alias("payload"))
    thin = pages.filter(F.length("payload") >= LEAST_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest")).distinct()
    first = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = thin.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha2("payload", 256) == F.col("_digest"))
    joined = pages.join(later, same, "left")
    return joined.select("page_id", "url", "payload", F.col("_digest").isNotNull().alias("revisit"), "refers_to")


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record for each row of page_id, url, html (null: empty), in files bounded by records and bytes.

    Payloads of more than LARGE bytes have files of their own, each for as many
    records as FILE_BYTES holds of the largest of them.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            made = [member(record(i, u, p, r, v)) for i, u, p, v, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    told = with_roles(pages)
    size = F.octet_length("payload")
    largest = pages.agg(F.max(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    few = max(1, min(records_per_file, FILE_BYTES // max(largest, 1)))
    kinds = [(told, records_per_file)]
    if largest > LARGE:
        kinds = [(told.filter(size <= LARGE), records_per_file), (told.filter(size > LARGE), few)]
    for rows, per_file in kinds:
        members = rows.mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
        # The separator's bytes are written as they are in this encoding.
        members.write.mode("append").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option(
            "maxRecordsPerFile", per_file
        ).text(path)


def inflated(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at a place, and "".

    Of a damaged or cut member it is what comes before the damage, the place
    itself, and the reason: "checksum" where only the check at its end fails.
    """
    unpack, out, start = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and at < len(data):
            part = data[at : at + _PIECE]
            out.append(unpack.decompress(part))
            at += len(part)
    except zlib.error as e:
        return _before_error(data, start), start, "checksum" if re.search("incorrect (data|length) check", str(e)) else "damaged"
    return (b"".join(out), at - len(unpack.unused_data), "") if unpack.eof else (b"".join(out), start, "cut")


def _before_error(data: memoryview, at: int) -> bytes:
    """All that a damaged member gives up to its error, which zlib raises in place of what it has inflated."""
    unpack, out, size = zlib.decompressobj(31), [], _PIECE
    while size:
        before = unpack.copy()
        try:
            out.append(unpack.decompress(data[at : at + size]))
            at += size
        except zlib.error:
            unpack, size = before, size // 2
    one = data[at : at + 1]
    try:
        while byte := unpack.decompress(one, 1):
            out.append(byte)
            one = unpack.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def _place_of(data: memoryview, at: int, size: int) -> int:
    """Where the compressed bytes of the first ``size`` bytes of a member's content end."""
    unpack, left = zlib.decompressobj(31), size - 1
    while left > 0:
        part = data[at : at + _PIECE]
        left -= len(unpack.decompress(part, left))
        at += len(part) - len(unpack.unconsumed_tail)
    return at


_HEADER = re.compile(rb"WARC/1\.\d\r\n(?:[^\r\n]+\r\n)*\r\n")


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and end of the record at a place; None if a check fails."""
    m = _HEADER.match(data, at)
    if not m:
        return None
    fields = {}
    for line in m[0].decode("utf-8", "replace").split("\r\n")[1:-2]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or not fields.get("warc-record-id"):
        return None
    end = m.end() + int(length)
    block = data[m.end() : end]
    if len(block) != int(length) or data[end : end + 4] != b"\r\n\r\n":
        return None
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        return None
    return fields, block, end + 4


def _records_inside(inner: bytes) -> tuple[list[tuple[str, dict[str, str], bytes]], int]:
    """Reason ("" for a record), fields and block of the records and gaps of a member's content, and where its last record ends."""
    found, last, at = [], 0, 0
    while at >= 0 and at < len(inner):
        one = parsed(inner, at)
        if one:
            found.append(("", *one[:2]))
            last = at = one[2]
            continue
        if not found or not found[-1][0]:
            found.append(("damaged record in a member", {}, b""))
        at = inner.find(VERSION, at + 1)
    return found, last


def salvaged(data: bytes) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """Begin, end, reason ("" for a record), fields and block of all records and gaps of a file, in order.

    Records and gaps inside one member all tell that member's place. Of a
    damaged or cut member the records before the damage are told, at the place
    of the bytes that hold them; the gap begins there. They pass the same checks
    as others, so one without a digest is known by its length and end alone.
    Where a member of one record fails its checksum, that record is a gap.
    """
    view, at, gap, why = memoryview(data), 0, -1, ""
    while at < len(data):
        found: list[tuple[str, dict[str, str], bytes]] | None = None
        end, reason, damaged = at, "no record begins here", ""
        if data.startswith(MAGIC, at):
            inner, end, damaged = inflated(view, at)
            found, last = _records_inside(inner)
            good = sum(not x[0] for x in found)
            reason = "damaged member" if damaged else "damaged record in a member"
            if damaged:
                # What is behind the last record belongs to the gap.
                found = found[:-1] if found and found[-1][0] else found
            if (inner or damaged) and not good or damaged == "checksum" and good == 1 == len(found):
                found = None
            elif damaged:
                end = max(at + 1, _place_of(view, at, last))
        elif data.startswith(VERSION, at):
            one = parsed(data, at)
            reason = "damaged record"
            if one:
                found, end = [("", *one[:2])], one[2]
        if found is None:
            if gap < 0:
                gap, why = at, reason
            at = _next_start(data, at + 1)
            continue
        if gap >= 0:
            yield gap, at, why, {}, b""
            gap = -1
        for one in found:
            yield at, end, *one
        at = end
        if damaged:
            gap, why = at, reason
            at = _next_start(data, at)
    if gap >= 0 and gap < len(data):
        yield gap, len(data), why, {}, b""


def _next_start(data: bytes, at: int) -> int:
    ahead = [x for x in (data.find(MAGIC, at), data.find(VERSION, at)) if x >= 0]
    return min(ahead, default=len(data))


_FIELDS = "file string, begin long, end long, gap string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all files of a folder.

    A row of a gap has its reason in ``gap`` and no record columns; a record's
    ``gap`` is null. ``begin`` and ``end`` are byte places in the file. Digest
    and size are those of the whole payload: of a response's own bytes, and of
    a revisit as its header tells. An empty file has no rows.
    """
    names = [c.split()[0] for c in _FIELDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def row(file: str, begin: int, end: int, why: str, fields: dict[str, str], block: bytes) -> tuple:
        if why:
            return (file, begin, end, why, *[None] * 7)
        kind = fields.get("warc-type")
        payload = None
        digest, size = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, fields.get("warc-payload-length")
        size = int(size) if size and size.isdigit() else None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        return (
            file, begin, end, None, fields["warc-record-id"], kind, fields.get("warc-target-uri"),
            fields.get("warc-refers-to"), digest, size, payload if payloads else None,
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for found in salvaged(content.as_py()):
                    rows.append(row(file.as_py(), *found))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, _FIELDS)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Pages after a round trip through archives in the shared folder.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A null html
    is an empty payload. Rows that repeat the smallest page_id of a payload are
    all responses; a null page_id counts as larger than any other. An empty
    table gives no rows; extra columns are ignored. A gap in the archives fails
    the job. A file is read as one value of FILE_BYTES at most before it is
    compressed, or one page.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    id_type = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as {id_type})")
    found = read_archives(spark, path, payloads=False)
    # Its own archives are whole; a gap would be lost pages.
    lost = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "gap")).cast(id_type)
    return found.select(
        F.when(F.col("gap").isNotNull(), lost).otherwise(number("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
