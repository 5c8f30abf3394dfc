"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes every record a gzip member of its own; the reader takes any number of records a member.
All records and gaps of a member have its offset and length. The reader checks each member and record (gzip checksum,
version line, length, block and payload digest); where a check fails it searches for the next member
or version line that passes, whichever comes first (what a place holds is decided there, not per file), returns the
records from there on and logs the bytes in between as a gap. Of a member that is damaged or cut it returns
the records that inflate and pass their own checks, and, by their ids, those that lie between two points at
which the compressor had flushed; behind a fault that ends a stream without such points nothing can be inflated. The
offsets and lengths of records and gaps cover a file without holes.

Nulls, ties and odd input: a null html is an empty payload; a null url an empty target; a null page_id
takes part in a group but never names it; rows that repeat the naming page_id are responses too; an
empty table writes no file and reads back no rows; line ends in a url are percent-encoded; only page_id,
url and html are read. Payloads may have any length; one record and one file of about ``FILE_BYTES`` are in
memory at once, a longer record makes a longer file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch
from tidemark.llm.registry import query, table

#: Payloads shorter than this are never revisited.
LEAST_SHARED = 1000
#: A file is closed once its members hold so many bytes.
FILE_BYTES = 8 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: What a compressor writes where it flushes: an empty stored block, on a byte boundary.
FLUSHED = b"\x00\x00\xff\xff"
#: Spark's writer ends every row with a separator; an empty member keeps the file a valid gzip file.
EMPTY = gzip.compress(b"", mtime=0)
READ = (
    "file string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, "
    "refers_to string, target string, payload_bytes bigint, payload_digest string, payload binary"
)
NAMES = [f.split()[0] for f in READ.split(", ")]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, is_revisit: bool) -> bytes:
    """The plain bytes of one record; a revisit holds the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if is_revisit:
        lines[2:2] = [f"WARC-Refers-To: {record_id(revisits)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_owner(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, and ``owner``: the largest page_id of the equal payloads, for groups of two or more.

    The groups are counted by digest with partial aggregation; only groups with copies are joined back.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    shared = rows.where(F.octet_length("html") >= least).groupBy("_sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("_n"))
    return rows.join(shared.where("_n > 1").drop("_n"), "_sha", "left").drop("_sha")


def write_warc(pages: DataFrame, out: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write a record per page; returns the folder of the files (each about ``file_bytes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["file"])

        for batch in batches:
            for page_id, url, html, owner in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "owner")], strict=True):
                again = owner is not None and page_id != owner
                plain = record(page_id, url, html.encode("utf-8", "surrogatepass"), owner, again)
                members.append(gzip.compress(plain, 6, mtime=0))
                total += len(members[-1])
                if total >= file_bytes:
                    yield close()
                    members, total = [], 0
        if members:
            yield close()

    out = out or scratch(pages.sparkSession, "warc")
    blobs = with_owner(pages).mapInArrow(run, "file binary")
    writer = blobs.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(out)
    return out


@dataclass
class Found:
    """A record or a gap of a file; ``length`` counts the file's bytes."""

    offset: int
    length: int
    kind: str = "record"
    reason: str | None = None
    fields: dict[str, str] | None = None
    payload: bytes | None = None
    stated: int | None = None


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, bytes used) of the record at ``at``; ValueError says what is wrong."""
    if not raw.startswith(VERSION, at):
        raise ValueError("no version line")
    split = raw.find(b"\r\n\r\n", at)
    if split < 0:
        raise ValueError("header not ended")
    lines = raw[at:split].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    first, end = split + 4, split + 4 + int(fields["content-length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length does not fit")
    block = raw[first:end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != base32(hashlib.sha1(block).digest()):
        raise ValueError("block digest differs")
    return fields, block, end + 4 - at


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The checked payload of a response; None for other records."""
    if fields.get("warc-type") != "response":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    want = fields.get("warc-payload-digest")
    if want is not None and want != base32(hashlib.sha1(payload).digest()):
        raise ValueError("payload digest differs")
    return payload


def inflated(inflate, view: memoryview, at: int, stop: int) -> tuple[bytes, int, str | None]:
    """(plain bytes, where reading ended, the fault or None) of compressed data from ``at`` on."""
    plain, step = [], 1 << 16
    while not inflate.eof:
        part = view[at : min(at + step, stop)]
        if not len(part):
            return b"".join(plain), at, "cut short"
        before = inflate.copy()
        try:
            plain.append(inflate.decompress(part))
            at += len(part)
        except zlib.error as e:
            if step == 1:
                return b"".join(plain), at, f"broken: {e}"
            inflate, step = before, 1  # up to the very byte
    return b"".join(plain), at - len(inflate.unused_data), None


def resumed(view: memoryview, raw: bytes, at: int, stop: int) -> Iterator[Found]:
    """Records that lie between two flush points of a member, inflated from the first of the two alone."""
    at = raw.find(FLUSHED, at, stop)
    while at >= 0:
        following = raw.find(FLUSHED, at + len(FLUSHED), stop)
        # What lies further back than the flush point is unknown; records that refer to it fail their checks.
        fresh = zlib.decompressobj(wbits=-15, zdict=bytes(1 << 15))
        plain, _, _ = inflated(fresh, view, at + len(FLUSHED), stop if following < 0 else following + len(FLUSHED))
        yield from (f for f in records_in(plain) if f.kind == "record")
        at = following


def next_version(raw: bytes, start: int) -> int:
    """The next version line that starts a line, or -1."""
    at = raw.find(VERSION, start)
    while at > 0 and raw[at - 1 : at] != b"\n":
        at = raw.find(VERSION, at + 1)
    return at


def records_in(plain: bytes) -> Iterator[Found]:
    """The records of plain bytes that pass their checks, in order, and the gaps between them."""
    at, gap, why = 0, None, ""
    while at < len(plain):
        try:
            # A record ends before the next version line at the latest; its own length says where.
            fields, block, used = parse(plain, at)
            found = Found(at, used, fields=fields, payload=payload_of(fields, block), stated=stated_length(block))
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = next_version(plain, at + 1)
            at = len(plain) if at < 0 else at
            continue
        if gap is not None:
            yield Found(gap, at - gap, "gap", why)
            gap = None
        yield found
        at += used
    if gap is not None:
        yield Found(gap, len(plain) - gap, "gap", why)


def next_start(raw: bytes, at: int) -> int:
    """The next place from ``at`` on that may begin a member or a record."""
    found = [x for x in (raw.find(MAGIC, at), next_version(raw, at)) if x >= 0]
    return min(found, default=len(raw))


def read_member(raw: bytes, view: memoryview, at: int) -> tuple[list[Found] | Iterator[Found], int]:
    """(records and gaps, length) of the gzip member at ``at``; ValueError if it holds no record."""
    plain, end, fault = inflated(zlib.decompressobj(wbits=31), view, at, len(raw))
    if fault is None:
        inside = records_in(plain)
        first = next(inside, None)
        if first and first.kind == "gap" and first.length == len(plain):
            raise ValueError(first.reason)  # no record at all
        return _told(chain([first] if first else [], inside), at, end - at, len(plain)), end - at
    # A sound member that begins before the fault showed ends this one.
    stop, begin = len(raw), raw.find(MAGIC, at + 1)
    while begin >= 0:
        if inflated(zlib.decompressobj(wbits=31), view, begin, len(raw))[2] is None:
            stop = begin
            break
        begin = raw.find(MAGIC, begin + 1)
    before = list(records_in(plain))
    known = {f.fields.get("warc-record-id") for f in before if f.kind == "record"}
    after = [f for f in resumed(view, raw, at, stop) if f.fields.get("warc-record-id", None) not in known | {None}]
    if not after and all(f.kind == "gap" for f in before):
        raise ValueError(f"member {fault}")
    lost = Found(0, 0, "gap", f"member {fault} at byte {min(end, stop) - at}")
    return [*_told(before, at, stop - at, len(plain)), *_told([lost, *after], at, stop - at, None)], stop - at


def _told(found, at: int, used: int, size: int | None) -> Iterator[Found]:
    """What a member holds, with the member's place; gaps say where in it they are."""
    for f in found:
        if f.kind == "gap" and size is not None:
            f.reason = f"{f.reason} (bytes {f.offset} to {f.offset + f.length} of the member's {size})"
        f.offset, f.length = at, used
        yield f


def salvage(raw: bytes) -> Iterator[Found]:
    """All records that pass their checks, in order, and the gaps between them."""
    view, at, gap, why = memoryview(raw), 0, None, ""
    while at < len(raw):
        try:
            if raw.startswith(MAGIC, at):
                found, used = read_member(raw, view, at)
            else:
                fields, block, used = parse(raw, at)
                found = [Found(at, used, fields=fields, payload=payload_of(fields, block), stated=stated_length(block))]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = next_start(raw, at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, "gap", why)
            gap = None
        yield from found
        at += used
    if gap is not None:
        yield Found(gap, len(raw) - gap, "gap", why)


def stated_length(block: bytes) -> int | None:
    """The payload length that the HTTP header of a block states."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record and gap (``kind``) of the files under ``path``: see ``READ`` for the columns.

    ``payload_digest`` is lower-case hex; a revisit carries the digest and length of what it refers to.
    """

    def row(file: str, f: Found) -> tuple:
        if f.kind == "gap":
            return (file, f.offset, f.length, "gap", f.reason, None, None, None, None, None, None, None)
        h = f.fields or {}
        digest, size = h.get("warc-payload-digest", ""), f.stated
        if f.payload is not None:
            digest, size = hashlib.sha1(f.payload).hexdigest(), len(f.payload)
        else:
            digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        return (
            file, f.offset, f.length, "record", None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"),
            h.get("warc-target-uri"), size, digest, f.payload if with_payload else None,
        )

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                held = 0
                for f in salvage(raw.as_py()):
                    rows.append(row(file, f))
                    held += len(f.payload or b"") if with_payload else 0
                    if len(rows) >= 10_000 or held >= 1 << 24:
                        yield pack_rows(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pack_rows(rows, kinds)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, READ)


def pack_rows(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def gaps(read: DataFrame) -> DataFrame:
    """The quarantine log: file, offset, length, reason."""
    return read.where("kind = 'gap'").select("file", "offset", "length", "reason")


@query(
    "op4_warc_salvage",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
      FROM pages
    )
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
    FROM p
    """,
)
def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"))
    read = read_warc(spark, files, with_payload=False).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, "urn:page:(-?\\d+)", 1).try_cast("long")
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
