"""WARC archives of pages, with long records in segments, and their reassembly.

The writer makes a gzip member a record. A record's block is an HTTP response whose body has chunked
transfer framing; a block over `segment_bytes` is split into a first record with WARC-Segment-Number 1 and
continuation records that name it in WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. A page
whose payload equals that of a page with a larger id is a revisit record without body.

The reader parses the archives, groups segments by origin, orders them by number, verifies the total length
and the block's digest, and decodes the chunked framing. Segments of a record may lie in different archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, scratch, ship, shuffle_partitions

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

_FILES = pa.schema([("file", pa.string()), ("n_records", pa.int64())])
_SEGMENTS = pa.schema(
    [
        ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("uri", pa.string()), ("type", pa.string()),
        ("payload_digest", pa.string()), ("refers_to", pa.string()), ("block_digest", pa.string()), ("block", pa.binary()),
    ]
)
_SEGMENTS_DDL = (
    "origin string, number int, total long, uri string, type string, payload_digest string, refers_to string, "
    "block_digest string, block binary"
)
_RECORDS_DDL = (
    "record_id string, uri string, record_type string, payload binary, payload_digest string, refers_to string"
)
_RECORDS = pa.schema(
    [
        ("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
        ("payload_digest", pa.string()), ("refers_to", pa.string()),
    ]
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, number: int = 1) -> str:
    """Equal for rows of equal id and payload only."""
    name = "null" if page_id is None else page_id
    return f"<urn:page:{name}:{payload_digest}{f':{number}' if number > 1 else ''}>"


def chunked(body: bytes, size: int = 8192) -> bytes:
    """HTTP chunked framing."""
    out = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line_end = framed.index(END, at)
        size = int(framed[at:line_end].split(b";")[0], 16)
        at = line_end + 2
        if not size:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != END:
            raise ValueError("a chunk is cut short")
        out.append(framed[at : at + size])
        at += size + 2


def http_block(payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    return head + chunked(payload)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response block, without transfer framing."""
    head, _, body = block.partition(END + END)
    fields = dict(x.split(b":", 1) for x in head.lower().split(END)[1:] if b":" in x)
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    raw = END.join(lines) + END + END + block + END + END
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records_of(page_id, uri, payload: bytes, payload_digest, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """The archive members of one page: a response in one or more segments, or a revisit."""
    uri = (uri or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    named = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, payload_digest)), *named]
        yield _record([*fields, ("WARC-Refers-To", record_id(refers_to, payload_digest)), ("WARC-Profile", REVISIT_PROFILE)], b"")
        return
    block = http_block(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    whole = len(parts) == 1
    for k, part in enumerate(parts, 1):
        yield _record(
            [
                ("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(page_id, payload_digest, k)), *named,
                ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Block-Digest", f"sha1:{digest(block)}" if k == 1 else None),
                ("WARC-Segment-Number", None if whole else k),
                ("WARC-Segment-Origin-ID", record_id(page_id, payload_digest) if k > 1 else None),
                ("WARC-Segment-Total-Length", len(block) if k > 1 and k == len(parts) else None),
            ],
            part,
        )


def members(file, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    held = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        held = held or file.read(size)
        if not held:
            return
        while not unpack.eof:
            if not held:
                held = file.read(size)
                if not held:
                    raise ValueError("the archive is cut short")
            out.append(unpack.decompress(held))
            held = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names lower-case) and block of a record."""
    head, _, rest = raw.partition(END + END)
    version, *lines = head.split(END)
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record's block is cut short")
    return fields, block


def write_warc(pages: DataFrame, folder: str, segment_bytes: int = 32 << 10) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; returns file, n_records of each.

    Of pages with equal payloads the one with the largest page_id is the response, the others are revisits of
    it; pages that share this largest id too are all responses. Null html is an empty payload, null url is
    about:blank, a null page_id is smallest. Other columns are ignored; no rows give no archive with records.
    Only files that the returned table names count: a repeated task leaves files that nothing refers to.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(html, "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # Ids only are aggregated; a payload that very many pages share is a skewed key of a plain join.
    largest = rows.groupBy("sha1").agg(F.max("page_id").alias("original"))
    named = rows.join(largest, "sha1").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, count = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
        fs, path = pyarrow.fs.FileSystem.from_uri(file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for rows in batches:
                columns = [rows.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
                for page_id, url, payload, sha1, refers_to in zip(*columns):
                    bare = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    for record in records_of(page_id.as_py(), url.as_py(), payload.as_py(), bare, refers_to.as_py(), segment_bytes):
                        out.write(record)
                        count += 1
        yield batch(_FILES, [[file], [count]])

    files = named.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "file string, n_records long")
    files.write.parquet(f"{folder}/files")
    return pages.sparkSession.read.parquet(f"{folder}/files")


def _bare(value: str | None) -> str | None:
    return value.rpartition(":")[2] if value else None


def read_segments(files: DataFrame) -> DataFrame:
    """Every record of the archives, segments apart; origin is the record itself or the one it continues."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for uri in rows.column("file").to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                found, size = [], 0
                with fs.open_input_stream(path) as file:
                    for raw in members(file):
                        f, block = parsed(raw)
                        total = f.get("warc-segment-total-length")
                        found.append(
                            (
                                f.get("warc-segment-origin-id", f["warc-record-id"]), int(f.get("warc-segment-number", 0)),
                                int(total) if total else None, f.get("warc-target-uri"), f["warc-type"],
                                _bare(f.get("warc-payload-digest")), f.get("warc-refers-to"), _bare(f.get("warc-block-digest")), block,
                            )
                        )
                        size += len(block)
                        if size >= 8 << 20:
                            yield batch(_SEGMENTS, list(zip(*found)))
                            found, size = [], 0
                if found:
                    yield batch(_SEGMENTS, list(zip(*found)))

    parts = shuffle_partitions(files.sparkSession)
    return files.select("file").repartition(parts, "file").mapInArrow(run, _SEGMENTS_DDL)


def joined_segments(segments: list[tuple]) -> tuple:
    """One record of (number, total, uri, type, payload_digest, refers_to, block_digest, block), sorted by number."""
    first, last = segments[0], segments[-1]
    if [s[0] for s in segments] not in ([0], list(range(1, len(segments) + 1))):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s[7] for s in segments)
    if first[0] and last[1] != len(block):
        raise ValueError(f"segments hold {len(block)} bytes, not {last[1]}")
    if first[6] and digest(block) != first[6]:
        raise ValueError("the block's digest differs")
    if first[3] == "revisit":
        return first[2], first[3], None, first[4], first[5]
    payload = payload_of(block)
    if first[4] and digest(payload) != first[4]:
        raise ValueError("the payload's digest differs")
    return first[2], first[3], payload, first[4], first[5]


def copies_of(segments: list[tuple]) -> list[list[tuple]]:
    """Segments of one origin, sorted by number: a record written more than once gets one of each number per copy."""
    copies = sum(s[0] <= 1 for s in segments) or 1
    return [segments[c::copies] for c in range(copies)]


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("origin", "number", "total", "uri", "type", "payload_digest", "refers_to", "block_digest", "block")
    last, held, found, size = None, [], [], 0
    for rows in batches:
        for origin, *segment in zip(*(rows.column(c).to_pylist() for c in names)):
            if held and (origin != last or segment[0] == 0):
                found += [(last, *joined_segments(one)) for one in copies_of(held)]
                size += len(found[-1][3] or b"")
                held = []
            if size >= 8 << 20:
                yield batch(_RECORDS, list(zip(*found)))
                found, size = [], 0
            last = origin
            held.append(tuple(segment))
    if held:
        found += [(last, *joined_segments(one)) for one in copies_of(held)]
    if found:
        yield batch(_RECORDS, list(zip(*found)))


def read_warc(files: DataFrame) -> DataFrame:
    """record_id, uri, record_type, payload, payload_digest, refers_to of each record, segments joined.

    payload is null for a revisit. A record with missing segments, a wrong total length, damaged framing or a
    wrong digest fails the read. Only one record is held at a time.
    """
    segments = read_segments(files)
    parts = shuffle_partitions(files.sparkSession)
    split = segments.filter("number > 0").repartition(parts, "origin").sortWithinPartitions("origin", "number")
    whole = segments.filter("number = 0")
    return whole.mapInArrow(_reassembled, _RECORDS_DDL).unionByName(split.mapInArrow(_reassembled, _RECORDS_DDL))


def roundtrip(pages: DataFrame, segment_bytes: int = 32 << 10) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as the archives give them back."""
    records = read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), segment_bytes))
    read = records.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+):', 1) as bigint)").alias("page_id"),
        F.octet_length("payload").cast("long").alias("bytes"), "payload_digest", "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+):', 1) as bigint)").alias("refers_to"),
    )
    # A revisit has no body; its length is that of the response with the same digest.
    sizes = read.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("bytes").alias("payload_bytes"))
    # What is read from files has no size estimate that a broadcast could be decided on.
    return read.hint("merge").join(sizes.hint("merge"), "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
