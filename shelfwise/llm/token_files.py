"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file (all numbers little-endian):

    frame*        zstandard frames, each the ids of some whole documents, unsigned 16- or 32-bit
    index         skippable frame 0x184D2A5D: id width u8, documents u32, then four columns:
                  doc_id i64*, id is null u8*, frame u32*, ids u32*
    seek table    skippable frame 0x184D2A5E of the seekable zstandard format: per frame compressed
                  size u32, decompressed size u32, checksum u32 (low half of XXH64 of the content);
                  then frames u32, descriptor u8 (0x80: checksums), 0x8F92EAB1

Any zstandard tool can decompress the file whole. A reader fetches the tail and only the frames that hold
the requested documents, and verifies their checksums.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, held, ship, shuffle_partitions, text_bytes
from shelfwise.llm.encode import encoder

# Fixed values of the file format.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
SEEK_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema(
    [("shard", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())]
)


class FrameWriter:
    """Appends documents to an open file; a frame is closed at `frame_ids` ids."""

    def __init__(self, out, width: int, frame_ids: int, level: int = 3):
        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.open, self.open_ids, self.n_ids = [], 0, 0
        self.docs, self.frames = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        n = len(ids) // self.width
        self.docs.append((doc_id, len(self.frames), n))
        self.open.append(ids)
        self.open_ids += n
        self.n_ids += n
        if self.open_ids >= self.frame_ids:
            self.close_frame()

    def close_frame(self) -> None:
        content = b"".join(self.open)
        packed = self.pack(content)
        self.out.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.open, self.open_ids = [], 0

    def close(self) -> None:
        if self.open:
            self.close_frame()
        ids, frames, sizes = zip(*self.docs) if self.docs else ((), (), ())
        index = struct.pack("<BI", self.width, len(ids)) + b"".join(
            (
                np.array([i or 0 for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids], "u1").tobytes(),
                np.array(frames, "<u4").tobytes(),
                np.array(sizes, "<u4").tobytes(),
            )
        )
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Random access to a file written by FrameWriter. file: seekable, opened for reading."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        frames, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * frames
        table = np.frombuffer(self._at(table_at, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.packed, self.content, self.checks = table.T if frames else np.zeros((3, 0), np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        index_at = int(self.starts[-1])
        magic, _ = struct.unpack("<II", self._at(index_at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index behind the frames")
        body = self._at(index_at + 8, table_at - 8 - index_at - 8)
        self.width, n = struct.unpack_from("<BI", body)
        ids, at = np.frombuffer(body, "<i8", n, 5), 5 + 8 * n
        null, at = np.frombuffer(body, "u1", n, at), at + n
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.frame_of = np.frombuffer(body, "<u4", n, at).astype(np.int64)
        self.sizes = np.frombuffer(body, "<u4", n, at + 4 * n).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.sizes)])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        content = self.unpack(self._at(int(self.starts[k]), int(self.packed[k])), max_output_size=int(self.content[k]))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted=None) -> Iterator[tuple[int, int | None, int, bytes]]:
        """place, doc_id, ids before it in the file and its ids as little-endian 32-bit bytes; wanted: doc_ids."""
        last, content, frame_start = -1, b"", 0
        first_of = {}
        for place, k in enumerate(self.frame_of.tolist()):
            first_of.setdefault(k, int(self.before[place]))
        for place, doc_id in enumerate(self.doc_ids):
            if wanted is not None and doc_id not in wanted:
                continue
            k = int(self.frame_of[place])
            if k != last:
                last, content, frame_start = k, self.frame(k), first_of[k]
            at = (int(self.before[place]) - frame_start) * self.width
            ids = content[at : at + int(self.sizes[place]) * self.width]
            if self.width == 2:
                ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            yield place, doc_id, int(self.before[place]), ids


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str, frame_ids: int = 65_536, files: int | None = None,
    cache_words: int = 300_000,
) -> DataFrame:
    """Encodes each whole text, appends end_id and writes files in ascending doc_id order; returns the manifest.

    Manifest: shard (files in doc_id order), file, n_docs, n_ids; only files named there belong to the
    result, what a lost or repeated task left behind doesn't. Null text is empty (the end id alone), a null
    doc_id comes first, equal ids stand by text, other columns are ignored, no rows give empty files or none.
    files: how many; by default as many as the session's shuffle partitions, or one for each 64 MB of text if that is more.
    cache_words: words whose ids a worker keeps, about 200 bytes each. Ids must be below 2**32; a vocabulary below 2**16 is stored in 16 bits.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer, cache_words), struct.pack("<I", end_id)
        width = 2 if max(known.tokenizer.get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokz"
        fs, path = _open(file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            writer = FrameWriter(out, width, frame_ids)
            for rows in batches:
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
                    writer.add(doc_id, known.ids(text.as_py()) + end)
            writer.close()
        yield batch(_MANIFEST, [[shard], [file], [len(writer.docs)], [writer.n_ids]])

    files = files or max(shuffle_partitions(spark), text_bytes(docs)[1] // (64 << 20))
    sorted_docs = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    manifest = sorted_docs.mapInArrow(run, "shard int, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """shard, place in it, doc_id, before (ids before it in its file), ids (32-bit little-endian) from the files.

    wanted: only these doc_ids, a list small enough for each task; only their frames are decompressed.
    """
    ship(manifest.sparkSession)
    chosen = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("token-files", dict)  # a writer's words aren't needed any more
        for rows in batches:
            for shard, uri in zip(rows.column("shard").to_pylist(), rows.column("file").to_pylist()):
                fs, path = _open(uri)
                with fs.open_input_file(path) as file:
                    found, size = [], 0
                    for doc in FrameReader(file).documents(chosen):
                        found.append((shard, *doc))
                        size += len(doc[3])
                        if size >= 8 << 20:
                            yield batch(_READ, list(zip(*found)))
                            found, size = [], 0
                    if found:
                        yield batch(_READ, list(zip(*found)))

    files = manifest.select("shard", "file")
    # By default a task opens about one file, however many the data needed.
    parts = max(shuffle_partitions(manifest.sparkSession), files.count())
    return files.repartition(parts, "shard").mapInArrow(
        run, "shard int, place long, doc_id long, before long, ids binary"
    )


def token_spans(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document; start counts over all files in order."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = manifest.select("shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    read = read_token_files(manifest).select(
        "shard", "doc_id", "before", F.octet_length("ids").alias("n_bytes"), F.crc32("ids").alias("ids_crc32")
    )
    return read.join(base, "shard").select(
        "doc_id",
        (F.col("base") + F.col("before")).alias("start"),
        (F.col("n_bytes") / 4).cast("long").alias("n_tokens"),
        "ids_crc32",
    )
