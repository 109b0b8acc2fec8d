"""Media columns: payloads stored as 8-bit samples in archives, read back by a custom Spark data source.

write_media stores each payload as a WAV file (8-bit mono; a fact chunk holds the unpadded size) in ZIP shards of the shared folder, deflated,
and returns a manifest of the shards that finished tasks wrote. The data source "archive_media" plans byte ranges over the shards of a
manifest: the driver sees shard names and sizes only, and plans at most MOST_PARTITIONS, of several ranges each if need be. A task reads its shards'
directories, takes the members whose header lies in its ranges, reads each by its own offset, with retries that touch this member alone, and
streams them as Arrow batches bounded in bytes. A directory that can't be read is tried again too.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import arrow_batches, bytes_of, cut, fresh_path, slices, table

BLOCK = 64
HEADER = 56
RATE = 8000
SHARD_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: Partitions that a read has at most; beyond, ranges are joined to larger ones.
MOST_PARTITIONS = 65_536
TRIES = 4


def payload_of(data: bytes) -> bytes:
    """data and bytes 0 up to a positive multiple of 64."""
    return data + bytes(BLOCK * max(1, -(-len(data) // BLOCK)) - len(data))


def wav(payload: bytes, n: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sII4sI", b"RIFF", HEADER - 8 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"fact", 4, n, b"data", len(payload))
    return head + payload


def unwav(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded size) of a stored file."""
    size = struct.unpack_from("<I", media, HEADER - 4)[0]
    if media[:4] != b"RIFF" or len(media) != HEADER + size:
        raise ValueError("not a whole media file")
    return media[HEADER:], struct.unpack_from("<I", media, 44)[0]


def features(payload: bytes) -> str:
    """Mean, root mean square and zero crossings of the samples around 128, exact to the digits shown."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    total, square = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={total / len(x):.6f};rms={(square / len(x)) ** 0.5:.6f};crossings={crossings};samples={len(x)}"


def write_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A manifest (path, size, members) of the shards that hold every row's text (null: empty) as a media file.

    Rows repeat as they do in docs; a null doc_id is stored as such. Shards of lost or repeated task attempts stay out of the manifest.
    Other columns of docs are not read. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = fresh_path(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        shard = None
        for batch in slices(batches, "text", BATCH_BYTES):
            data, offs = bytes_of(batch.column("text"))
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                if shard is None:
                    path = f"{top}/{uuid.uuid4().hex}.zip"
                    sink = files.open_output_stream(path)
                    shard = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    members = 0
                text_bytes = data[offs[i] : offs[i + 1]].tobytes()
                info = zipfile.ZipInfo("null" if key is None else f"id/{key}")
                info.compress_type = zipfile.ZIP_DEFLATED
                shard.writestr(info, wav(payload_of(text_bytes), len(text_bytes)), compresslevel=1)
                members += 1
                if sink.tell() >= SHARD_BYTES:
                    yield closed(files, shard, sink, path, members)
                    shard = None
        if shard is not None:
            yield closed(files, shard, sink, path, members)

    def closed(files, shard, sink, path: str, members: int) -> pa.RecordBatch:
        shard.close()
        sink.close()
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "size": [files.get_file_info(path).size], "members": [members]})

    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return cut(slim.mapInArrow(run, "path string, size long, members long"), "media-manifest")


class ByteRanges(InputPartition):
    """Members of shards whose local header begins in [start, end): a list of (path, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def plan_ranges(shards: list[tuple[str, int]], range_bytes: int, most: int = MOST_PARTITIONS) -> list[list[tuple[str, int, int]]]:
    """Lists of (path, start, end) that cover all shards (path, size) once, in order: each of about range_bytes, or more where that would make over most lists."""
    share = max(range_bytes, -(-sum(n for _, n in shards) // most))
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, size in shards:
        for start in range(0, size, share):
            end = min(start + share, size)
            if end - start > room:
                out.append([])
                room = share
            out[-1].append((path, start, end))
            room -= end - start
    return out


def retried(what, tries: int = TRIES, wait: float = 0.2):
    """what(), again after a failed read, with growing pauses."""
    for attempt in range(tries):
        try:
            return what()
        except (OSError, zlib.error, ValueError, struct.error, zipfile.BadZipFile):
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("tries must be positive")


def directory(source) -> list[zipfile.ZipInfo]:
    with zipfile.ZipFile(source) as z:
        return sorted(z.infolist(), key=lambda m: m.header_offset)


def read_member(open_file, info: zipfile.ZipInfo, tries: int = TRIES, wait: float = 0.2) -> bytes:
    """One member by its own offset. A failed read is repeated on a newly opened file; other members are not read again."""

    def once() -> bytes:
        with open_file() as f:
            return member_at(f, info)

    return retried(once, tries, wait)


def members_of(open_file, start: int, end: int) -> list[zipfile.ZipInfo]:
    with open_file() as f:
        return [m for m in directory(f) if start <= m.header_offset < end]


def member_at(f, info: zipfile.ZipInfo) -> bytes:
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {info.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(info.header_offset + 30 + name + extra)
    packed = f.read(info.compress_size)
    out = zlib.decompress(packed, -15) if info.compress_type == zipfile.ZIP_DEFLATED else packed
    if len(out) != info.file_size or zlib.crc32(out) != info.CRC:
        raise ValueError(f"member at {info.header_offset} is damaged")
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.manifest = options.get("manifest") or options.get("path")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        files, path = pafs.FileSystem.from_uri(self.manifest)
        shards = pq.read_table(path, filesystem=files, columns=["path", "size"]).sort_by("path")
        ranges = plan_ranges(list(zip(shards["path"].to_pylist(), shards["size"].to_pylist(), strict=True)), self.range_bytes)
        return [ByteRanges(r) for r in ranges] or [ByteRanges([])]

    def read(self, partition):
        rows: list[tuple] = []
        size = 0
        for uri, start, end in partition.ranges:
            files, path = pafs.FileSystem.from_uri(uri)
            open_file = partial(files.open_input_file, path)
            members = retried(partial(members_of, open_file, start, end))
            if not members:
                continue
            # one sequential read of the range; a member that does not check out is read again by its own offset
            with open_file() as stream:
                for m in members:
                    try:
                        media = member_at(stream, m)
                    except (OSError, zlib.error, ValueError, struct.error):
                        media = read_member(open_file, m)
                    payload, n = unwav(media)
                    rows.append((m.filename[3:] if m.filename.startswith("id/") else None, media, n, len(payload), features(payload)))
                    size += len(media)
                    if size >= BATCH_BYTES or len(rows) >= 4096:
                        yield record_batch(rows)
                        rows, size = [], 0
        if rows:
            yield record_batch(rows)


SCHEMA = "doc_id string, media binary, n_bytes long, payload_bytes long, feature string"


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").load(manifest): doc_id, media (the stored file), n_bytes, payload_bytes, feature."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_media(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").load(manifest._sonargrid_path)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = read_media(spark, write_media(docs))
    payload = F.expr(f"substring(media, {HEADER + 1})")
    return stored.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_bytes",
        "payload_bytes",
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(media, -{BLOCK})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
