"""Tar archives as a Spark data source: one partition per archive, members read by offset; and a sharded tar writer."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):
    files, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return files.open_input_file(at)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"

    def partitions(self):
        files, top = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        prefix = self.path[: len(self.path) - len(top)] if "://" in self.path else "file://"
        info = files.get_file_info(top)
        names = [top] if info.is_file else sorted(f.path for f in files.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".tar"))
        return [Archive(prefix + n) for n in names] or [Archive("")]

    def read(self, partition):
        if not partition.path:
            return
        with _open(partition.path) as f, tarfile.open(fileobj=f) as tar:
            for m in tar:
                if m.isfile():
                    data = tar.extractfile(m).read() if self.payload else None
                    yield (partition.path, m.name, m.offset_data, m.size, data)


class TarMembers(DataSource):
    """spark.read.format("tar_members").load(folder or file): archive, member, offset, size, data (null with payload=false: an index)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, offset long, size long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


def read_tar(spark, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("payload", str(payload).lower()).load(path)


def join_manifest(members: DataFrame, manifest: DataFrame, name: str, skip_missing: bool = False) -> DataFrame:
    """Archive members with their manifest rows; a member without one is skipped or raises when read."""
    out = members.join(manifest.withColumnRenamed(name, "member").withColumn("_m", F.lit(True)), "member", "left")
    if skip_missing:
        return out.where("_m").drop("_m")
    return out.withColumn("member", F.when(F.col("_m"), F.col("member")).otherwise(F.raise_error(F.concat(F.lit("no manifest row for "), "member")))).drop("_m")


def pairs_of_members(members: DataFrame, data_suffix: str = ".wav") -> DataFrame:
    """JSON and payload members of one stem together: (archive, sample, json, data)."""
    keyed = members.withColumn("sample", F.regexp_replace("member", r"\.[^.]*$", ""))
    meta = keyed.where(F.col("member").endswith(".json")).select("archive", "sample", F.col("data").cast("string").alias("json"))
    return meta.join(keyed.where(F.col("member").endswith(data_suffix)).select("archive", "sample", "data"), ["archive", "sample"], "left")


def write_tar_shards(df: DataFrame, folder: str, name: str, payload: str, shard_size: int = 1000, suffix: str = ".json") -> DataFrame:
    """Each row's payload as a member of tar shards in folder; returns (path, members) of the shards. Every task writes its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(top, recursive=True)
        tar, n, path = None, 0, ""
        for batch in batches:
            for row in batch.select([name, payload]).to_pylist():
                if tar is None:
                    path = f"{top}/{uuid.uuid4().hex}.tar"
                    sink = files.open_output_stream(path)
                    tar, n = tarfile.open(fileobj=sink, mode="w|"), 0
                value = row[payload]
                data = value if isinstance(value, bytes) else (value if isinstance(value, str) else json.dumps(value)).encode()
                info = tarfile.TarInfo(f"{row[name]}{suffix}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
                if n >= shard_size:
                    tar.close()
                    sink.close()
                    tar = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "members": [n]})
        if tar is not None:
            tar.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "members": [n]})

    return df.select(name, payload).mapInArrow(run, "path string, members long")
