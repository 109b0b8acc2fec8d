"""What the operators of this package share: lineage cuts in the cluster's shared folder, skew-safe joins, byte columns.

Nothing here collects rows; the only values that reach the driver are counts and file listings.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, fresh_path

__all__ = ["arrow_batches", "ascii_lower", "bytes_of", "clash_free", "cut", "drop_cut", "fresh_path", "give_back", "id_filter", "join_groups", "maybe_in", "slices", "table", "without_ids"]

try:
    LIBC = ctypes.CDLL("libc.so.6")
    LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: large arrays go back to the system when freed
except (OSError, AttributeError):  # another C library: nothing to tune
    LIBC = None

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. Texts without other letters take the fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def clash_free(df: DataFrame, *names: str) -> list[str]:
    """The names given, each with underscores appended until no column of df (case aside) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with one row per key that says how many rows the key has; no task gets a hot key.

    Keys with more than 1/1024 of n_rows (and over 64 rows) are at most 1024: those are broadcast, a bound that holds at any
    input size. All other keys are joined by shuffle, where none can be hot.
    """
    limit = max(64, n_rows // 1024)
    heavy = groups.where(F.col(size) > limit)
    light = groups.where(F.col(size) <= limit)
    (mark,) = clash_free(rows, "heavy_key")
    tagged = rows.join(F.broadcast(heavy.select(F.col(key).alias(mark))), F.col(key) == F.col(mark), "left")
    hot = tagged.where(F.col(mark).isNotNull()).drop(mark).join(F.broadcast(heavy), key, how)
    rest = tagged.where(F.col(mark).isNull()).drop(mark).join(light, key, how)
    return hot.unionByName(rest)


#: Words of 64 bits of a broadcast filter of ids at most.
FILTER_WORDS = 1 << 20


def id_filter(ids: DataFrame, key: str, name: str) -> DataFrame:
    """(word, bits): a filter with a bit for each id, of at most FILTER_WORDS rows at any size of ids."""
    slot = f"pmod(xxhash64(`{key}`), {64 * FILTER_WORDS})"
    return cut(ids.groupBy(F.expr(f"shiftright({slot}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")).alias("bits")), name)


def maybe_in(df: DataFrame, words: DataFrame, key: str, name: str) -> DataFrame:
    """df plus a boolean column: false means that the row's key isn't among the filter's ids."""
    slot = f"pmod(xxhash64(`{key}`), {64 * FILTER_WORDS})"
    word, bits = clash_free(df, "filter_word", "filter_bits")
    side = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    hit = df.join(side, F.expr(f"shiftright({slot}, 6)") == F.col(word), "left")
    return hit.withColumn(name, F.coalesce(F.expr(f"(shiftright(`{bits}`, cast({slot} & 63 as int)) & 1) = 1"), F.lit(False))).drop(word, bits)


def without_ids(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't in gone (key). Only rows that the filter holds for possible shuffle; the others pass straight through."""
    (maybe,) = clash_free(df, "maybe_gone")
    marked = maybe_in(df, id_filter(gone, key, "gone"), key, maybe)
    sure = marked.where(~F.col(maybe)).drop(maybe)
    return sure.unionByName(marked.where(F.col(maybe)).drop(maybe).join(gone.select(key).distinct(), key, "left_anti").select(df.columns))


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:
        sizes = np.diff(offs)
        missing = np.asarray(column.is_null())
        if sizes[missing].any():
            return bytes_of(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives through many stages beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if LIBC:
        LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of the column (one row at least), so that memory is bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = bytes_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
            give_back()


def arrow_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes: long texts make smaller batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
