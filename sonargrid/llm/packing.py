"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed number of tokens.

A document of more tokens than a sequence holds is cut from its end into full pieces; only its first piece is shorter. Pieces
are dealt by hash into groups of about GROUP_ROWS documents (fewer, if they are long), and each group is packed best fit decreasing: full pieces fill a
sequence each, and for all others a segment tree over remaining capacities finds the tightest open bin in logarithmic time per document. A group
wastes a few bins' rest at most, which is why the number of groups may grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_path, load_ranks, loaded
from .shared import arrow_batches, slices, table

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 8192
#: Bytes of text whose pieces make a group at most, about.
GROUP_BYTES = 256 << 20


class OpenBins:
    """Open bins by what they can still take: a segment tree of counts over remaining capacities, and the bins themselves at the leaves."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, rest: int, number: int) -> None:
        self.bins[rest].append(number)
        if len(self.bins[rest]) == 1:
            self.count(rest, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity left, number) of the tightest bin that can take size; the bin is taken out."""
        at = self.leaves + size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):  # up, until a right neighbour has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        rest = at - self.leaves
        number = self.bins[rest].pop()
        if not self.bins[rest]:
            self.count(rest, -1)
        return rest, number

    def count(self, rest: int, by: int) -> None:
        at = self.leaves + rest
        while at:
            self.tree[at] += by
            at >>= 1


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each size; sizes are 1 to capacity. Larger ones go first, equal ones in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    opened, tree = int(np.count_nonzero(sizes == capacity)), OpenBins(capacity)
    bins[order[:opened]] = np.arange(opened)  # full ones have a bin each
    for i in order[opened:].tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            rest, number = capacity, opened
            opened += 1
        else:
            rest, number = found
        bins[i], offsets[i] = number, capacity - rest
        if rest > size:
            tree.put(rest - size, number)
    return bins, offsets


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, turn): the token pieces of every document; ids are little-endian unsigned 32-bit. turn tells rows of a batch with one doc_id apart.

    Null text is empty: a document of the closing id alone. Repeated rows are packed as often as they occur. Other columns of docs are
    not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or default_path()
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # the vocabulary: bounded by its file
    key = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("turn", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, ranks)
        for batch in slices(batches, "text", 2 << 20):
            ids, offs = bpe.column(batch.column("text"), END_ID)
            n = np.diff(offs)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            head = n - (count - 1) * capacity  # of the first piece
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            cuts = np.concatenate([offs[row] + start, offs[-1:]]) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            keys = pd.Series(batch.column("doc_id").to_pandas())
            turn = keys.groupby(keys, dropna=False).cumcount().to_numpy()[row]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(turn.astype(np.int32))]
            for at in range(0, len(row), 1024):
                yield pa.RecordBatch.from_arrays([x.slice(at, 1024) for x in out], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, n_docs: int, n_bytes: int = 0, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length, turn, more columns), less turn, plus sequence_id and offset; a sequence's pieces fill it without gaps from 0.

    n_docs, n_bytes: documents and bytes of text, which bound the pieces: shorter than a sequence and full ones.
    """
    groups = max(1, -(-n_docs // group_rows), -(-n_bytes // GROUP_BYTES))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", "turn"), F.lit(groups))).drop("turn")
    schema = T.StructType([*dealt.drop("group").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), capacity)
        number = int(group["group"][0].as_py()) if group.num_rows else 0
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group").applyInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, its pieces in order of offset."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"))


def packed_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    pieces = token_pieces(docs, path=path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return pack(pieces, n, size or 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
