"""Edit-aware token counts.

A document is a segment tree over its pre-token segments (a word and what is attached to it, cut at spaces before anything but white space, where
pre-tokens of byte-level BPE always begin); leaves hold the segments' token counts, inner nodes sums. An edit re-encodes only the segments it touches and
one more on either side, which fixes the boundaries; the touched leaves are overwritten and the sums above them updated. The root is the count.
The leaves can be kept in a column, from segment_counts; then nothing but the edited regions is encoded.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SEAM, Bpe, default_path, load_ranks, loaded, seams
from .shared import arrow_batches, bytes_of, clash_free, slices, table

#: The edits of the query: personal data and secrets make way for a placeholder.
MASKS = [
    (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "[EMAIL]"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "[IP]"),
    (re.compile(r"\+?\d[\d ().-]{7,}\d"), "[PHONE]"),
    (re.compile(r"\b(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{20,}\b"), "[SECRET]"),
]
CANDIDATE = re.compile(r"[@\d]")

Edit = tuple[int, int, str]


class TokenTree:
    """Token counts of one text's segments and their sums."""

    def __init__(self, text: str, segments: list[str], counts: np.ndarray):
        """segments: text cut at its seams; counts: tokens of each."""
        if len(segments) != len(counts):
            raise ValueError("the counts are those of another text")
        self.text, self.segments = text, segments
        self.starts = np.cumsum([0, *map(len, segments)])
        self.leaves = 1 << max(0, (len(segments) - 1).bit_length())
        self.sums = np.zeros(2 * self.leaves, np.int64)
        self.sums[self.leaves : self.leaves + len(segments)] = counts
        half = self.leaves
        while half > 1:  # all sums of a level at once
            self.sums[half // 2 : half] = self.sums[half : 2 * half].reshape(-1, 2).sum(1)
            half //= 2
        self.encoded = 0

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def put(self, first: int, last: int, count: int) -> None:
        """Leaf first gets count, the others up to last nothing; sums above are updated level by level."""
        a, b = self.leaves + first, self.leaves + last
        self.sums[a : b + 1] = 0
        self.sums[a] = count
        while a > 1:
            a, b = a // 2, b // 2
            self.sums[a : b + 1] = self.sums[2 * a : 2 * b + 2].reshape(-1, 2).sum(1)

    def edit(self, edits: list[Edit], bpe: Bpe) -> str:
        """Apply edits (start, end, replacement), in order and disjoint; the text after them."""
        regions: list[list] = []
        for start, end, new in edits:
            first = max(0, int(np.searchsorted(self.starts, start, "right")) - 2)
            last = min(len(self.segments) - 1, int(np.searchsorted(self.starts, max(start, end - 1), "right")))
            if regions and first <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], last)
                regions[-1][2].append((start, end, new))
            else:
                regions.append([first, last, [(start, end, new)]])
        out, at = [], 0
        for first, last, own in regions:
            begin, stop = int(self.starts[first]), int(self.starts[last + 1])
            out.append(self.text[at:begin])
            parts, p = [], begin
            for start, end, new in own:
                parts += [self.text[p:start], new]
                p = end
            region = "".join([*parts, self.text[p:stop]])
            out.append(region)
            at = stop
            self.put(first, last, len(bpe.encode(region)))
            self.encoded += last - first + 1
        return "".join([*out, self.text[at:]])


def cut_segments(text: str) -> list[str]:
    head, *rest = SEAM.split(text)
    return [head, *(" " + x for x in rest)]


def leaves(texts: pa.Array, bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the segments of all texts, as cut_segments has them; n + 1 offsets by text). Each distinct segment is encoded once."""
    data, offs = bytes_of(texts)
    ids, _ = bpe.column(texts)
    found = seams(data, offs)
    number = np.diff(np.searchsorted(found, offs)) + 1
    begins = np.sort(np.concatenate([offs[:-1], found]))
    reach = np.append(0, np.cumsum(bpe.width[ids]))
    return np.diff(np.searchsorted(reach, np.append(begins, offs[-1]))), np.append(0, np.cumsum(number))


def mask_edits(text: str) -> list[Edit]:
    """The edits that mask personal data and secrets, in order, disjoint; of overlapping ones the first kind wins."""
    if not CANDIDATE.search(text):
        return []
    taken: list[Edit] = []
    for pattern, new in MASKS:
        free = []
        starts = [a for a, _, _ in taken]
        for m in pattern.finditer(text):
            i = bisect(starts, m.start())
            if (i == 0 or taken[i - 1][1] <= m.start()) and (i == len(taken) or m.end() <= starts[i]):
                free.append((m.start(), m.end(), new))
        taken = sorted(taken + free)
    return taken


def segment_counts(docs: DataFrame, text: str = "text", path: str | None = None, name: str = "segment_counts") -> DataFrame:
    """docs, all columns and rows, plus the leaves of each text's tree (array<int>, tokens by segment), to be stored with the text.

    A null text has one segment without tokens. A column of docs with that name keeps it; the result's gets underscores.
    """
    arrow_batches(docs.sparkSession)
    path = path or default_path()
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))  # bounded by the vocabulary's file
    (name,) = clash_free(docs, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, ranks)
        for batch in slices(batches, text, 2 << 20):
            counts, edges = leaves(batch.column(place), bpe)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], schema.names)

    return docs.mapInArrow(run, schema)


def counts_after_edits(docs: DataFrame, edits=mask_edits, text: str = "text", doc_id: str = "doc_id", path: str | None = None, counts: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_segments, n_edits, n_reencoded, n_tokens_after, text_after) of every row.

    edits(text) lists disjoint (start, end, replacement) in order. counts: the column that segment_counts made from this text; without it all segments are
    encoded first. n_reencoded: segments encoded again. Null text is empty and has 0 tokens in 1 segment. Repeated rows are counted each; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = path or default_path()
    ranks = spark.sparkContext.broadcast(load_ranks(path))  # bounded by the vocabulary's file
    names = ("n_tokens", "n_segments", "n_edits", "n_reencoded", "n_tokens_after")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in names), T.StructField("text_after", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, ranks)
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            if counts is None:
                tokens, edges = leaves(batch.column("text"), bpe)
            else:
                stored = batch.column("counts")
                tokens, edges = np.asarray(stored.flatten()).astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(stored).to_numpy(zero_copy_only=False))).astype(np.int64)
            sums = np.append(0, np.cumsum(tokens))
            before, segments = np.diff(sums[edges]), np.diff(edges)
            after, again, n_edits, result = before.copy(), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), list(texts)
            for i, t in enumerate(texts):
                todo = edits(t) if t else []
                if todo:
                    tree = TokenTree(t, cut_segments(t), tokens[edges[i] : edges[i + 1]])
                    result[i] = tree.edit(todo, bpe)
                    after[i], again[i], n_edits[i] = tree.total, tree.encoded, len(todo)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, segments, n_edits, again, after)), pa.array(result, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    kept = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.col(counts).alias("counts")] if counts else [])]
    return docs.select(kept).mapInArrow(run, schema)


def op7_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_after_edits(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_after")
