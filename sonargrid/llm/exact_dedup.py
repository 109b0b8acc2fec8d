"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts the 64-bit hashes of the texts, pre-aggregated per task; those of two rows or more are the members of a Bloom filter. Pass 2 probes the
filter with every row: a row that isn't in it has a text of its own and passes straight through, without a shuffle; only the possibly
repeated rows shuffle, are grouped by the SHA-256 of their normalised text and get the group's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, clash_free, cut, drop_cut, join_groups, table

#: Bits of the filter for each repeated hash.
BITS_PER_HASH = 16
#: Words of 64 bits that the broadcast filter has at most; with more repeated hashes than that is made for more rows shuffle, none is lost.
MAX_WORDS = 1 << 20


def digest(text: Column) -> Column:
    """SHA-256, lowercase hex, of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def masks(slot: str) -> str:
    """SQL of the two bits of a hash within its word of the filter."""
    return f"(shiftleft(1L, cast(shiftrightunsigned({slot}, 52) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({slot}, 58) as int)))"


def repeat_filter(slots: DataFrame, max_words: int = MAX_WORDS) -> tuple[DataFrame, int]:
    """((word long, bits long): the words of the filter that have a set bit; words of the filter) for the hashes (slot) that occur in two rows or more."""
    repeated = cut(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot"), "repeated")
    words, wanted = 1, BITS_PER_HASH * repeated.count() // 64
    while words < min(wanted, max_words):
        words *= 2
    out = cut(repeated.groupBy(F.expr(f"slot & {words - 1}").alias("word")).agg(F.bit_or(F.expr(masks("slot"))).alias("bits")), "bloom")
    drop_cut(repeated)
    return out, words


def judged(rows: DataFrame, doc_id: str, sha: str, names: list[str], max_words: int = MAX_WORDS) -> DataFrame:
    """rows plus the columns keep_id, group_size and kept under the names given; sha is the column of digests."""
    keep_id, group_size, kept = names
    slot, word, bits = clash_free(rows, "slot", "word", "bits")
    found, words = repeat_filter(rows.select(F.xxhash64(sha).alias("slot")), max_words)
    side = F.broadcast(found.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # at most max_words rows
    probed = rows.withColumn(slot, F.xxhash64(sha)).join(side, F.expr(f"`{slot}` & {words - 1}") == F.col(word), "left")
    maybe = F.coalesce(F.expr(f"(`{bits}` & {masks(f'`{slot}`')}) = {masks(f'`{slot}`')}"), F.lit(False))
    alone = probed.where(~maybe).select(*rows.columns, F.col(doc_id).alias(keep_id), F.lit(1).cast("long").alias(group_size), F.lit(True).alias(kept))
    again = cut(probed.where(maybe).select(rows.columns), "possibly-repeated")
    groups = again.groupBy(sha).agg(F.max(doc_id).alias(keep_id), F.count(F.lit(1)).alias(group_size))
    verdict = join_groups(again, groups, sha, group_size, again.count()).withColumn(kept, F.col(doc_id).eqNullSafe(F.col(keep_id)))
    return alone.unionByName(verdict.select(alone.columns))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_words: int = MAX_WORDS) -> DataFrame:
    """docs, all columns and rows, plus keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays. Null text counts
    as empty, so all null and empty texts are one group. A null doc_id is smaller than any other; if a group has only null ids, each
    of its rows has a null keep_id and is kept (nothing tells them apart). Rows that repeat a doc_id within a group: all rows with the
    largest id are kept. An empty table gives an empty result. Columns of docs that bear a result's name get the name plus
    underscores in the result's place, so none is overwritten.
    """
    *names, sha = clash_free(docs, "keep_id", "group_size", "kept", "text_sha256")
    return judged(docs.withColumn(sha, digest(F.col(text))), doc_id, sha, names, max_words).select(*docs.columns, *names, sha)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = cut(docs.select("doc_id", digest(F.col("text")).alias("text_sha256")), "digests")  # texts are read and hashed once
    return judged(slim, "doc_id", "text_sha256", ["keep_id", "group_size", "kept"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
