"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Along a fixed order of the source's
documents these expectations are prefix-summed, one random offset is added, and a document is emitted once for every integer boundary
that its stretch of the sum crosses. The order is by size class, so the copies are spread evenly over short and long documents
and the words taken come near the target.

The prefix sum is distributed: a document's place is its rank inside a (source, size class, salt) bucket plus the rows of all
buckets before it. A source of n rows has about sqrt(n) / 16 salts, so neither a bucket nor a source's list of buckets is ever large. All this is
computed on slim rows; the documents are shuffled once, when they get their copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import clash_free, cut, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
#: Sources whose numbers are broadcast; more are joined by shuffle.
FEW_SOURCES = 65_536


def targets(totals: DataFrame, source: str, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """totals (source, n_docs, source_size) plus weight and target: share of all words dealt by weight, each at most max_epochs times its size.

    One row per source; the windows below run over sources, never over documents. Water filling in closed form: with sources in
    order of cap / weight, the first whose cap is above what the level would give it ends the capped ones.
    """
    by_name, by_cap = Window.orderBy(F.col(source).asc_nulls_last()), Window.orderBy("cap_level", F.col(source).asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    out = out.withColumns({"cap": (F.col("source_size") * max_epochs).cast("double"), "cap_level": F.col("source_size") * max_epochs / F.col("weight")})
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weight_left)
    out = out.withColumn("place", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("level") < F.col("cap_level"), F.struct("place", "level")))
    out = out.withColumn("water", first.over(everything)["level"])
    # every capped source has cap_level <= water; where all are capped there is no water
    out = out.withColumn("target", F.when(F.col("water").isNull() | (F.col("cap_level") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight")))
    return out.drop("cap", "cap_level", "level", "place", "water")


def not_null(c: Column) -> Column:
    """A string that tells all values and null apart."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, share: float = 1.0) -> DataFrame:
    """docs, all columns and rows, plus size, source_size, target and copies: how often the mix emits the document (0 to 3).

    emit() turns that into the mixed corpus. Sources weigh 1, 2, 3, repeating, in order of code point, null last (a null source is a
    source of its own). Null and empty texts have size 0; a source without words has target 0 and emits nothing. Ties of size and id
    are broken by the hash of the text, then of the whole row (maps aside); rows equal in all of these are interchangeable. The same rows give the same copies,
    however they are partitioned. An empty table gives an empty result. Columns of docs that bear a result's name keep it; the result's name gets underscores.
    """
    size, source_size, target, copies, tie, key_src, key_id, turn = clash_free(docs, "size", "source_size", "target", "copies", "tie", "key_src", "key_id", "turn")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.withColumns({tie: F.concat(F.md5(F.coalesce(F.col(text), F.lit(""))), F.hex(F.xxhash64(*plain))), key_src: not_null(F.col(source)), key_id: not_null(F.col(doc_id))})
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = cut(rows.select(F.col(source).alias("src"), F.col(doc_id).alias("did"), F.col(tie).alias("tie"), words.alias("size")), "sizes")
    plan = targets(slim.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "src", share)
    plan = plan.select(
        F.col("src").alias("p_src"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_docs").cast("double")) / 16)).alias("salts"),
    )
    plan = cut(plan, "sources")
    length = F.length(F.bin("size"))
    side = F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan
    drawn = slim.join(side, F.col("src").eqNullSafe(F.col("p_src"))).drop("p_src")
    drawn = drawn.withColumns({
        "class": F.when(length > 4, F.expr("shiftright(size, length(bin(size)) - 4)") + 8 * (length - 4)).otherwise(F.col("size")),
        "salt": F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("did").cast("string"), F.col("tie"))), 1, 8), 16, 10).cast("long"), F.col("salts")),
    })
    buckets = drawn.groupBy("src", "class", "salt").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("src").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("src").alias("b_src"), F.col("class").alias("b_class"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "class", "salt").orderBy("size", F.col("did").asc_nulls_first(), "tie")
    placed = drawn.withColumn("rank", F.row_number().over(inside))
    placed = placed.join(buckets, F.col("src").eqNullSafe(F.col("b_src")) & (F.col("class") == F.col("b_class")) & (F.col("salt") == F.col("b_salt")))
    i, whole = F.col("before") + F.col("rank"), F.floor("rate")
    part = F.col("rate") - whole
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("src", F.lit("")))), 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24))
    crossed = F.floor(i * part + offset) - F.floor((i - 1) * part + offset)
    decided = placed.select("src", "did", "tie", "size", "source_size", "target", (whole + F.least(crossed, F.lit(1))).alias("copies"))
    # back to the documents: one shuffle of them; rows that repeat a document take its numbers of copies in turn
    keys = [key_src, key_id, tie]
    verdict = decided.groupBy(not_null(F.col("src")).alias(key_src), not_null(F.col("did")).alias(key_id), F.col("tie").alias(tie)).agg(
        F.first("size").alias(size), F.first("source_size").alias(source_size), F.first("target").alias(target), F.sort_array(F.collect_list("copies")).alias("each")
    )
    back = rows.join(verdict, keys).withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    back = back.withColumn(copies, F.element_at("each", F.col(turn)))
    return back.select(*docs.columns, size, source_size, target, copies)


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row once per copy; copy_no counts from 0."""
    (copy_no,) = clash_free(mixed, "copy_no")
    return mixed.where(F.col(copies) > 0).withColumn(copy_no, F.explode(F.sequence(F.lit(0), (F.col(copies) - 1).cast("int"))))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, weight, n, 3.0::DOUBLE * source_size AS cap, false AS full_, (sum(source_size) OVER ())::DOUBLE * weight / sum(weight) OVER () AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, n, cap, full_ OR target >= cap,
    CASE WHEN full_ OR target >= cap THEN cap ELSE
      ((sum(source_size) OVER ())::DOUBLE - sum(CASE WHEN full_ OR target >= cap THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN full_ OR target >= cap THEN 0 ELSE weight END) OVER () * weight END
  FROM fill WHERE round < 40),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, greatest(1, ceil(sqrt(n::DOUBLE) / 16))::BIGINT AS salts,
    ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u FROM fill WHERE round = 40),
o AS (SELECT d.doc_id, d.size, p.*, row_number() OVER (PARTITION BY d.source ORDER BY
      CASE WHEN len(bin(size)) > 4 THEN (size >> (len(bin(size)) - 4)::BIGINT) + 8 * (len(bin(size)) - 4) ELSE size END,
      ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % salts, size, doc_id, md5(coalesce(text, ''))) AS i
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, (floor(rate) + least(1, floor(i * (rate - floor(rate)) + u) - floor((i - 1) * (rate - floor(rate)) + u)))::BIGINT AS copies FROM o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
