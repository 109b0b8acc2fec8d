"""End-to-end plans: channel fusion to scored diarization, threshold tuning, and preparation of a training set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import constraint
from ..operators import frames as fr
from ..operators import intervals as iv
from ..operators import metrics as me
from ..operators import sampling as sa
from ..operators import vectors as ve


def diarize(channels: DataFrame, embeddings: DataFrame, reference: DataFrame, keys: list[str], width, threshold: int = 2, gap=0, **clustering) -> dict[str, DataFrame]:
    """Speech by channel vote, speakers by clustering the embeddings of segments (keys, item, start, end, vector) inside speech, and the error against a reference."""
    speech = iv.vote_pad_merge(channels, keys, threshold, gap=gap)
    from ..operators.joins import range_join

    (session,) = keys
    voiced = range_join(embeddings, speech, keys, width).select(session, F.col("item_l").alias("item"), "o_start", "o_end").groupBy(session, "item").agg(F.min("o_start").alias("start"), F.max("o_end").alias("end"))
    labels = ve.cluster_sessions(embeddings.join(voiced.select(session, "item"), [session, "item"]), session, "item", "vector", **clustering)
    hypothesis = voiced.join(labels, [session, "item"]).select(session, F.concat(F.lit("speaker_"), "cluster").alias("speaker"), "start", "end")
    hypothesis = iv.merge(hypothesis, [session, "speaker"])
    return {"speech": speech, "hypothesis": hypothesis, "error": me.diarization_error(reference, hypothesis, keys)}


def tune_thresholds(scores: DataFrame, reference: DataFrame, region: DataFrame, keys: list[str], onsets: list[float], offsets: list[float], frame_length: float) -> DataFrame:
    """(onset, offset, error_rate) of every setting; settings are a column, so all are evaluated in one plan."""
    grid = scores.sparkSession.createDataFrame([(a, b) for a in onsets for b in offsets], "onset double, offset double")
    settings = ["onset", "offset"]
    spread = scores.crossJoin(F.broadcast(grid))  # a list of settings
    up = F.col("score") > F.col("onset")
    labelled = spread.withColumn("label", up.cast("int"))
    found = fr.runs(labelled, [*keys, *settings], F.col("label") == 1).select(*keys, *settings, (F.col("first") * frame_length).alias("start"), ((F.col("last") + 1) * frame_length).alias("end"))
    ref, reg = (d.crossJoin(F.broadcast(grid)) for d in (reference, region))
    one = lambda d: iv.merge(d, [*keys, *settings]).withColumn("speaker", F.lit("s"))
    pieces = iv.atomic_timeline(reg, one(ref), one(found), [*keys, *settings]).withColumn("d", F.col("end") - F.col("start"))
    sums = pieces.groupBy(*settings).agg(F.sum(F.when(F.col("n_ref") != F.col("n_hyp"), F.col("d")).otherwise(0)).alias("wrong"), F.sum(F.when(F.col("n_ref") > 0, F.col("d")).otherwise(0)).alias("scored"))
    return sums.select(*settings, me.ratio(F.col("wrong"), F.col("scored"), None).alias("error_rate"))


def prepare(rows: DataFrame, key: str, duration: str, low: float, high: float, edges: list[float], batch: int, rule: str | None = None, seed: int = 0) -> DataFrame:
    """Rows filtered by duration and rule, bucketed, shuffled by hash and batched: (columns, bucket, batch)."""
    kept = rows.where((F.col(duration) >= low) & (F.col(duration) <= high))
    if rule:
        kept = kept.where(constraint(rule))
    kept = kept.withColumn("bucket", sa.bucket(F.col(duration), edges)).where("bucket IS NOT NULL")
    return sa.fixed_batches(kept, ["bucket"], batch, F.xxhash64(key, F.lit(seed)), F.col(key))
