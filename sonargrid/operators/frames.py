"""Frame series: rows (keys, frame, score). Thresholding, smoothing, fusion across channels, conversion to and from intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Keys, filter_intervals, merge, pad


def runs(df: DataFrame, keys: Keys, active: Column) -> DataFrame:
    """Maximal runs of consecutive active frames: (keys, first, last)."""
    rows = df.where(active).withColumn("run", F.col("frame") - F.row_number().over(Window.partitionBy(*keys).orderBy("frame")))
    return rows.groupBy(*keys, "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("run")


def binary_runs(df: DataFrame, keys: Keys, frame_length) -> DataFrame:
    """Runs of label 1 as intervals from the first to the last frame's start."""
    return runs(df, keys, F.col("label") == 1).select(*keys, (F.col("first") * frame_length).alias("start"), (F.col("last") * frame_length).alias("end"))


def hysteresis(df: DataFrame, keys: Keys, onset: float, offset: float, score: str = "score") -> DataFrame:
    """df with state: 1 after a frame above onset while 0, 0 after one below offset while 1.

    A frame maps each state to a next one. With onset below offset a score between them maps both states to the other: such frames toggle.
    The state is that of the last frame that decides it (constant map), turned by the parity of the toggles since.
    """
    s = F.col(score)
    up, down = s > onset, s < offset  # from 0 to 1; from 1 to 0
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    toggle = F.when(up & down, 1).otherwise(0)
    rows = df.withColumn("_t", F.sum(toggle).over(w))
    fixed = F.when(up & ~down, F.lit(1)).when(down & ~up, F.lit(0))
    rows = rows.withColumn("_f", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("v"), F.col("_t").alias("n"))), ignorenulls=True).over(w))
    since = F.col("_t") - F.coalesce(F.col("_f.n"), F.lit(0))
    return rows.withColumn("state", (F.coalesce(F.col("_f.v"), F.lit(0)) + since) % 2).drop("_t", "_f")


def binarize(df: DataFrame, keys: Keys, onset: float = 0.5, offset: float = 0.5, pad_onset=0.0, pad_offset=0.0, frame_length=0.01, score: str = "score") -> DataFrame:
    """Speech intervals by hysteresis, padded and merged. A run ends at the frame that ends it; an open one at the last frame's start."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = hysteresis(df, keys, onset, offset, score).withColumn("stop", F.lead("frame").over(w))
    one = rows.where("state = 1").withColumn("run", F.col("frame") - F.row_number().over(w))
    out = one.groupBy(*keys, "run").agg(F.min("frame").alias("a"), F.max(F.coalesce("stop", "frame")).alias("b"))
    out = out.select(*keys, (F.col("a") * frame_length).alias("start"), (F.col("b") * frame_length).alias("end"))
    out = out.withColumns({"start": F.greatest(F.col("start") - pad_onset, F.lit(0.0)), "end": F.col("end") + pad_offset})
    return merge(out, keys)


def speech_filter(df: DataFrame, keys: Keys, min_on=0, min_off=0, speech_first: bool = True) -> DataFrame:
    """Short speech goes and short pauses are filled, in the order asked for."""
    def fill(x: DataFrame) -> DataFrame:  # pauses strictly shorter than min_off
        w = Window.partitionBy(*keys).orderBy("start", "end")
        new = F.when(F.col("start") - F.lag("end").over(w) < min_off, 0).otherwise(1)
        rows = x.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

    steps = [lambda x: filter_intervals(x, min_on), fill] if speech_first else [fill, lambda x: filter_intervals(x, min_on)]
    out = df.select(*keys, "start", "end")
    for step in steps:
        out = step(out)
    return out


def segment_table(df: DataFrame, keys: Keys, frame_length=0.01, **params) -> DataFrame:
    """Binarised and filtered frames with a duration that counts the last frame."""
    min_on, min_off, first = params.pop("min_on", 0), params.pop("min_off", 0), params.pop("speech_first", True)
    out = speech_filter(binarize(df, keys, frame_length=frame_length, **params), keys, min_on, min_off, first)
    return out.withColumn("duration", F.col("end") - F.col("start") + 0.01)


def common_length(df: DataFrame, keys: Keys, channel: str) -> DataFrame:
    """Frames up to the shortest channel's last one."""
    per = df.groupBy(*keys, channel).agg(F.max("frame").alias("last")).groupBy(*keys).agg(F.min("last").alias("last"))
    return df.join(per, keys).where(F.col("frame") <= F.col("last")).drop("last")


def top_k_mean(df: DataFrame, keys: Keys, channel: str, k: int) -> DataFrame:
    """Mean of each frame's k best channel scores (fewer if there are fewer)."""
    rows = common_length(df, keys, channel)
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)
    out = rows.groupBy(*keys, "frame").agg(best.alias("best"))
    return out.select(*keys, "frame", (F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")).alias("score"))


def weighted_mean(df: DataFrame, weights: DataFrame, keys: Keys, channel: str) -> DataFrame:
    rows = common_length(df, keys, channel).join(weights, [*keys, channel])
    return rows.groupBy(*keys, "frame").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("score"))


def runs_above(df: DataFrame, keys: Keys, threshold, frame_shift, gap=0, min_duration=0) -> DataFrame:
    """Runs of frames at or above threshold as merged intervals; a run's end counts its last frame."""
    out = runs(df, keys, F.col("score") >= threshold).select(*keys, (F.col("first") * frame_shift).alias("start"), ((F.col("last") + 1) * frame_shift).alias("end"))
    return merge(out, keys, gap, min_duration)


def overlap_candidates(df: DataFrame, keys: Keys, channel: str, score_threshold, min_channels: int, min_mean, frame_shift, pad_by=0, gap=0, min_duration=0) -> DataFrame:
    """Regions where at least min_channels channels are active and the mean score is high: runs, padded and merged."""
    per = common_length(df, keys, channel).groupBy(*keys, "frame").agg(F.sum((F.col("score") >= score_threshold).cast("int")).alias("active"), F.avg("score").alias("mean"))
    found = runs(per, keys, (F.col("active") >= min_channels) & (F.col("mean") >= min_mean))
    found = found.select(*keys, (F.col("first") * frame_shift).alias("start"), ((F.col("last") + 1) * frame_shift).alias("end"))
    return merge(pad(found, pad_by, pad_by), keys, gap, min_duration)


def frame_labels(intervals: DataFrame, extents: DataFrame, keys: Keys, frame_length) -> DataFrame:
    """0/1 label of each of ceil(duration / frame_length) frames of a key; a frame is 1 if its start lies in an interval, both ends included.

    Intervals become frame numbers, so the join is on (key, frame), not on a range.
    """
    frames = extents.withColumn("frame", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / frame_length).cast("int") - 1))).where("duration > 0").select(*keys, "frame")
    inside = intervals.where(F.col("end") >= F.col("start")).select(*keys, F.explode(F.sequence(F.ceil(F.col("start") / frame_length).cast("int"), F.floor(F.col("end") / frame_length).cast("int"))).alias("frame")).distinct()
    return frames.join(inside.withColumn("label", F.lit(1)), [*keys, "frame"], "left").select(*keys, "frame", F.coalesce("label", F.lit(0)).alias("label"))


def speaker_matrix(segments: DataFrame, keys: Keys, rate, speakers: list) -> DataFrame:
    """Frames by speakers, 1 where the speaker is active: frame columns round(t * rate), end excluded."""
    rows = segments.select(*keys, "speaker", F.explode(F.sequence(F.round(F.col("start") * rate).cast("int"), F.greatest(F.round(F.col("end") * rate).cast("int") - 1, F.round(F.col("start") * rate).cast("int")))).alias("frame"))
    return rows.groupBy(*keys, "frame").pivot("speaker", speakers).agg(F.max(F.lit(1))).na.fill(0)


def soft_labels(labels: DataFrame, keys: Keys, stride: int) -> DataFrame:
    """Mean label of every stride frames."""
    return labels.groupBy(*keys, F.floor(F.col("frame") / stride).alias("frame")).agg(F.avg("label").alias("label"))


def smooth(df: DataFrame, keys: Keys, window: int, shift: int, method: str = "mean") -> DataFrame:
    """Overlapping windows to frames: frame f takes the mean or median of the scores of all windows that cover it (window w covers w*shift ... w*shift+window-1)."""
    spread = df.select(*keys, "score", F.explode(F.sequence(F.col("frame") * shift, F.col("frame") * shift + window - 1)).alias("target"))
    value = F.avg("score") if method == "mean" else F.percentile("score", 0.5)
    return spread.groupBy(*keys, F.col("target").alias("frame")).agg(value.alias("score"))


def pool_max(df: DataFrame, keys: Keys, ratio: int) -> DataFrame:
    """Labels at a lower rate: the maximum of every ratio frames."""
    return df.groupBy(*keys, F.floor(F.col("frame") / ratio).alias("frame")).agg(F.max("label").alias("label"))


def repeat_frames(df: DataFrame, keys: Keys, times: int) -> DataFrame:
    """Each frame times over."""
    return df.withColumn("frame", F.explode(F.sequence(F.col("frame") * times, F.col("frame") * times + times - 1)))


def scale_thresholds(df: DataFrame, keys: Keys, onset: float, offset: float, scale: str = "absolute") -> DataFrame:
    """(keys, onset, offset): as given, or as a place between the key's extremes ("relative") or nearest-rank 1st and 99th percentiles ("percentile")."""
    if scale == "absolute":
        return df.select(*keys).distinct().withColumns({"onset": F.lit(onset), "offset": F.lit(offset)})
    low, high = (F.min("score"), F.max("score")) if scale == "relative" else (F.expr("percentile_disc(0.01) WITHIN GROUP (ORDER BY score)"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY score)"))
    return df.groupBy(*keys).agg(low.alias("low"), high.alias("high")).select(*keys, *((F.col("low") + (F.col("high") - F.col("low")) * v).alias(n) for n, v in (("onset", onset), ("offset", offset))))


def stream_status(df: DataFrame, keys: Keys, item: str) -> DataFrame:
    """single, start, next or end by whether the neighbours in order are of the same item."""
    w = Window.partitionBy(*keys).orderBy("frame")
    before, after = F.lag(item).over(w).eqNullSafe(F.col(item)), F.lead(item).over(w).eqNullSafe(F.col(item))
    return df.withColumn("status", F.when(before & after, "next").when(before, "end").when(after, "start").otherwise("single"))
