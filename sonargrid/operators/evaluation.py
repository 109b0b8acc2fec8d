"""Evaluation files and presets: regions from token files, no-score zones, mode tables, combined reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .intervals import Keys
from .metrics import DER_MODES, diarization_error, ratio, with_total

# Token types that carry speech, and those whose time isn't scored.
SPEECH_TYPES = ("LEXEME", "NON-LEX", "SPEAKER")
NO_SCORE_TYPES = ("NOSCORE", "NO_RT_METADATA")


def region_of_tokens(tokens: DataFrame, types: tuple[str, ...] = SPEECH_TYPES) -> DataFrame:
    """(file, chnl, start, end): extent of the tokens of the given types (tbeg, tdur)."""
    rows = tokens.where(F.col("type").isin(*types) & F.col("tdur").isNotNull())
    return rows.groupBy("file", "chnl").agg(F.min("tbeg").alias("start"), F.max(F.col("tbeg") + F.col("tdur")).alias("end"))


def excluded_zones(tokens: DataFrame, types: tuple[str, ...] = NO_SCORE_TYPES, most_extension: float = 0.0) -> DataFrame:
    """Zones of the given types, widened into the pauses around them by up to most_extension: a zone ends where speech begins, within that bound."""
    zones = tokens.where(F.col("type").isin(*types)).select("file", "chnl", F.col("tbeg").alias("start"), (F.col("tbeg") + F.col("tdur")).alias("end"))
    if most_extension <= 0:
        return iv.merge(zones, ["file", "chnl"])
    speech = iv.merge(tokens.where(F.col("type").isin(*SPEECH_TYPES)).select("file", "chnl", F.col("tbeg").alias("start"), (F.col("tbeg") + F.col("tdur")).alias("end")), ["file", "chnl"])
    wide = zones.select("file", "chnl", (F.col("start") - most_extension).alias("start"), (F.col("end") + most_extension).alias("end"))
    return iv.merge(zones.unionByName(iv.subtract(wide, speech, ["file", "chnl"])), ["file", "chnl"])


def scored_region(region: DataFrame, zones: DataFrame, keys: Keys) -> DataFrame:
    return iv.subtract(region, zones, keys)


def clamped(region: DataFrame, manifest: DataFrame, keys: Keys) -> DataFrame:
    """Regions within the manifest's extent (offset, duration) of their key; keys it doesn't have stay as they are."""
    low = F.coalesce("offset", F.lit(0.0))
    out = region.join(manifest.select(*keys, "offset", "duration"), keys, "left")
    out = out.withColumns({"start": F.greatest("start", F.when(F.col("duration").isNotNull(), low)), "end": F.least("end", F.when(F.col("duration").isNotNull(), low + F.col("duration")))})
    return out.where("start < end").drop("offset", "duration")


def error_by_mode(reference: DataFrame, hypothesis: DataFrame, keys: Keys, ticks: float = 1.0) -> DataFrame:
    """Diarization error under each preset of collar and overlap: (mode, keys, parts, der). ticks: time units per second."""
    out = None
    for mode, (collar, skip) in DER_MODES.items():
        one = diarization_error(reference, hypothesis, keys, collar * ticks, skip).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def running_error(errors: DataFrame, order: str) -> DataFrame:
    """Per-step error with the running total, average and maximum."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one row per step of one run
    return errors.withColumns({"total": F.sum("der").over(w), "average": F.avg("der").over(w), "worst": F.max("der").over(w)})


def report(der: DataFrame, words: DataFrame, session: str) -> DataFrame:
    """Diarization and word errors side by side per session and TOTAL; parts (scored, wrong) and (n_ref, errors)."""
    both = der.join(words, session, "full").na.fill(0)
    sums = with_total(both, [session], *(F.sum(c).alias(c) for c in ("scored", "wrong", "n_ref", "errors")))
    return sums.withColumns({"der": ratio(F.col("wrong"), F.col("scored"), None), "wer": ratio(F.col("errors"), F.col("n_ref"), None)})


def speaker_count_accuracy(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("sessions"))


def type_confusion(mapped: DataFrame) -> DataFrame:
    """Counts of reference by hypothesis speaker types; null where a speaker has no partner."""
    return mapped.groupBy("ref_type", "hyp_type").agg(F.count(F.lit(1)).alias("n"))
