"""The test tables as domain rows: intervals, frames, segments, transcripts. Times are whole microseconds, so results are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (user_id, channel, event_id, start, end): ten minutes per unit of value."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select("user_id", F.col("event_type").alias("channel"), "event_id", us.alias("start"), (us + F.round(F.col("value") * 6e8).cast("long")).alias("end"))


INTERVALS = "iv AS (SELECT user_id, event_type AS channel, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 6e8) AS BIGINT) AS e FROM events)"


def segments(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Reference (odd = 0) or hypothesis (1): intervals of even or odd events, the channel as the speaker."""
    return intervals(spark, sf_dir).where(F.col("event_id") % 2 == odd).select("user_id", F.col("channel").alias("speaker"), "start", "end")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frame scores: (user_id, frame, score), frames by order of time, score 0 ... 1 in hundredths."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("user_id", place.cast("long").alias("frame"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0).alias("score"))


FRAMES = "fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, ((event_id * 37) % 101) / 100.0::DOUBLE AS score FROM events)"


def channel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three channels: (user_id, channel, frame, score)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("channel", (F.col("event_id") % 3).cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id", "channel").orderBy("ts", "event_id")) - 1
    return e.select("user_id", "channel", place.cast("long").alias("frame"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0).alias("score"))


CHANNEL_FRAMES = "cf AS (SELECT user_id, (event_id % 3)::INT AS channel, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) - 1 AS frame, ((event_id * 37) % 101) / 100.0::DOUBLE AS score FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as pairs (pair, reference, hypothesis): the words of a turn and of the next."""
    c = table(spark, sf_dir, "conversations")
    w = F.trim(F.regexp_replace("text", r"[^a-zA-Z]+", " "))
    a = c.where("turn % 2 = 0").select("conv_id", "turn", w.alias("reference"))
    b = c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), w.alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "conv_id", "reference", "hypothesis")


_W = "trim(regexp_replace({0}.text, '[^a-zA-Z]+', ' ', 'g'))"
TURNS = f"tp AS (SELECT a.conv_id * 1000 + a.turn AS pair, a.conv_id, {_W.format('a')} AS reference, {_W.format('b')} AS hypothesis FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)"
