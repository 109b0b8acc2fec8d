"""Transcripts and conversations as rows: words, segments, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Keys, islands


def ordered_text(word: str | Column, *order: str, separator: str = " ") -> Column:
    """Aggregate: words joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(word).alias("_w") if isinstance(word, str) else word.alias("_w")))), lambda x: x["_w"]), separator)


def texts_by_speaker(words: DataFrame, keys: Keys, speaker: str = "speaker") -> DataFrame:
    """Words (start, end, word) to one text per speaker."""
    return words.groupBy(*keys, speaker).agg(ordered_text("word", "start", "end").alias("text"))


def mixed_text(words: DataFrame, keys: Keys) -> DataFrame:
    return words.groupBy(*keys).agg(ordered_text("word", "start", "end").alias("text"))


def stitched_segments(segments: DataFrame, file: str, order: str) -> DataFrame:
    """Consecutive rows of one file joined: (run, file, text, intervals). Rows of a file that come back later are a run of their own."""
    w = Window.partitionBy(F.lit(1)).orderBy(order) if "shard" not in segments.columns else Window.partitionBy("shard").orderBy(order)
    keys = ["shard"] if "shard" in segments.columns else []
    new = ~F.lag(file).over(w).eqNullSafe(F.col(file))
    rows = segments.withColumn("_n", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run", file).agg(ordered_text("text", order).alias("text"), F.transform(F.sort_array(F.collect_list(F.struct(order, "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("intervals"))


def words_of_characters(chars: DataFrame, keys: Keys, delimiter: str = " ") -> DataFrame:
    """Characters (pos, char, start, end) to words between delimiters: (word_id, word, start, end)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = chars.withColumn("word_id", F.sum(F.when(F.col("char") == delimiter, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("char") != delimiter)
    out = rows.groupBy(*keys, "word_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("word"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.where(F.col("word") != "")


def shifted_chunks(tokens: DataFrame, keys: Keys, chunk: str, length: str) -> DataFrame:
    """Token times (start, end) of consecutive chunks on one axis: shifted by the lengths of the chunks before."""
    per = tokens.select(*keys, chunk, length).distinct()
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(*keys, chunk, before.alias("_o"))
    return tokens.join(offsets, [*keys, chunk]).withColumns({"start": F.when(F.col("start") >= 0, F.col("start") + F.col("_o")).otherwise(F.col("start")), "end": F.when(F.col("end") >= 0, F.col("end") + F.col("_o")).otherwise(F.col("end"))}).drop("_o")


def never_back(tokens: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Times that go back are raised to the largest end before; -1 stays undefined. A running maximum gives what the step by step rule gives."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.greatest("start", "end")).over(w), F.lit(0))
    rows = tokens.withColumn("_r", reach)
    rows = rows.withColumn("start", F.when(F.col("start") >= 0, F.greatest("start", "_r")).otherwise(F.col("start")))
    return rows.withColumn("end", F.when(F.col("end") >= 0, F.greatest("end", "_r", "start")).otherwise(F.col("end"))).drop("_r")


def merged_runs(hypotheses: DataFrame, item: str, order: str, shard: str) -> DataFrame:
    """Consecutive rows (within a shard) of one item joined; an item that comes back is a new run."""
    w = Window.partitionBy(shard).orderBy(order)
    rows = islands(hypotheses, [shard], ~F.lag(item).over(w).eqNullSafe(F.col(item)), order, name="run")
    return rows.groupBy(shard, "run", item).agg(ordered_text("text", order).alias("text"), F.count(F.lit(1)).alias("n"))


def whole_conversations(turns: DataFrame, conversation: str, loaded: Column) -> DataFrame:
    """Turns of the conversations all of whose turns loaded."""
    bad = turns.where(~F.coalesce(loaded, F.lit(False))).select(conversation).distinct()
    return turns.join(bad, conversation, "left_anti")


def duplex_turns(agent: DataFrame, user: DataFrame, keys: Keys, earlier: float = 0.0, drop_agent_first: bool = False) -> DataFrame:
    """Agent and user segments (start, end, text) in one order, agents' starts moved earlier; sessions that an agent opens may go."""
    a = agent.withColumns({"role": F.lit("agent"), "start": F.greatest(F.col("start") - earlier, F.lit(0.0))})
    rows = a.unionByName(user.withColumn("role", F.lit("user")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "role")))
    if drop_agent_first:
        rows = rows.join(rows.where("place = 1 AND role = 'agent'").select(*keys), keys, "left_anti")
    return rows


def role_turns(supervisions: DataFrame, keys: Keys, inputs: list[str], outputs: list[str]) -> DataFrame:
    """Supervisions (start, speaker, text) to turns (place, role, text): user for input speakers, assistant for output ones; a session with another speaker is marked failed."""
    role = F.when(F.lower("speaker").isin(*inputs), "user").when(F.lower("speaker").isin(*outputs), "assistant")
    rows = supervisions.withColumn("role", role).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "speaker")))
    return rows.withColumn("failed", F.max(F.col("role").isNull()).over(Window.partitionBy(*keys)))


def last_good(items: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    """Missing values replaced by the last one before that loaded."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn(value, F.last(value, ignorenulls=True).over(w))


def side_text(df: DataFrame, key: str, side: DataFrame, n_side: int, seed: int = 0) -> DataFrame:
    """df plus a text drawn from side (pos 0 ... n_side - 1, text) by the row's hash."""
    return df.withColumn("pos", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_side))).join(side.withColumnRenamed("text", "side_text"), "pos").drop("pos")


def local_speakers(segments: DataFrame, keys: Keys) -> DataFrame:
    """segments plus local_speaker: speakers numbered by first appearance in the key."""
    first = segments.groupBy(*keys, "speaker").agg(F.min(F.struct("start", "end")).alias("_f"))
    ranked = first.withColumn("local_speaker", F.row_number().over(Window.partitionBy(*keys).orderBy("_f", "speaker")) - 1).drop("_f")
    return segments.join(ranked, [*keys, "speaker"])


def in_window(segments: DataFrame, windows: DataFrame, keys: Keys, tolerance: float = 0.0, adjust: bool = True) -> DataFrame:
    """Segments that overlap their key's window (low, high) by more than the tolerance allows, on the window's own axis if adjusted."""
    rows = segments.join(windows, keys).where((F.col("start") < F.col("high") - tolerance) & (F.col("end") > F.col("low") + tolerance))
    return rows.withColumns({"start": F.col("start") - F.col("low"), "end": F.col("end") - F.col("low")}).drop("low", "high") if adjust else rows.drop("low", "high")


def speaker_pairs(segments: DataFrame, keys: Keys) -> DataFrame:
    """All pairs of a session's speakers (by sorted place); the pair (0, 1) for sessions of up to two."""
    n = segments.groupBy(*keys).agg(F.countDistinct("speaker").alias("n"))
    i = n.withColumn("a", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 2, F.lit(0)).cast("int"))))
    return i.withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.greatest(F.col("n") - 1, F.lit(1)).cast("int")))).drop("n")


def permuted(activity: DataFrame, frequency: DataFrame, session: str) -> DataFrame:
    """(session, speaker, slot): the order of activity's speakers whose shares fit the transcript's slots best (least L1 cost, by assignment)."""
    from .joins import assign

    pairs = activity.join(frequency, session).withColumn("fit", 2.0 - F.abs(F.col("share") - F.col("slot_share")))
    return assign(pairs, [session], "speaker", "slot", "fit").drop("fit")


METRICS: dict[str, object] = {}


def metric(name: str):
    """Register a function (df, reference, hypothesis) -> DataFrame under a metric's name."""
    def keep(f):
        METRICS[name] = f
        return f

    return keep


@metric("wer")
def _wer(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    from .metrics import error_counts, pooled_rate

    return pooled_rate(error_counts(df, reference, hypothesis))


@metric("cer")
def _cer(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    from .metrics import error_counts, pooled_rate

    return pooled_rate(error_counts(df, reference, hypothesis, by_character=True))


def evaluate(df: DataFrame, name: str, reference: str, hypothesis: str) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"no such metric: {name}; there are {sorted(METRICS)}")
    return METRICS[name](df, reference, hypothesis)


