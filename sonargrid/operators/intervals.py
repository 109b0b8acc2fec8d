"""Interval algebra over rows with key columns, start and end.

All operators are windows, aggregates and equi joins on the keys; none gathers a key's rows in Python. Times may be of any numeric type;
whole ticks make results exact. Rows without start or end are dropped by the operators that order or sum times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _ends_before(keys: Keys, *order: str) -> Column:
    """The largest end of all earlier rows of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.max("end").over(w)


def filter_intervals(df: DataFrame, min_duration) -> DataFrame:
    """Intervals of at least min_duration; 0 or less keeps all."""
    return df.where(F.col("end") - F.col("start") >= min_duration) if min_duration > 0 else df


def pad(df: DataFrame, onset, offset) -> DataFrame:
    """Starts earlier by onset (not below 0), ends later by offset; unchanged if both are 0 or less."""
    if onset <= 0 and offset <= 0:
        return df
    return df.withColumns({"start": F.greatest(F.col("start") - onset, F.lit(0)), "end": F.col("end") + offset})


def merge(df: DataFrame, keys: Keys, gap=0, min_duration=0) -> DataFrame:
    """Union per key: intervals at most gap apart (inclusive) become one, then short ones go. Empty and inverted intervals go first."""
    rows = df.where(F.col("end") > F.col("start")).select(*keys, "start", "end")
    new = F.when(F.col("start") <= _ends_before(keys, "start", "end") + gap, 0).otherwise(1)
    island = F.sum("new").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("new", new).withColumn("island", island)
    out = out.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    return filter_intervals(out, min_duration)


def merge_neighbours(df: DataFrame, keys: Keys) -> DataFrame:
    """Union that looks at the previous row's own end only, as some tools do: nested intervals lose their tail. Prefer merge()."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.when(F.col("start") <= F.lag("end").over(w), 0).otherwise(1)
    rows = df.select(*keys, "start", "end").withColumn("new", new)
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("island")


def merge_scaled(df: DataFrame, keys: Keys, decimals: int = 5, margin: int = 2) -> DataFrame:
    """Union of float intervals on a grid of 10^-decimals; starts move by margin ticks, so margin 2 keeps touching intervals apart and drops very short ones."""
    scale = 10**decimals
    ticks = df.select(*keys, (F.bround(F.col("start") * scale) + margin).cast("long").alias("start"), F.bround(F.col("end") * scale).cast("long").alias("end"))
    out = merge(ticks, keys)
    return out.withColumns({"start": F.round((F.col("start") - margin) / scale, decimals), "end": F.round(F.col("end") / scale, decimals)})


def sweep(df: DataFrame, keys: Keys, weight: Column | None = None) -> DataFrame:
    """Atomic pieces (keys, start, end, level) between consecutive cut points; level sums the weights (1 each) of the intervals that cover the piece."""
    weight = F.lit(1) if weight is None else weight
    edges = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), weight.alias("w")), F.struct(F.col("end").alias("t"), (-weight).alias("w")))).alias("e"))
    # dealt by key once: the sums per time, the running level and a merge behind it need no further shuffle
    points = edges.repartition(*keys).groupBy(*keys, F.col("e.t").alias("start")).agg(F.sum("e.w").alias("step"))
    w = Window.partitionBy(*keys).orderBy("start")
    pieces = points.withColumn("level", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("start").over(w))
    return pieces.where("end IS NOT NULL").select(*keys, "start", "end", "level")


def vote(df: DataFrame, keys: Keys, threshold) -> DataFrame:
    """Pieces that at least threshold of the key's intervals cover. Adjacent pieces stay separate."""
    return sweep(df, keys).where(F.col("level") >= threshold).drop("level")


def weighted_vote(df: DataFrame, weights: DataFrame, keys: Keys, channel: str, threshold, fraction: bool = False) -> DataFrame:
    """Pieces whose channels' weights sum to threshold or more, or to that fraction of the key's total weight. Channels of weight 0 don't count.

    weights: (keys, channel, weight); a channel without one is an error for the caller to check, here it has no vote.
    """
    joined = df.join(weights.where("weight > 0"), [*keys, channel])
    pieces = sweep(joined, keys, F.col("weight"))
    if not fraction:
        return pieces.where(F.col("level") >= threshold).drop("level")
    total = weights.where("weight > 0").groupBy(*keys).agg(F.sum("weight").alias("total"))
    return pieces.join(total, keys).where(F.col("level") >= F.col("total") * threshold).drop("level", "total")


def vote_pad_merge(df: DataFrame, keys: Keys, threshold, min_duration=0, onset=0, offset=0, gap=0) -> DataFrame:
    """Fusion of channels: vote, drop short pieces, pad, merge by gap, drop short results - in this order."""
    return merge(pad(filter_intervals(vote(df, keys, threshold), min_duration), onset, offset), keys, gap, min_duration)


def gaps(df: DataFrame, keys: Keys) -> DataFrame:
    """The stretches between consecutive intervals of a key, which are disjoint."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return df.select(*keys, F.col("end").alias("start"), nxt.alias("end")).where("end IS NOT NULL")


def complement(df: DataFrame, keys: Keys, until: DataFrame | None = None) -> DataFrame:
    """What the key's merged intervals leave free from 0 on; with until (keys, duration) also after the last one."""
    merged = merge(df, keys)
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("start")), F.lit(0))
    out = merged.select(*keys, before.alias("a"), F.col("start").alias("end")).withColumnRenamed("a", "start")
    if until is not None:
        last = until.join(merged.groupBy(*keys).agg(F.max("end").alias("last")), keys, "left")
        out = out.unionByName(last.select(*keys, F.coalesce("last", F.lit(0)).alias("start"), F.col("duration").alias("end")))
    return out.where(F.col("start") < F.col("end"))


def remove_exact(df: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    """Intervals without those that occur in gone with the same start and end."""
    return df.join(gone.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


def running_overlaps(df: DataFrame, keys: Keys) -> DataFrame:
    """The stretch that each interval shares with those before it."""
    rows = df.withColumn("reach", _ends_before(keys, "start", "end")).where(F.col("start") < F.col("reach"))
    return rows.select(*keys, "start", F.least("end", "reach").alias("stop")).withColumnRenamed("stop", "end")


def overlap_regions(df: DataFrame, keys: Keys, level: int = 2) -> DataFrame:
    """Merged regions that at least level intervals cover."""
    return merge(vote(df.where(F.col("end") > F.col("start")), keys, level), keys)


def subtract(df: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    """df's union minus gone's union, per key."""
    a = merge(df, keys).withColumn("w", F.lit(1))
    b = merge(gone, keys).withColumn("w", F.lit(-2))
    return merge(sweep(a.unionByName(b), keys, F.col("w")).where("level = 1"), keys)


def boundaries(df: DataFrame, keys: Keys) -> DataFrame:
    """All starts and ends as rows (keys, t)."""
    return df.select(*keys, F.explode(F.array("start", "end")).alias("t"))


def switches(df: DataFrame, keys: Keys, speaker: str = "speaker") -> DataFrame:
    """Start times at which the speaker differs from that of the interval before."""
    w = Window.partitionBy(*keys).orderBy("start", "end", speaker)
    return df.withColumn("before", F.lag(speaker).over(w)).where(F.col("before") != F.col(speaker)).select(*keys, F.col("start").alias("t"))


def total_duration(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0))).alias("duration"))


def extent(df: DataFrame, keys: Keys) -> DataFrame:
    """First start and last end of each key."""
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def clip(df: DataFrame, bounds: DataFrame, keys: Keys) -> DataFrame:
    """Intervals cut to the key's bounds (keys, low, high); what lies outside goes, as do keys without bounds."""
    out = df.join(bounds, keys).withColumns({"start": F.greatest("start", "low"), "end": F.least("end", "high")})
    return out.where(F.col("start") < F.col("end")).drop("low", "high")


def clip_to_last(reference: DataFrame, hypothesis: DataFrame, keys: Keys) -> DataFrame:
    """Reference intervals that start before the key's last hypothesis end, cut there."""
    last = hypothesis.groupBy(*keys).agg(F.max("end").alias("last"))
    return reference.join(last, keys).where(F.col("start") < F.col("last")).withColumn("end", F.least("end", "last")).drop("last")


def collars(reference: DataFrame, keys: Keys, collar) -> DataFrame:
    """Zones of half-width collar around each reference boundary."""
    return boundaries(reference, keys).select(*keys, (F.col("t") - collar).alias("start"), (F.col("t") + collar).alias("end"))


def evaluation_region(region: DataFrame, reference: DataFrame, keys: Keys, collar=0, skip_overlap: bool = False) -> DataFrame:
    """region without collars and, if asked, without the regions of two reference speakers or more."""
    out = region
    if collar > 0:
        out = subtract(out, collars(reference, keys, collar), keys)
    if skip_overlap:
        out = subtract(out, overlap_regions(reference, keys), keys)
    return merge(out, keys)


def sliding_windows(df: DataFrame, window, shift, min_duration=0) -> DataFrame:
    """Each row (start, end) as windows (w_start, w_duration), shift apart; the last reaches the end. Windows of min_duration or less go."""
    length = F.col("end") - F.col("start")
    n = F.greatest(F.ceil((length - window) / F.lit(float(shift))).cast("int"), F.lit(0)) + 1
    out = df.where(length > 0).withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumn("w_start", F.col("start") + F.col("index").cast("long") * shift)
    out = out.withColumn("w_duration", F.least(F.lit(window), F.col("end") - F.col("w_start")))
    return out.where(F.col("w_duration") > min_duration)


def tiles(df: DataFrame, size, hop, min_length=0) -> DataFrame:
    """Fixed chunks of a session (duration column): (chunk, start, end), hop apart, the last cut at the duration."""
    n = F.greatest(F.ceil(F.col("duration") / F.lit(float(hop))).cast("int"), F.lit(1))
    out = df.where("duration > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    out = out.withColumns({"start": F.col("chunk").cast("long") * hop, "end": F.least(F.col("chunk").cast("long") * hop + size, F.col("duration"))})
    return out.where(F.col("end") - F.col("start") > min_length)


def tumbling_split(df: DataFrame, size, words: str | None = None) -> DataFrame:
    """Intervals cut at multiples of size. The first piece keeps the words; an end on a boundary adds a piece of length 0."""
    first, last = F.floor(F.col("start") / size), F.floor(F.col("end") / size)
    out = df.withColumns({"first": first, "chunk": F.explode(F.sequence(first, last))})
    out = out.withColumns({"start": F.greatest(F.col("start"), F.col("chunk") * size), "end": F.least(F.col("end"), (F.col("chunk") + 1) * size)})
    if words:
        out = out.withColumn(words, F.when(F.col("chunk") == F.col("first"), F.col(words)).otherwise(F.lit("")))
    return out.drop("first")


def group_windows(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    """Every n windows as one row, from the first one's start to the end of the first of the next n; the last group is not written."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    rows = df.withColumn("place", F.row_number().over(w) - 1)
    heads = rows.where(F.col("place") % n == 0)
    return heads.withColumn("until", F.lead("end").over(w)).where("until IS NOT NULL").select(*keys, "start", F.col("until").alias("end"))


def contiguous(df: DataFrame, keys: Keys) -> DataFrame:
    """Overlap of neighbours resolved at its middle, on both sides."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    start = F.when(before > F.col("start"), (before + F.col("start")) / 2.0).otherwise(F.col("start"))
    end = F.when(F.col("end") > after, (F.col("end") + after) / 2.0).otherwise(F.col("end"))
    return df.withColumns({"new_start": start, "new_end": end}).drop("start", "end").withColumnsRenamed({"new_start": "start", "new_end": "end"})


def merge_turns(df: DataFrame, keys: Keys, speaker: str = "speaker") -> DataFrame:
    """Consecutive turns of one speaker that touch exactly become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end", speaker)
    new = F.when((F.lag(speaker).over(w) == F.col(speaker)) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    rows = df.withColumn("new", new).withColumn("turn", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "turn", speaker).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("turn")


def islands(df: DataFrame, keys: Keys, boundary: Column, *order: str, name: str = "island") -> DataFrame:
    """df with a group number that rises at every row where boundary (may use lag over the same order) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.when(boundary, 1).otherwise(0)).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def turns_of_words(words: DataFrame, keys: Keys) -> DataFrame:
    """Words (start, end, speaker, word) to one sentence per run of a speaker."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    rows = islands(words, keys, ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)), "start", "end", name="turn")
    return rows.groupBy(*keys, "turn", "speaker").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "word"))), lambda x: x["word"]), " ").alias("text")
    )


def segments_of_words(words: DataFrame, keys: Keys, gap=None, delimiters: tuple[str, ...] = (".", "?", "!")) -> DataFrame:
    """Words to segments that end after a word closed by a delimiter or before a silence of gap or more."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    last = F.lag("word").over(w)
    new = F.coalesce(F.substring(last, -1, 1).isin(*delimiters), F.lit(True))
    if gap is not None:
        new = new | (F.col("start") - F.lag("end").over(w) >= gap)
    rows = islands(words, keys, new, "start", "end", name="segment")
    return rows.groupBy(*keys, "segment").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "word"))), lambda x: x["word"]), " ").alias("text")
    )


def atomic_timeline(region: DataFrame, reference: DataFrame, hypothesis: DataFrame, keys: Keys) -> DataFrame:
    """Pieces of the evaluation region between all cut points, with the number of reference and hypothesis speakers active in each.

    A speaker's own overlapping intervals count once.
    """
    tagged = [
        merge(region, keys).withColumns({"r": F.lit(0), "h": F.lit(0), "u": F.lit(1)}),
        merge(reference, [*keys, "speaker"]).withColumns({"r": F.lit(1), "h": F.lit(0), "u": F.lit(0)}).drop("speaker"),
        merge(hypothesis, [*keys, "speaker"]).withColumns({"r": F.lit(0), "h": F.lit(1), "u": F.lit(0)}).drop("speaker"),
    ]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    edge = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("s")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("s")))
    edges = rows.select(*keys, "r", "h", "u", F.explode(edge).alias("e"))
    points = edges.repartition(*keys).groupBy(*keys, F.col("e.t").alias("start")).agg(*(F.sum(F.col(c) * F.col("e.s")).alias(c) for c in ("r", "h", "u")))
    w = Window.partitionBy(*keys).orderBy("start")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = points.select(*keys, "start", F.lead("start").over(w).alias("end"), *(F.sum(c).over(run).alias(n) for c, n in (("r", "n_ref"), ("h", "n_hyp"), ("u", "inside"))))
    return out.where("inside > 0 AND end IS NOT NULL AND n_ref + n_hyp > 0").drop("inside")
