"""Joins of intervals, points and nearest neighbours. Range conditions become equi joins on (keys, time bin)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Keys, merge, total_duration


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the intersection, 0 if there is none."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def range_join(left: DataFrame, right: DataFrame, keys: Keys, width, suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs of intervals of one key that overlap, each once, with o_start and o_end.

    Both sides are spread over bins of the given width; a pair counts in the bin where its intersection starts, so none is counted
    twice. width about the usual length of an interval keeps both the copies and the pairs per bin few.
    """
    def spread(df: DataFrame, suffix: str) -> DataFrame:
        named = df.select(*keys, *(F.col(c).alias(c + suffix) for c in df.columns if c not in keys)).where(F.col("start" + suffix) < F.col("end" + suffix))
        first, last = F.floor(F.col("start" + suffix) / width), F.floor(F.col("end" + suffix) / width)
        return named.withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = suffixes
    pairs = spread(left, a).join(spread(right, b), [*keys, "_bin"])
    start, end = F.greatest("start" + a, "start" + b), F.least("end" + a, "end" + b)
    pairs = pairs.where((start < end) & (F.floor(start / width) == F.col("_bin")))
    return pairs.withColumns({"o_start": start, "o_end": end}).drop("_bin")


def intersection_duration(left: DataFrame, right: DataFrame, keys: Keys, width) -> DataFrame:
    """Total intersection per key."""
    return range_join(left, right, keys, width).groupBy(*keys).agg(F.sum(F.col("o_end") - F.col("o_start")).alias("duration"))


def speech_in_windows(windows: DataFrame, segments: DataFrame, keys: Keys, width) -> DataFrame:
    """windows plus speech: seconds of all segments inside, speakers counted each."""
    marked = windows.withColumn("w", F.struct("start", "end"))
    sums = range_join(marked, segments, keys, width).groupBy(*keys, F.col("w_l").alias("w")).agg(F.sum(F.col("o_end") - F.col("o_start")).alias("speech"))
    return marked.join(sums, [*keys, "w"], "left").withColumn("speech", F.coalesce("speech", F.lit(0))).drop("w")


def clipped(segments: DataFrame, windows: DataFrame, keys: Keys, width, owner: str) -> DataFrame:
    """Each owner's segments cut to the windows and merged: (keys, owner, start, end)."""
    pairs = range_join(segments, windows, keys, width)
    return merge(pairs.select(*keys, F.col(owner + "_l").alias(owner), F.col("o_start").alias("start"), F.col("o_end").alias("end")), [*keys, owner])


def dice(left: DataFrame, right: DataFrame, keys: Keys, width) -> DataFrame:
    """2 |A and B| / (|A| + |B|) per key of two disjoint interval sets; 0 without time."""
    both = intersection_duration(left, right, keys, width).withColumnRenamed("duration", "both")
    a, b = total_duration(left, keys).withColumnRenamed("duration", "a"), total_duration(right, keys).withColumnRenamed("duration", "b")
    out = a.join(b, keys, "full").join(both, keys, "left").na.fill(0, ["a", "b", "both"])
    return out.withColumn("dice", F.when(F.col("a") + F.col("b") > 0, 2 * F.col("both") / (F.col("a") + F.col("b"))).otherwise(F.lit(0.0)))


def clean_windows(windows: DataFrame, segments: DataFrame, keys: Keys, width, speaker: str = "speaker") -> DataFrame:
    """Windows that no segment of another speaker overlaps."""
    tagged = windows.withColumn("_id", F.struct(*windows.columns))
    dirty = range_join(tagged, segments, keys, width).where(F.col(speaker + "_l") != F.col(speaker + "_r")).select(F.col("_id_l").alias("_id"))
    return tagged.join(dirty.distinct(), "_id", "left_anti").drop("_id")


def cannot_link(members: DataFrame, keys: Keys, item: str) -> DataFrame:
    """All unordered pairs of a key's distinct items."""
    m = members.select(*keys, item).distinct()
    return m.withColumnRenamed(item, "a").join(m.withColumnRenamed(item, "b"), keys).where("a < b").select("a", "b").distinct()


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Keys, width, inclusive: bool = False) -> DataFrame:
    """points (keys, t) plus n: the intervals with start <= t < end (end included if asked)."""
    p = points.select(*points.columns, F.floor(F.col("t") / width).alias("_bin"))
    spread = intervals.select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin")).where("start <= end")
    inside = (F.col("start") <= F.col("t")) & ((F.col("t") <= F.col("end")) if inclusive else (F.col("t") < F.col("end")))
    hits = p.join(spread, [*keys, "_bin"]).where(inside).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("n"))
    distinct = points.select(*keys, "t").distinct().join(hits, [*keys, "t"], "left").select(*keys, "t", F.coalesce("n", F.lit(0)).alias("n"))
    return points.join(distinct, [*keys, "t"])


def asof(left: DataFrame, right: DataFrame, keys: Keys, value: str, forward: bool = False) -> DataFrame:
    """left (t) plus the right value at the latest right t at or before it (the earliest at or after it if forward); null if there is none.

    One tagged union and a window, so neither side is multiplied.
    """
    both = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(*keys, "t", value).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = [F.col("t").desc() if forward else F.col("t"), F.col("_side")]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)["v"]
    return both.withColumn("_found", found).where("_side = 1").drop("_side", value).withColumnRenamed("_found", value)


def nearest(left: DataFrame, right: DataFrame, keys: Keys, value: str) -> DataFrame:
    """left (t) plus the right value nearest in t; of equally near ones the earlier."""
    r = right.withColumn("_v", F.struct(F.col("t").alias("at"), F.col(value).alias("v"))).select(*keys, "t", "_v")
    back, ahead = asof(left, r, keys, "_v").withColumnRenamed("_v", "_b"), None
    both = asof(back, r, keys, "_v", forward=True)
    db, da = F.col("t") - F.col("_b.at"), F.col("_v.at") - F.col("t")
    take_back = F.col("_v").isNull() | (F.col("_b").isNotNull() & (db <= da))
    return both.withColumn(value, F.when(take_back, F.col("_b.v")).otherwise(F.col("_v.v"))).drop("_b", "_v")


def anchors(words: DataFrame, place: str = "start", offset=0) -> DataFrame:
    """words plus t, the time by which a word belongs to a turn: start, mid or end, moved by offset."""
    at = {"start": F.col("start"), "end": F.col("end"), "mid": (F.col("start") + F.col("end")) / 2}[place]
    return words.withColumn("t", at + offset)


def words_to_turns(words: DataFrame, turns: DataFrame, keys: Keys) -> DataFrame:
    """Words (t) in order to speaker turns, going on by at most one turn per word when t is past the turn's end."""
    schema = words.schema.simpleString()[7:-1] + ", speaker string"
    key_types = [words.schema[k].dataType.simpleString() for k in keys]

    def walk(key, w: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        w, t = w.sort_values(["start", "end"], kind="stable").reset_index(drop=True), t.sort_values(["start", "end"], kind="stable")
        ends, names, at, out = t["end"].tolist(), t["speaker"].tolist(), 0, []
        for x in w["t"].tolist():
            if at < len(ends) - 1 and x > ends[at]:
                at += 1
            out.append(names[at] if names else None)
        return w.assign(speaker=out)

    assert key_types
    return words.groupBy(*keys).cogroup(turns.groupBy(*keys)).applyInPandas(walk, schema)


def word_speakers(words: DataFrame, probs: DataFrame, keys: Keys, frame_length, shift: int = 0) -> DataFrame:
    """words plus the speaker with the highest mean probability over the word's frames; ties to the smaller speaker.

    Frames of words meet their probabilities by shuffle: no estimate knows how many frames a recording has.
    """
    first = F.floor(F.col("start") / frame_length).cast("int") + shift
    last = F.greatest(F.floor(F.col("end") / frame_length).cast("int") + shift, first)
    spans = words.withColumn("_w", F.struct("start", "end")).select(*keys, "_w", F.explode(F.sequence(first, last)).alias("frame"))
    means = spans.join(probs.hint("merge"), [*keys, "frame"]).groupBy(*keys, "_w", "spk").agg(F.avg("prob").alias("p"))
    best = means.groupBy(*keys, "_w").agg(F.max_by("spk", F.struct("p", -F.col("spk"))).alias("spk"))
    return words.withColumn("_w", F.struct("start", "end")).join(best.hint("merge"), [*keys, "_w"], "left").drop("_w")


def silence_after(words: DataFrame, frames: DataFrame, keys: Keys, frame_length, threshold, max_length) -> DataFrame:
    """words with end moved to the first frame at or after it whose score is below threshold, at most max_length after the word's start."""
    silent = frames.where(F.col("score") < threshold).select(*keys, (F.col("frame") * frame_length).alias("t"), (F.col("frame") * frame_length).alias("silence"))
    found = asof(words.withColumn("t", F.col("end")), silent, keys, "silence", forward=True)
    return found.withColumn("end", F.least(F.coalesce("silence", "end"), F.col("start") + max_length)).drop("t", "silence")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while match[col]:
            used[col] = True
            slack = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], col
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nxt = int(free.argmin())
            u[match[used]] += free[nxt]
            v[used] -= free[nxt]
            least[~used] -= free[nxt]
            col = nxt
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def assign(scores: DataFrame, keys: Keys, left: str, right: str, score: str, *more: str) -> DataFrame:
    """One-to-one pairs (keys, left, right, score) of the highest total score per key; pairs without positive score go. more: columns summed along.

    The matrix of one key is left names by right names, small by nature (speakers of a recording).
    """
    types = {f.name: f.dataType.simpleString() for f in scores.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, left, right, score, *more])

    def one(df: pd.DataFrame) -> pd.DataFrame:
        (a, i), (b, j) = (np.unique(df[c].to_numpy(), return_inverse=True) for c in (left, right))
        n = max(len(a), len(b))
        square = np.zeros((n, n))
        np.add.at(square, (i, j), -df[score].to_numpy(float))
        found = [(r, c) for r, c in enumerate(hungarian(square)) if r < len(a) and c < len(b) and square[r, c] < 0]
        rows = pd.DataFrame({left: [a[r] for r, _ in found], right: [b[c] for _, c in found], score: [-square[r, c] for r, c in found]})
        for c in more:
            sums = np.zeros((n, n), df[c].dtype)
            np.add.at(sums, (i, j), df[c].to_numpy())
            rows[c] = [sums[x] for x in found]
        for k in keys:
            rows[k] = df[k].iloc[0]
        return rows[[*keys, left, right, score, *more]]

    return scores.groupBy(*keys).applyInPandas(one, schema)


def link_greedily(candidates: DataFrame, keys: Keys) -> DataFrame:
    """Candidates (keys, score, a, a_chunk, b, b_chunk) best first, each item linked at most once per other chunk, no two items of one chunk in one
    group: (keys, item, group), group the smallest item. Ties go to the largest ids. Sequential by nature, per key (one session).
    """
    types = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + f", item {types['a']}, `group` {types['a']}"

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", "a", "b"], ascending=False)
        parent: dict = {}
        chunks: dict = {}
        for c in ("a", "b"):
            for item, chunk in zip(df[c], df[f"{c}_chunk"], strict=True):
                parent.setdefault(item, item)
                chunks.setdefault(item, {chunk})

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        taken = set()
        for r in df.itertuples():
            if (r.a, r.b_chunk) in taken or (r.b, r.a_chunk) in taken:
                continue
            x, y = root(r.a), root(r.b)
            if x != y and chunks[x] & chunks[y]:
                continue
            taken |= {(r.a, r.b_chunk), (r.b, r.a_chunk)}
            if x != y:
                x, y = min(x, y), max(x, y)
                parent[y] = x
                chunks[x] = chunks[x] | chunks[y]
        items = sorted(parent)
        rows = pd.DataFrame({"item": items, "group": [root(i) for i in items]})
        for k in keys:
            rows[k] = df[k].iloc[0]
        return rows[[*keys, "item", "group"]]

    return candidates.groupBy(*keys).applyInPandas(one, schema)
