"""Mixing, splitting, bucketing and batching of data set rows. Random choices are hashes of the row's id and a seed: the same on every run and partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A number in (0, 1) that the columns and the seed determine."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def temperature_weights(df: DataFrame, weight: str, temperature: float, inverse: bool = False) -> DataFrame:
    """df plus share: w^T / sum w^T, or p^(1/T) with inverse."""
    t = 1 / temperature if inverse else temperature
    p = F.pow(F.col(weight).cast("double"), F.lit(float(t)))
    return df.withColumn("share", p / F.sum(p).over(Window.partitionBy(F.lit(1))))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def interleave(sources: dict[str, DataFrame], weights: dict[str, float], key: str, seed: int = 0) -> DataFrame:
    """Sources in one stream: each row's place is its rank in its source, by hash, over the source's weight; rows come in order of place.

    Weighted streams run out together in proportion; equal weights are a round robin. (source, place) are added.
    """
    out = None
    for name, df in sources.items():
        order = Window.partitionBy("source").orderBy(F.xxhash64(key, F.lit(seed)), F.col(key))
        one = df.withColumn("source", F.lit(name)).withColumn("place", F.row_number().over(order) / float(weights[name]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sample_to_weights(df: DataFrame, source: str, key: str, shares: dict, total: int, seed: int = 0) -> DataFrame:
    """total rows in expectation, of each source its share: rows repeat a whole number of times, the fraction decided by hash. copies is added."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])
    want = F.coalesce(share[F.col(source)], F.lit(0.0)) * total / F.col("_n")
    joined = df.join(F.broadcast(counts), source)  # one row per source
    return joined.withColumn("copies", (F.floor(want) + (unit_hash(key, seed=seed) < want - F.floor(want)).cast("int")).cast("int")).drop("_n")


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, weighted: smallest -log(u) / weight."""
    return df.where(F.col(weight) > 0).orderBy(-F.log(unit_hash(key, seed=seed)) / F.col(weight), key).limit(n)


def session_speakers(sessions: DataFrame, permutations: DataFrame, session: str) -> DataFrame:
    """sessions with the speakers of that row (row 0, 1 ..., speakers) of a table of permutations whose number is the session's modulo the rows."""
    n = permutations.agg(F.count(F.lit(1)).alias("_n"))
    numbered = sessions.crossJoin(F.broadcast(n)).withColumn("row", F.pmod(F.col(session), F.col("_n"))).drop("_n")  # one row
    return numbered.join(permutations, "row").drop("row")


def split_by_hash(df: DataFrame, key: str, n_dev: int, seed: int = 0) -> DataFrame:
    """df plus split: dev for the n_dev distinct keys that come first by hash, else train."""
    dev = df.select(key).distinct().orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n_dev).withColumn("split", F.lit("dev"))
    return df.join(dev, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def linear_bins(low: float, high: float, n: int) -> list[float]:
    """Interior edges of n equal bins."""
    return [low + (high - low) * i / n for i in range(1, n)]


def bucket(value: Column, edges: list[float]) -> Column:
    """Index of the first edge at or above value; null beyond the last."""
    marks = F.transform(F.array(*map(F.lit, edges)), lambda e: value <= e)
    at = F.array_position(marks, True)
    return F.when(at > 0, at - 1).cast("int")


def bucket_2d(first: Column, second: Column, edges: list[tuple[float, float]], strict: bool = True, max_ratio: float | None = None) -> Column:
    """Index of the smallest bucket both lengths fit. Strict: within the buckets of the least fitting first edge only; lenient: any later one. Rows above max_ratio
    (second / first) have none."""
    items = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i).alias("i")) for i, (a, b) in enumerate(edges)))
    wide = F.filter(items, lambda e: first <= e["a"])
    fits = F.filter(wide, lambda e: (second <= e["b"]) & ((e["a"] == wide[0]["a"]) if strict else F.lit(True)))
    out = F.try_element_at(fits, F.lit(1))["i"]
    return F.when(second <= first * max_ratio, out) if max_ratio is not None else out


def fixed_batches(df: DataFrame, keys: list[str], size: int | Column, *order: Column) -> DataFrame:
    """df plus batch: consecutive rows of a key, size at a time (a number or a column), the last may be short."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size))


def rank_stride(df: DataFrame, keys: list[str], replicas: int, *order: Column) -> DataFrame:
    """df plus rank: rows of a key dealt to replicas in turn; first ones repeat so that all ranks have as many."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    total = F.ceil(F.col("_n") / replicas) * replicas
    rows = rows.withColumn("_j", F.explode(F.sequence(F.col("_i").cast("long"), total - 1, F.col("_n").cast("long"))))
    return rows.withColumn("rank", F.col("_j") % replicas).drop("_i", "_n", "_j")


def budget_batches(df: DataFrame, keys: list[str], cost: str, order: str, budget: float, quadratic: float | None = None, max_items: int | None = None) -> DataFrame:
    """df plus batch: a row starts a new batch when the batch's rows times its largest cost would pass the budget. Greedy in order, per key (a shard).

    quadratic: costs are cost + cost^2 / quadratic.
    """
    schema = df.schema.simpleString()[7:-1] + ", batch long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        c = rows[cost].astype(float)
        c = c + c * c / quadratic if quadratic else c
        batch, n, most, out = 0, 0, 0.0, []
        for x in c.tolist():
            if n and ((n + 1) * max(most, x) > budget or (max_items and n >= max_items)):
                batch, n, most = batch + 1, 0, 0.0
            n, most = n + 1, max(most, x)
            out.append(batch)
        return rows.assign(batch=out)

    return df.groupBy(*keys).applyInPandas(one, schema)


def with_alternatives(df: DataFrame, text: str, lang: str, alternatives: str) -> DataFrame:
    """Each row as it is and once per alternative (array of struct text, lang)."""
    own = F.array(F.struct(F.col(text).alias("text"), F.col(lang).alias("lang")))
    rest = [c for c in df.columns if c not in (text, lang, alternatives)]
    return df.select(*rest, F.explode(F.concat(own, F.coalesce(alternatives, F.array().cast(df.schema[alternatives].dataType)))).alias("_a")).select(*rest, F.col("_a.text").alias(text), F.col("_a.lang").alias(lang))


def token_windows(df: DataFrame, tokens: str, size: int) -> DataFrame:
    """Token arrays cut to windows of size, one row each with its number."""
    n = F.ceil(F.size(tokens) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(tokens), i * size + 1, size))
    return df.where(F.size(tokens) > 0).select(*[c for c in df.columns if c != tokens], F.posexplode(cut).alias("window", tokens))


def tagged(df: DataFrame, **tags) -> DataFrame:
    """df with constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def combine(config: list[dict], read, inherited: dict | None = None) -> DataFrame:
    """Union of a nested list of sources: a group passes its tags and weight down; a leaf is read(entry) with its tags as columns."""
    out = None
    for entry in config:
        tags = {**(inherited or {}), **entry.get("tags", {})}
        one = combine(entry["input_cfg"], read, tags) if "input_cfg" in entry else tagged(read(entry), **tags)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def config_depth(config) -> int:
    """Levels of nested source groups."""
    return 1 + max((config_depth(e["input_cfg"]) for e in config if "input_cfg" in e), default=0)
