"""Vectors, affinity graphs and clustering of sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, drop_cut
from .intervals import Keys


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, n).otherwise(1.0))  # taken once, not for each entry
    return F.flatten(F.transform(length, lambda n: F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column, eps: float = 3.5e-4) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def affinity(df: DataFrame, keys: Keys, item: str, vector: str) -> DataFrame:
    """Cosine of all pairs within a key (a session): (keys, i, j, sim), the diagonal 1. Pairs of a session by nature; sessions are bounded by their length."""
    unit = df.select(*keys, F.col(item).alias("i"), normalized(F.col(vector)).alias("v"))
    pairs = unit.join(unit.withColumnsRenamed({"i": "j", "v": "w"}), keys)
    return pairs.select(*keys, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(dot(F.col("v"), F.col("w"))).alias("sim"))


def scaled(sims: DataFrame, keys: Keys) -> DataFrame:
    """sim between the key's least (0) and greatest (1)."""
    w = Window.partitionBy(*keys)
    low, high = F.min("sim").over(w), F.max("sim").over(w)
    return sims.withColumn("sim", F.when(high > low, (F.col("sim") - low) / (high - low)).otherwise(F.lit(0.0)))


def top_neighbours(sims: DataFrame, keys: Keys, p: int) -> DataFrame:
    """Each item's p most similar items (ties to the smaller): (keys, i, j)."""
    r = F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.col("sim").desc(), "j"))
    return sims.withColumn("_r", r).where(F.col("_r") <= p).select(*keys, "i", "j")


def affinity_graph(sims: DataFrame, keys: Keys, p: int) -> DataFrame:
    """Mean of the top-p mask and its transpose: (keys, i, j, weight)."""
    top = top_neighbours(sims, keys, p)
    both = top.unionByName(top.select(*keys, F.col("j").alias("i"), F.col("i").alias("j")))
    return both.groupBy(*keys, "i", "j").agg((F.count(F.lit(1)) / 2.0).alias("weight"))


def closest(sims: DataFrame, keys: Keys, n: int) -> DataFrame:
    """The n + 1 items of the largest summed similarity."""
    total = sims.groupBy(*keys, "i").agg(F.sum("sim").alias("total"))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total").desc(), "i"))
    return total.withColumn("_r", r).where(F.col("_r") <= n + 1).drop("_r")


def mean_vector(df: DataFrame, keys: Keys, vector: str, unit: bool = True) -> DataFrame:
    """Mean of (normalised) vectors per key, normalised again."""
    rows = df.select(*keys, F.posexplode(normalized(F.col(vector)) if unit else F.col(vector)).alias("pos", "x"))
    per = rows.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    out = per.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(vector))
    return out.withColumn(vector, normalized(F.col(vector))) if unit else out


def centred(df: DataFrame, vector: str, use_std: bool = False) -> DataFrame:
    """Vectors minus their column means, over column deviations if asked, at unit length."""
    stats = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "s"))).alias("_stats"))  # one row of the vector's width
    out = df.crossJoin(F.broadcast(packed))
    v = F.zip_with(vector, "_stats", lambda x, s: (x - s["m"]) / (F.when(s["s"] > 0, s["s"]).otherwise(1.0) if use_std else F.lit(1.0)))
    return out.withColumn(vector, normalized(v)).drop("_stats")


def compact_labels(df: DataFrame, keys: Keys, label: str) -> DataFrame:
    """Labels renumbered 0 ... k-1 in their order."""
    w = Window.partitionBy(*keys).orderBy(label) if keys else Window.partitionBy(F.lit(1)).orderBy(label)
    return df.withColumn(label, F.dense_rank().over(w) - 1)


# numpy, one session at a time


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length > 0, length, 1)
    out = unit @ unit.T
    np.fill_diagonal(out, 1.0)
    return out


def rows_to_unit_range(m: np.ndarray) -> np.ndarray:
    spread = m.max() - m.min()
    return (m - m.min()) / spread if spread > 0 else np.zeros_like(m)


def top_mask(sim: np.ndarray, p: int) -> np.ndarray:
    """Symmetric mean of the top-p masks of the rows."""
    mask = np.zeros_like(sim)
    order = np.argsort(-sim, axis=1, kind="stable")[:, :p]
    np.put_along_axis(mask, order, 1.0, axis=1)
    return 0.5 * (mask + mask.T)


def connected(graph: np.ndarray) -> bool:
    seen = np.zeros(len(graph), bool)
    front = np.zeros(len(graph), bool)
    front[0] = True
    while front.any():
        seen |= front
        front = (graph[front] > 0).any(0) & ~seen
    return bool(seen.all())


def laplacian(graph: np.ndarray) -> np.ndarray:
    a = graph.copy()
    np.fill_diagonal(a, 0)
    return np.diag(a.sum(1)) - a


def eigen_gap(graph: np.ndarray, most: int) -> tuple[int, float]:
    """(number of clusters, gap) by the largest gap among the smallest eigenvalues."""
    values = np.linalg.eigvalsh(laplacian(graph))
    gaps = np.diff(values[: min(most + 1, len(values))])
    k = int(gaps.argmax()) if len(gaps) else 0
    return k + 1, float(gaps[k] / (values[-1] + 1e-10)) if len(gaps) else 0.0


def k_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Labels by k-means++ with seeded draws, the best of three starts."""
    best, least = np.zeros(len(x), int), np.inf
    for trial in range(3):
        rng = np.random.default_rng(seed + trial)
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            label = d.argmin(1)
            moved = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
            if np.abs(moved - c).sum() < 1e-4:
                break
            c = moved
        cost = d[np.arange(len(x)), label].sum()
        if cost < least - 1e-12:
            best, least = label, cost
    return best


def spectral_labels(x: np.ndarray, most: int = 8, known: int | None = None, max_share: float = 0.25, seed: int = 0) -> np.ndarray:
    """Labels by spectral clustering of a neighbour graph whose width p has the least ratio of p / n to the normalised largest eigengap."""
    n = len(x)
    if n <= 2:
        return np.zeros(n, int)
    sim = rows_to_unit_range(cosine_matrix(x))
    tops = sorted({max(2, round(p)) for p in np.linspace(2, max(2, int(n * max_share)), 20)})
    chosen, ratio = None, np.inf
    for p in tops:
        graph = top_mask(sim, p)
        k, gap = eigen_gap(graph, most)
        if gap > 0 and (p / n) / gap < ratio:
            chosen, ratio = (p, k), (p / n) / gap
    p, k = chosen or (tops[-1], 1)
    while p < n and not connected(top_mask(sim, p)):
        p += 1
    graph = top_mask(sim, p)
    k = min(known or k, n)
    if k < 2:
        return np.zeros(n, int)
    _, vectors = np.linalg.eigh(laplacian(graph))
    label = k_means(vectors[:, :k], k, seed)
    _, out = np.unique(label, return_inverse=True)
    return out


def average_linkage(x: np.ndarray, threshold: float, most: int | None = None, target: int | None = None, forbidden: set[tuple[int, int]] = frozenset()) -> np.ndarray:
    """Agglomerative labels on cosine distance, average linkage, never joining a forbidden pair. With a target the threshold doesn't count; ties keep the first pair."""
    n = len(x)
    dist = 1 - cosine_matrix(x)
    groups = [[i] for i in range(n)]
    barred = np.zeros((n, n), bool)
    for a, b in forbidden:
        barred[a, b] = barred[b, a] = True
    while len(groups) > 1 and (target is None or len(groups) > target):
        best, at = np.inf, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if not barred[np.ix_(groups[i], groups[j])].any():
                    d = dist[np.ix_(groups[i], groups[j])].mean()
                    if d < best:
                        best, at = d, (i, j)
        if at is None or (target is None and best > threshold and (most is None or len(groups) <= most)):
            break
        groups[at[0]] += groups.pop(at[1])
    out = np.zeros(n, int)
    for label, g in enumerate(sorted(map(sorted, groups))):
        out[g] = label
    return out


def cluster_sessions(df: DataFrame, session: str, item: str, vector: str, method: str = "spectral", **options) -> DataFrame:
    """(session, item, cluster): each session's vectors clustered in one task; long sessions go through cluster_long_sessions."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item)
        x = np.stack(rows[vector].to_numpy()).astype(float)
        label = spectral_labels(x, **options) if method == "spectral" else average_linkage(x, **options)
        return pd.DataFrame({session: rows[session], item: rows[item], "cluster": label})

    return df.select(session, item, vector).groupBy(session).applyInPandas(one, f"`{session}` {kind[session]}, `{item}` {kind[item]}, cluster long")


def chunk_numbers(df: DataFrame, session: str, item: str, chunk: int) -> DataFrame:
    """df plus chunk, the number of each row's run of chunk consecutive items of the session. Rows are dealt by ranges of (session, item), so no task holds a session."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), session, item)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(session, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(session).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(session).alias("_session"), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(session, "_range").orderBy(item)) - 1
    placed = dealt.withColumn("_place", place).join(sizes, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_range") == F.col("_at")))
    return placed.select(*df.columns, F.floor((F.col("_place") + F.col("_before")) / chunk).alias("chunk"))


def cluster_long_sessions(df: DataFrame, session: str, item: str, vector: str, chunk: int = 500, per_chunk: int = 20, most_centres: int = 1000, **options) -> DataFrame:
    """(session, item, cluster): chunks of consecutive items are over-clustered, their centres clustered per session, labels handed back.

    Centres of a session that has more than most_centres are chunked in turn, level by level, so a task holds a chunk or most_centres vectors.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item)
        x = np.stack(rows[vector].to_numpy()).astype(float)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        label = k_means(unit, min(per_chunk, len(x)))
        node = rows["chunk"].to_numpy() * 1_000_000 + label
        used = np.unique(label)
        centres = [unit[label == i].mean(0) for i in used]
        items = pd.DataFrame({session: rows[session], item: rows[item], "_node": node, "_centre": None})
        means = pd.DataFrame({session: [rows[session].iloc[0]] * len(used), item: None, "_node": rows["chunk"].iloc[0] * 1_000_000 + used, "_centre": [c / (np.linalg.norm(c) or 1.0) for c in centres]})
        return pd.concat([items.astype({"_centre": object}), means.astype({"_centre": object})], ignore_index=True)

    chunks = chunk_numbers(df.select(session, item, vector), session, item, chunk)
    both = cut(chunks.groupBy(session, "chunk").applyInPandas(part, f"`{session}` {kind[session]}, `{item}` {kind[item]}, _node long, _centre array<double>"), "chunks")
    local = both.where("_centre IS NULL").select(session, item, "_node")
    centres = both.where("_centre IS NOT NULL").select(session, "_node", F.col("_centre").alias(vector))
    large = centres.groupBy(F.col(session).alias("_session")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most_centres).select("_session")
    if large.isEmpty():
        labels = cluster_sessions(centres, session, "_node", vector, **options)
    else:
        if per_chunk >= min(chunk, most_centres):
            raise ValueError("per_chunk must be less than chunk and most_centres: chunks would not get fewer")
        same = F.col(session).eqNullSafe(F.col("_session"))
        deeper = centres.join(F.broadcast(large), same, "left_semi").withColumnRenamed("_node", "_item")
        deeper = cluster_long_sessions(deeper, session, "_item", vector, chunk, per_chunk, most_centres, **options).withColumnRenamed("_item", "_node")
        labels = cluster_sessions(centres.join(F.broadcast(large), same, "left_anti"), session, "_node", vector, **options).unionByName(deeper)
    labels = labels.select(F.col(session).alias("_session"), F.col("_node").alias("_of"), "cluster")
    return local.join(labels, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_node") == F.col("_of"))).select(session, item, "cluster")


def graph_components(edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, node, component) of edges (i, j) per key, by least-label propagation with pointer jumping until nothing changes. Each round is cut to the shared folder."""
    both = edges.select(*keys, "i", "j").unionByName(edges.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy(*keys, F.col("i").alias("node")).agg(F.least(F.first("i"), F.min("j")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "j"), [*keys, "j"]).groupBy(*keys, F.col("i").alias("node")).agg(F.min("component").alias("m"))
        better = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = labels.select(*keys, F.col("node").alias("c"), F.col("component").alias("u"))
        new = cut(better.join(up, [*keys, "c"], "left").select(*keys, "node", "old", F.least("c", F.coalesce("u", "c")).alias("component")), "labels")
        drop_cut(labels)
        labels = new
        if not new.where("old <> component").limit(1).count():
            drop_cut(both)
            return labels.drop("old")


def stitched_labels(old: DataFrame, new: DataFrame, keys: Keys, item: str) -> DataFrame:
    """new (keys, item, label) renamed to the labels of old with which they agree most, one to one; labels without a partner follow after the old ones."""
    from .joins import assign

    both = old.withColumnRenamed("label", "was").join(new, [*keys, item]).groupBy(*keys, "was", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = assign(both, keys, "label", "was", "n").drop("n")
    last = old.groupBy(*keys).agg(F.max("label").alias("last"))
    rest = new.select(*keys, "label").distinct().join(pairs, [*keys, "label"], "left_anti")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("label"))
    fresh = rest.join(last, keys, "left").withColumn("was", F.coalesce("last", F.lit(-1)) + order).drop("last")
    named = pairs.select(*keys, "label", F.col("was").cast("long")).unionByName(fresh.select(*keys, "label", F.col("was").cast("long")))
    return new.join(named, [*keys, "label"]).drop("label").withColumnRenamed("was", "label")


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def weighted_scales(sims: DataFrame, weights: DataFrame, keys: Keys) -> DataFrame:
    """Affinities per scale (keys, scale, i, j, sim), items mapped to the base scale, summed with the scales' weights."""
    return sims.join(F.broadcast(weights), "scale").groupBy(*keys, "i", "j").agg(F.sum(F.col("sim") * F.col("weight")).alias("sim"))


def with_anchors(x: np.ndarray, speakers: int, samples: int, spread: float, rng: np.random.Generator) -> np.ndarray:
    """x behind synthetic speakers: random unit centres with samples around each, which steady the counting of few vectors."""
    width = x.shape[1]
    centres = rng.normal(size=(speakers, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    noise = rng.normal(size=(speakers, samples, width)) * spread / np.sqrt(width)
    return np.concatenate([(centres[:, None] + noise).reshape(-1, width) * np.linalg.norm(x, axis=1).mean(), x])


def anchored_count(x: np.ndarray, trials: int = 5, speakers: int = 3, samples: int = 10, spread: float = 0.1, seed: int = 0) -> int:
    """Number of clusters of few vectors: the most frequent count over random anchors, less the anchors."""
    counts = []
    for t in range(trials):
        y = with_anchors(x, speakers, samples, spread, np.random.default_rng(seed + t))
        sim = rows_to_unit_range(cosine_matrix(y))
        best, ratio = speakers + 1, np.inf
        for p in range(2, max(3, samples)):
            k, gap = eigen_gap(top_mask(sim, p), speakers + min(len(x), 8))
            if gap > 0 and (p / len(y)) / gap < ratio:
                best, ratio = k, (p / len(y)) / gap
        counts.append(max(1, best - speakers))
    values, n = np.unique(counts, return_counts=True)
    return int(values[n.argmax()])


def reduced(x: np.ndarray, labels: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most most vectors: in the largest cluster the two closest become their mean, again and again."""
    x, labels = [np.asarray(v, float) for v in x], list(labels)
    while len(x) > most:
        names, n = np.unique(labels, return_counts=True)
        own = [i for i, v in enumerate(labels) if v == names[n.argmax()]]
        if len(own) < 2:
            break
        sim = cosine_matrix(np.array([x[i] for i in own]))
        np.fill_diagonal(sim, -np.inf)
        a, b = divmod(int(sim.argmax()), len(own))
        i, j = own[min(a, b)], own[max(a, b)]
        x[i] = (x[i] + x[j]) / 2
        del x[j], labels[j]
    return np.array(x), np.array(labels)
