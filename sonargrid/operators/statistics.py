"""Aggregates and statistics: channel quality, weights, percentiles, confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import Keys


def mean_or_zero(c: str | Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def mean_step(df: DataFrame, keys: Keys, value: str = "score", order: str = "frame") -> DataFrame:
    """Mean absolute difference of consecutive values; 0 for fewer than two."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    return df.withColumn("_s", step).groupBy(*keys).agg(mean_or_zero("_s").alias("mean_step"))


def min_max(keys: Keys, value: str, default: float = 0.5) -> Column:
    """value scaled to 0 ... 1 within the key; default if all are equal or the value isn't finite. Infinite values don't stretch the range."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
    low, high = F.min(F.when(finite, F.col(value))).over(w), F.max(F.when(finite, F.col(value))).over(w)
    return F.when(finite & (high > low), (F.col(value) - low) / (high - low)).otherwise(F.lit(default))


def channel_profile(frames: DataFrame, keys: Keys, top: float = 0.2, bottom: float = 0.2, speech: float = 0.5) -> DataFrame:
    """Per channel (the last key): mean of the top and bottom fractions of scores, their margin, speech ratio and stability (1 - mean step)."""
    w, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col("score"), F.col("frame"))
    n = F.count(F.lit(1)).over(w)
    ranked = frames.withColumns({"n": n, "up": F.row_number().over(by), "step": F.abs(F.col("score") - F.lag("score").over(Window.partitionBy(*keys).orderBy("frame")))})
    low_n, high_n = F.greatest(F.floor(F.col("n") * bottom), F.lit(1)), F.greatest(F.floor(F.col("n") * top), F.lit(1))
    out = ranked.groupBy(*keys).agg(
        mean_or_zero(F.when(F.col("up") <= low_n, F.col("score"))).alias("low_mean"),
        mean_or_zero(F.when(F.col("up") > F.col("n") - high_n, F.col("score"))).alias("high_mean"),
        F.avg((F.col("score") >= speech).cast("double")).alias("speech_ratio"),
        mean_or_zero("step").alias("mean_step"),
    )
    return out.withColumns({"confidence_margin": F.greatest(F.col("high_mean") - F.col("low_mean"), F.lit(0.0)), "stability": F.greatest(1 - F.col("mean_step"), F.lit(0.0))}).drop("mean_step")


def channel_weights(profile: DataFrame, keys: Keys, parts: dict[str, float], floor: float = 0.0) -> DataFrame:
    """profile plus quality (weighted sum of the named columns, floor at least) and weight (quality's share within keys; equal shares if all are 0)."""
    quality = F.greatest(sum((F.col(c) * v for c, v in parts.items()), F.lit(0.0)), F.lit(floor))
    w = Window.partitionBy(*keys)
    out = profile.withColumn("quality", quality)
    total = F.sum("quality").over(w)
    return out.withColumn("weight", F.when(total > 0, F.col("quality") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def signal_quality(blocks: DataFrame, keys: Keys) -> DataFrame:
    """From block sums (n_speech, e_speech, n_noise, e_noise): RMS of all, speech and noise, and SNR in dB, powers 1e-12 at least."""
    sums = blocks.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_speech", "e_speech", "n_noise", "e_noise")))
    mean = lambda e, n: F.when(n > 0, e / n).otherwise(0.0)
    s, z = mean(F.col("e_speech"), F.col("n_speech")), mean(F.col("e_noise"), F.col("n_noise"))
    rms = F.sqrt(mean(F.col("e_speech") + F.col("e_noise"), F.col("n_speech") + F.col("n_noise")))
    snr = 10 * F.log10(F.greatest(s, F.lit(1e-12)) / F.greatest(z, F.lit(1e-12)))
    return sums.select(*keys, rms.alias("rms"), F.sqrt(s).alias("speech_rms"), F.sqrt(z).alias("noise_rms"), snr.alias("snr_db"))


def snr_blocks(samples: DataFrame, speech: DataFrame, keys: Keys, rate: int, rounded: bool = True) -> DataFrame:
    """Samples (keys, index, value) against speech intervals: energy sums inside and outside. Interval ends become sample numbers, rounded or cut off."""
    to = F.round if rounded else F.floor
    marks = speech.select(*keys, F.explode(F.sequence(to(F.col("start") * rate).cast("long"), to(F.col("end") * rate).cast("long") - 1)).alias("index")).distinct().withColumn("in", F.lit(1))
    rows = samples.join(marks, [*keys, "index"], "left")
    e, inside = F.col("value") * F.col("value"), F.col("in").isNotNull()
    return rows.groupBy(*keys).agg(F.sum(inside.cast("long")).alias("n_speech"), F.sum(F.when(inside, e).otherwise(0.0)).alias("e_speech"), F.sum((~inside).cast("long")).alias("n_noise"), F.sum(F.when(~inside, e).otherwise(0.0)).alias("e_noise"))


def softmax(df: DataFrame, keys: Keys, value: str, temperature: float = 1.0, name: str = "weight") -> DataFrame:
    """Softmax of value / temperature within keys; minus infinity gets 0, and if all have it, equal shares."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    finite = F.col(value) > float("-inf")
    top = F.max(F.when(finite, F.col(value))).over(w)
    e = F.when(finite, F.exp((F.col(value) - top) / temperature)).otherwise(0.0)
    out = df.withColumn("_e", e)
    total = F.sum("_e").over(w)
    return out.withColumn(name, F.when(total > 0, F.col("_e") / total).otherwise(1.0 / F.count(F.lit(1)).over(w))).drop("_e")


def percentiles(df: DataFrame, keys: Keys, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Linearly interpolated percentiles, mean, min and max, one column each."""
    marks = [F.percentile(value, p).alias(f"p{p * 100:g}".replace(".", "_")) for p in points]
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *marks)


def nearest_rank(df: DataFrame, keys: Keys, value: str, percent: float) -> DataFrame:
    """sorted[ceil(n * percent / 100) - 1]."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias("value"))


def mode(df: DataFrame, keys: Keys, label: str, weight: str | None = None) -> DataFrame:
    """Most frequent label; ties go to the larger summed weight, then the smaller label."""
    per = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("w").desc(), F.col(label)))
    return per.withColumn("_r", first).where("_r = 1").select(*keys, label)


def running_metrics(df: DataFrame, keys: Keys, order: str, value: str) -> DataFrame:
    """df with the running sum, average and maximum of value."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{value}_sum": F.sum(value).over(w), f"{value}_avg": F.avg(value).over(w), f"{value}_max": F.max(value).over(w)})


def grid_search(results: DataFrame, params: Keys, value: str) -> DataFrame:
    """The parameter set of the smallest value, the first in parameter order among equals."""
    return results.orderBy(value, *params).limit(1)


def parameter_grid(spark, **values) -> DataFrame:
    """All combinations of the listed parameter values."""
    out = None
    for name, options in values.items():
        one = spark.createDataFrame([(v,) for v in options], [name])
        out = one if out is None else out.crossJoin(one)  # lists of settings, not data
    return out


def confidence(probs: Column, measure: str = "max_prob", alpha: float = 1 / 3) -> Column:
    """Confidence of a distribution (array): max_prob, or 1 - normalised Gibbs, Tsallis or Renyi entropy."""
    n = F.size(probs).cast("double")
    total = lambda f: F.aggregate(F.transform(probs, f), F.lit(0.0), lambda a, x: a + x)
    if measure == "max_prob":
        return (F.array_max(probs) * n - 1) / (n - 1)
    if measure == "entropy_gibbs":
        return 1 + total(lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)) / F.log(n)
    power = total(lambda p: F.pow(p, F.lit(alpha)))
    if measure == "entropy_tsallis":
        return 1 + (1 - power) / (F.pow(n, F.lit(1 - alpha)) - 1)
    if measure == "entropy_renyi":
        return 1 + F.log2(power) / (alpha - 1) / F.log2(n)
    raise ValueError(f"no such measure: {measure}")


def pooled_confidence(values: Column, how: str = "mean") -> Column:
    """min, max, mean or prod of an array of confidences."""
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(values)
    if how == "prod":
        return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def mean_perplexity(df: DataFrame, probs: str) -> DataFrame:
    """Mean over rows of exp(entropy) of the distribution in probs."""
    h = F.aggregate(F.transform(probs, lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg(F.exp(h)).alias("perplexity"))


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """Long form (i, j, cov) of the population covariance of the vectors' entries, i <= j; sums are pre-aggregated per task."""
    entries = F.transform(F.col(vector), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    pairs = df.select(F.explode(F.flatten(F.transform(entries, lambda a: F.transform(F.filter(entries, lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), a["x"].alias("a"), b["x"].alias("b")))))).alias("e"))
    return pairs.groupBy("e.i", "e.j").agg(F.covar_pop("e.a", "e.b").alias("cov"))
