"""Signal arithmetic on numbers and sample arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    """Root mean square of an array."""
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v) / F.size(x))


def mag2db(x: Column, eps: float = 1e-16) -> Column:
    return 20 * F.log10(x + eps)


def db2mag(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def pow2db(x: Column, eps: float = 1e-16) -> Column:
    return 10 * F.log10(x + eps)


def wrap_angle(x: Column) -> Column:
    """Angle to -pi ... pi."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def log_compressed(x: Column, guard: str = "add", value: float = 1.0) -> Column:
    return F.log(x + value) if guard == "add" else F.log(F.greatest(x, F.lit(value)))


def mono(channels: Column, channel: int | None = None) -> Column:
    """One channel of an array of channels, or their mean."""
    if channel is not None:
        return channels[channel]
    total = F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), channels[0], lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(channels))


def gained(x: Column, db: Column) -> Column:
    return F.transform(x, lambda v: v * db2mag(db))


def silence_padded(x: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), x, F.array_repeat(F.lit(value), after))


def shifted(x: Column, by: int) -> Column:
    """Samples by places later (earlier if negative), zeros where none are left."""
    n = F.size(x)
    if by >= 0:
        return F.concat(F.array_repeat(F.lit(0.0), by), F.slice(x, F.lit(1), F.greatest(n - by, F.lit(0))))
    return F.concat(F.slice(x, F.lit(1 - by), F.greatest(n + by, F.lit(0))), F.array_repeat(F.lit(0.0), -by))


def tiled(x: Column, length: Column) -> Column:
    """Whole copies of x, then its last samples, up to length."""
    n = F.size(x)
    rest = length % n
    return F.concat(F.flatten(F.array_repeat(x, F.floor(length / n).cast("int"))), F.slice(x, F.greatest(n - rest + 1, F.lit(1)), rest))


def cut_seconds(x: Column, start: Column, end: Column, rate: int) -> Column:
    a = F.floor(start * rate).cast("int")
    return F.slice(x, a + 1, F.greatest(F.floor(end * rate).cast("int") - a, F.lit(0)))


def padded_range(start: Column, end: Column, most: Column, rate: int, seconds: float) -> Column:
    by = int(rate * seconds)
    return F.struct(F.greatest(start - by, F.lit(0)).alias("start"), F.least(end + by, most).alias("end"))


def speech_bounds(frames: DataFrame, keys: list[str], run: int) -> DataFrame:
    """First and last frame of the runs of at least run speech frames: (keys, first, last)."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(run - 1), 0)
    full = (F.sum(F.col("speech").cast("int")).over(w) == run).alias("full")
    rows = frames.select(*keys, "frame", full).where("full")
    return rows.groupBy(*keys).agg((F.min("frame") - run + 1).alias("first"), F.max("frame").alias("last"))


def standardised(df: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    """value minus the mean over the deviation of its keys (sample deviation plus eps)."""
    w = Window.partitionBy(*keys)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / (F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)) + eps))


def standardised_by(df: DataFrame, stats: DataFrame, speaker: str, values: str, default: str | None = None) -> DataFrame:
    """Arrays scaled by a speaker's mean and std from a table (speaker, mean, std), a default speaker's for unknown ones; masked positions are 0."""
    joined = df.join(stats, speaker, "left")
    if default is not None:
        other = stats.where(F.col(speaker) == default).select(F.col("mean").alias("_m"), F.col("std").alias("_s")).limit(1)
        joined = joined.join(F.broadcast(other), how="left").withColumns({"mean": F.coalesce("mean", "_m"), "std": F.coalesce("std", "_s")}).drop("_m", "_s")
    out = F.transform(values, lambda x: (x - F.col("mean")) / F.col("std"))
    if "mask" in df.columns:
        out = F.zip_with(out, F.col("mask"), lambda x, m: F.when(m, x).otherwise(0.0))
    return joined.withColumn(values, out).drop("mean", "std")


def sdr(estimate: np.ndarray, target: np.ndarray, scale_invariant: bool = False, remove_mean: bool = True, most: float | None = None, eps: float = 1e-8) -> float:
    """Signal to distortion ratio in dB."""
    e, t = np.asarray(estimate, float), np.asarray(target, float)
    if remove_mean:
        e, t = e - e.mean(), t - t.mean()
    if scale_invariant:
        t = t * (e @ t) / (t @ t + eps)
    power, noise = (t**2).sum(), ((e - t) ** 2).sum()
    if most is not None:
        noise = noise + 10 ** (-most / 10) * power
    return float(10 * np.log10(power / (noise + eps) + eps))


def sdr_column(estimate: str, target: str, **options) -> Column:
    @F.pandas_udf("double")
    def run(e: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([sdr(a, b, **options) for a, b in zip(e, t, strict=True)])

    return run(estimate, target)


def prior(tokens: int, frames: int, scale: float = 1.0) -> np.ndarray:
    """Beta-binomial alignment prior, a row per frame."""
    k = np.arange(tokens)
    log_gamma = np.vectorize(math.lgamma)
    rows = []
    for i in range(1, frames + 1):
        a, b, n = scale * i, scale * (frames + 1 - i), tokens - 1
        choose = math.lgamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
        beta = log_gamma(k + a) + log_gamma(n - k + b) - math.lgamma(n + a + b) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        rows.append(np.exp(choose + beta))
    return np.array(rows)


def mel_filters(rate: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, of equal area."""
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(to_mel(low), to_mel(high or rate / 2), n_mels + 2))
    freqs = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freqs[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int, window: int = 400, hop: int = 160, n_fft: int = 512, n_mels: int = 80, preemphasis: float = 0.97) -> np.ndarray:
    """Log mel spectrogram, a row per frame."""
    x = np.asarray(x, float)
    x = np.append(x[:1], x[1:] - preemphasis * x[:-1])
    x = np.pad(x, n_fft // 2)
    n = 1 + max(0, (len(x) - n_fft) // hop)
    frames = np.stack([x[i * hop : i * hop + n_fft] for i in range(n)])
    shape = np.pad(np.hanning(window + 1)[:-1], ((n_fft - window) // 2, n_fft - window - (n_fft - window) // 2))
    power = np.abs(np.fft.rfft(frames * shape, axis=1)) ** 2
    return np.log(power @ mel_filters(rate, n_fft, n_mels).T + 2**-24)


def log_mel_column(samples: str, rate: int, **options) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [list(r) for r in log_mel(x, rate, **options)])

    return run(samples)


PERTURBATIONS: dict[str, object] = {}


def perturbation(name: str):
    """Register a function (samples, generator, options) -> samples."""
    def keep(f):
        PERTURBATIONS[name] = f
        return f

    return keep


@perturbation("gain")
def gain(x: np.ndarray, rng: np.random.Generator, low: float = -10, high: float = 10) -> np.ndarray:
    return x * 10 ** (rng.uniform(low, high) / 20)


@perturbation("white_noise")
def white_noise(x: np.ndarray, rng: np.random.Generator, low: float = -90, high: float = -46) -> np.ndarray:
    return x + rng.standard_normal(len(x)) * 10 ** (rng.uniform(low, high) / 20)


@perturbation("shift")
def shift(x: np.ndarray, rng: np.random.Generator, low: int = -80, high: int = 80) -> np.ndarray:
    by = int(rng.integers(low, high + 1))
    out = np.zeros_like(x)
    if abs(by) < len(x):
        out[max(by, 0) : len(x) + min(by, 0)] = x[max(-by, 0) : len(x) - max(by, 0)]
    return out


@perturbation("silence")
def silence(x: np.ndarray, rng: np.random.Generator, most: int = 800) -> np.ndarray:
    return np.pad(x, (int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))))


@perturbation("speed")
def speed(x: np.ndarray, rng: np.random.Generator, low: float = 0.9, high: float = 1.1) -> np.ndarray:
    rate = rng.uniform(low, high)
    n = max(1, int(len(x) / rate))
    return np.interp(np.arange(n) * rate, np.arange(len(x)), x) if len(x) else x


@perturbation("crop")
def crop(x: np.ndarray, rng: np.random.Generator, size: int = 16000) -> np.ndarray:
    if len(x) <= size:
        return np.pad(x, (0, size - len(x)))
    at = int(rng.integers(0, len(x) - size + 1))
    return x[at : at + size]


@perturbation("impulse")
def impulse(x: np.ndarray, rng: np.random.Generator, response: tuple = (1.0, 0.5, 0.25)) -> np.ndarray:
    return np.convolve(x, np.asarray(response))[: len(x)]


@perturbation("noise")
def noise(x: np.ndarray, rng: np.random.Generator, sample: tuple = (), low: float = 10, high: float = 50) -> np.ndarray:
    if not len(sample) or not len(x):
        return x
    z = np.resize(np.asarray(sample, float), len(x))
    wanted = np.sqrt((x**2).mean()) / 10 ** (rng.uniform(low, high) / 20)
    return x + z * wanted / max(np.sqrt((z**2).mean()), 1e-12)


def augmented(df: DataFrame, key: str, samples: str, steps: list[tuple[float, str, dict]], seed: int = 0) -> DataFrame:
    """Samples through perturbations (probability, name, options), drawn from the row's key and the seed, so that reruns agree."""
    @F.pandas_udf("array<double>")
    def run(h: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for k, x in zip(h, s, strict=True):
            rng, y = np.random.default_rng(int(k) & (2**63 - 1)), np.asarray(x, float)
            for p, name, options in steps:
                if rng.random() < p:
                    y = PERTURBATIONS[name](y, rng, **options)
            out.append(list(map(float, y)))
        return pd.Series(out)

    return df.withColumn(samples, run(F.xxhash64(key, F.lit(seed)), F.col(samples)))


def coherence(spectra: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Complex coherence of channels per frequency: spectra (channels, frequencies, frames) to (frequencies, channels, channels)."""
    s = np.moveaxis(np.asarray(spectra), 0, 1)
    cross = s @ s.conj().swapaxes(1, 2) / s.shape[2]
    power = np.einsum("fcc->fc", cross).real
    return cross / np.sqrt(power[:, :, None] * power[:, None, :] + eps)


def spliced(df: DataFrame, keys: list[str], vector: str, n: int) -> DataFrame:
    """Each frame's vector with those of the next n - 1 frames behind it; past the end the last frame repeats."""
    w = Window.partitionBy(*keys).orderBy("frame")
    last = F.last(vector).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = [F.coalesce(F.lead(vector, i).over(w), last) if i else F.col(vector) for i in range(n)]
    return df.withColumn(vector, F.concat(*parts))
