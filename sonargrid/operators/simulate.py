"""Synthetic sessions and code-switched samples, from seeded draws per session: reruns agree on any partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_of(*parts) -> np.random.Generator:
    import zlib

    return np.random.default_rng(zlib.crc32("|".join(map(str, parts)).encode()))


def sessions(utterances: DataFrame, n_sessions: int, n_speakers: int, length: float, silence: float = 0.1, overlap: float = 0.1, seed: int = 0) -> DataFrame:
    """(session, speaker, utterance, start, end): utterances (speaker, utterance, duration) of n_speakers drawn per session laid out up to length, with target
    shares of silence and overlap.

    Speakers are few against utterances: a session is drawn from the table of speakers' utterances, which is grouped by speaker first and joined to the
    sessions that drew the speaker.
    """
    spark = utterances.sparkSession
    speakers = utterances.select("speaker").distinct()
    ids = spark.range(n_sessions).withColumnRenamed("id", "session")
    # each session takes the speakers that come first by hash: a bounded list of speakers per session, found by one ranked join
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.xxhash64("session", "speaker", F.lit(seed)), "speaker"))
    chosen = ids.crossJoin(F.broadcast(speakers)).withColumn("r", rank).where(F.col("r") <= n_speakers).drop("r")
    rows = chosen.join(utterances, "speaker")
    kinds = {f.name: f.dataType.simpleString() for f in utterances.schema.fields}

    def lay(df: pd.DataFrame) -> pd.DataFrame:
        session = int(df["session"].iloc[0])
        rng = seed_of(seed, session)
        pools = {s: list(zip(g["utterance"], g["duration"], strict=True)) for s, g in df.sort_values(["speaker", "utterance"]).groupby("speaker")}
        names, out, t, last = sorted(pools), [], 0.0, None
        while t < length and any(pools.values()):
            free = [s for s in names if pools[s] and (s != last or len(names) == 1)] or [s for s in names if pools[s]]
            who = free[int(rng.integers(len(free)))]
            name, d = pools[who].pop(int(rng.integers(len(pools[who]))))
            d = float(d)
            start = t
            if out and last != who and rng.random() < 0.5:
                start = max(out[-1][2], t - rng.exponential(overlap * d)) if overlap else t
            else:
                start = t + (rng.exponential(silence * d) if silence else 0.0)
            end = min(start + d, length)
            if end <= start:
                break
            out.append((who, name, start, end))
            t, last = max(t, end), who
        return pd.DataFrame({"session": session, "speaker": [o[0] for o in out], "utterance": [o[1] for o in out], "start": [o[2] for o in out], "end": [o[3] for o in out]})

    return rows.groupBy("session").applyInPandas(lay, f"session long, speaker {kinds['speaker']}, utterance {kinds['utterance']}, start double, end double")


def annotations(laid: DataFrame) -> DataFrame:
    """Simulated sessions as segment rows (file, start, end, speaker)."""
    return laid.select(F.concat(F.lit("session_"), "session").alias("file"), "start", "end", F.col("speaker").cast("string").alias("speaker"))


def code_switched(samples: DataFrame, n: int, shares: dict[str, float], least: float, most: float, seed: int = 0) -> DataFrame:
    """(mix, place, sample, lang, duration): n concatenations of samples (sample, lang, duration) of drawn languages, of least to most seconds; each language's samples are
    used once before any repeats. One shard (the column shard, if there is one) makes its own n.
    """
    keyed = samples if "shard" in samples.columns else samples.withColumn("shard", F.lit(0))
    kind = samples.schema["sample"].dataType.simpleString()

    def draw(df: pd.DataFrame) -> pd.DataFrame:
        rng = seed_of(seed, df["shard"].iloc[0])
        pools = {lang: g.sort_values("sample")[["sample", "duration"]].to_numpy().tolist() for lang, g in df[df["lang"].isin(list(shares))].groupby("lang")}
        names = sorted(pools)
        p = np.array([shares[x] for x in names], float)
        order = {x: [] for x in names}
        out = []
        for i in range(n if names else 0):
            total, place, misses = 0.0, 0, 0
            while total < least and misses < 20:
                lang = names[int(rng.choice(len(names), p=p / p.sum()))]
                if not order[lang]:
                    order[lang] = list(rng.permutation(len(pools[lang])))
                sample, d = pools[lang][order[lang].pop()]
                if total + d > most:
                    misses += 1
                    continue
                out.append((df["shard"].iloc[0] * n + i, place, sample, lang, float(d)))
                total, place = total + d, place + 1
        return pd.DataFrame(out, columns=["mix", "place", "sample", "lang", "duration"])

    return keyed.groupBy("shard").applyInPandas(draw, f"mix long, place int, sample {kind}, lang string, duration double")


def split_points(words: DataFrame, keys: list[str], buffer: float) -> DataFrame:
    """(keys, t): where a sentence can be split, in the middle of pauses longer than twice the buffer; words (start, end)."""
    from pyspark.sql import Window

    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    rows = words.withColumn("next", after).where(F.col("next") - F.col("end") > 2 * buffer)
    return rows.select(*keys, ((F.col("end") + F.col("next")) / 2).alias("t"))
