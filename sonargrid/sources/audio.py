"""PCM WAV files as sample columns, through Spark's binary file source."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import stem
from pyspark.sql import functions as F


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, channels x samples in -1 ... 1) of an 8, 16 or 32 bit file."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    kind, scale, middle = {1: (np.uint8, 128, 128), 2: ("<i2", 32768, 0), 4: ("<i4", 1 << 31, 0)}[width]
    return rate, ((np.frombuffer(raw, kind).astype(float) - middle) / scale).reshape(-1, channels).T


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, recording, rate, channels: an array of samples per channel)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [decode(c) for c in df["content"]]
            yield pd.DataFrame({"path": df["path"], "rate": [r for r, _ in found], "channels": [[list(c) for c in x] for _, x in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, rate int, channels array<array<double>>").withColumn("recording", stem(F.col("path")))


def wav_bytes(samples: str, rate: int):
    """A column's samples (-1 ... 1, one channel, or an array of channels) as 16 bit WAV files."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            channels = np.atleast_2d(np.array([list(c) for c in x], float) if len(x) and not np.isscalar(x[0]) else np.asarray(x, float))
            sink = io.BytesIO()
            with wave.open(sink, "wb") as w:
                w.setnchannels(len(channels))
                w.setsampwidth(2)
                w.setframerate(rate)
                w.writeframes(np.clip(np.round(channels.T * 32768), -32768, 32767).astype("<i2").tobytes())
            out.append(sink.getvalue())
        return pd.Series(out)

    return run(samples)
