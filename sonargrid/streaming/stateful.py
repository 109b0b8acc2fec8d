"""Incremental operators. Those named *_stream, online_* and stitched_tokens keep state by stream and run on streaming DataFrames; windowed_counts and sessions take
streaming or batch ones; the others are the batch definitions that tests hold the streams against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def framed(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Samples (keys, index, value) to frames (keys, frame, samples, length, is_first, is_last); the last may be short (batch)."""
    rows = samples.groupBy(*keys, F.floor(F.col("index") / size).alias("frame")).agg(F.transform(F.sort_array(F.collect_list(F.struct("index", "value"))), lambda x: x["value"]).alias("samples"))
    w = Window.partitionBy(*keys)
    return rows.withColumns({"length": F.size("samples"), "is_first": F.col("frame") == F.min("frame").over(w), "is_last": F.col("frame") == F.max("frame").over(w)})


def rolling_buffer(frames: DataFrame, keys: list[str], n: int) -> DataFrame:
    """frames plus buffer: the last n frames' samples joined (batch)."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(n - 1), 0)
    return frames.withColumn("buffer", F.flatten(F.collect_list("samples").over(w)))


def windowed_counts(events: DataFrame, time: str, key: str, value: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and event-time window, late rows accepted up to the watermark."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, window, slide or window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key with pauses under gap: (session window, key, n)."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def utterance_end(steps: list[int], length: int, stop: int) -> tuple[bool, int]:
    """End of utterance from the time steps of tokens in a buffer of length steps: after trailing silence above stop, else after the last gap above stop.

    stop 0: always, at the end. (found, step), step in the middle of the silence.
    """
    if stop == 0:
        return True, length - 1
    if not steps:
        return (True, stop // 2) if length > stop else (False, -1)
    if length - steps[-1] - 1 > stop:
        return True, steps[-1] + 1 + stop // 2
    for a, b in zip(steps[-2::-1], steps[:0:-1], strict=True):
        if b - a - 1 > stop:
            return True, a + 1 + stop // 2
    return False, -1


def silence_end(segments: list[tuple[float, float]], begin: float, until: float, stop: float) -> tuple[bool, float]:
    """The same from speech segments after begin: silence up to the buffer's end, else the last pause, above stop; half of stop into the silence."""
    cut = [(max(a, begin), b) for a, b in segments if b > begin]
    if not cut:
        return (until - begin > stop), begin + stop / 2
    if until - cut[-1][1] > stop:
        return True, cut[-1][1] + stop / 2
    for (_, b), (a, _) in zip(cut[-2::-1], cut[:0:-1], strict=True):
        if a - b > stop:
            return True, b + stop / 2
    return False, -1.0


def endpoints(tokens: DataFrame, stream: str, stop: int) -> DataFrame:
    """Utterance ends of token streams (stream, step), in batch: a gap of more than stop steps after a token ends an utterance."""
    w = Window.partitionBy(stream).orderBy("step")
    rows = tokens.withColumn("next", F.lead("step").over(w))
    return rows.where(F.col("next") - F.col("step") - 1 > stop).select(stream, (F.col("step") + 1 + stop // 2).alias("eou"))


def overlap_of(state: list, new: list, limit: int) -> int:
    """Longest suffix of state, limit at most, that begins new."""
    for k in range(min(limit, len(state), len(new)), 0, -1):
        if state[-k:] == new[:k]:
            return k
    return 0


def stitched_tokens(chunks: DataFrame, stream: str, limit: int = 8) -> DataFrame:
    """Chunks (stream, chunk, tokens: array<int>) appended per stream without the overlap with what is there: (stream, chunk, added, total).

    State per stream: the last limit tokens and the count. Chunks must arrive in order within a stream; those of one trigger are sorted.
    """
    schema = f"`{stream}` {kind_of(chunks, stream)}, chunk long, added array<int>, total long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, total = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("chunk").itertuples():
            new = [int(x) for x in row.tokens]
            added = new[overlap_of(tail, new, limit) :]
            tail, total = (tail + added)[-limit:], total + len(added)
            out.append((key[0], int(row.chunk), added, total))
        state.update((tail, total))
        yield pd.DataFrame(out, columns=[stream, "chunk", "added", "total"])

    return chunks.groupBy(stream).applyInPandasWithState(step, schema, "tail array<int>, total long", "append", GroupStateTimeout.NoTimeout)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def by_stream(df: DataFrame, stream: str, order: list[str], handle, out: str, state: str, idle: float | None) -> DataFrame:
    """handle(state or None, rows in order, closing) -> (rows, state) per stream, over micro-batches. With idle, a stream without rows for so many seconds is closed: handle
    gets no rows, and its state goes."""
    kind, names = kind_of(df, stream), [stream, *(c.split()[0].strip("`") for c in out.split(", "))]
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        before = tuple(group.get) if group.exists else None
        if group.hasTimedOut:
            found, _ = handle(before, pd.DataFrame(columns=[*order]), True)
            group.remove()
        else:
            found, after = handle(before, pd.concat(list(batches)).sort_values(order), False)
            if after is not None:
                group.update(after)
                if idle is not None:
                    group.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame([(key[0], *r) for r in found], columns=names)

    return df.groupBy(stream).applyInPandasWithState(step, f"`{stream}` {kind}, {out}", state, "append", timeout)


def framed_stream(chunks: DataFrame, stream: str, size: int, idle: float | None = None) -> DataFrame:
    """Chunks of samples (stream, chunk, samples: array<double>, last) to frames (stream, frame, samples, length, is_first, is_last), as framed gives them.

    State per stream: up to size samples and the next frame's number. A frame is held until a sample follows it or the stream ends: by its chunk marked
    last, or after idle seconds.
    """

    def handle(before, rows, closing):
        rest, frame = (list(before[0]), before[1]) if before else ([], 0)
        found, ended = [], closing
        for row in rows.itertuples():
            rest += [float(x) for x in row.samples]
            ended |= bool(row.last)
            while len(rest) > size:
                found.append((frame, rest[:size], size, frame == 0, False))
                rest, frame = rest[size:], frame + 1
        if ended and rest:
            found.append((frame, rest, len(rest), frame == 0, True))
            rest, frame = [], frame + 1
        return found, (rest, frame)

    return by_stream(chunks, stream, ["chunk"], handle, "frame long, samples array<double>, length int, is_first boolean, is_last boolean", "rest array<double>, frame long", idle)


def buffered_stream(frames: DataFrame, stream: str, n: int) -> DataFrame:
    """Frames (stream, frame, samples) to (stream, frame, buffer): the samples of the last n frames joined, as rolling_buffer gives them. State: n - 1 frames."""

    def handle(before, rows, closing):
        flat, sizes = (list(before[0]), list(before[1])) if before else ([], [])
        found = []
        for row in rows.itertuples():
            flat, sizes = flat + [float(x) for x in row.samples], [*sizes, len(row.samples)]
            while len(sizes) > n:
                flat, sizes = flat[sizes[0] :], sizes[1:]
            found.append((int(row.frame), list(flat)))
        return found, (flat, sizes)

    return by_stream(frames, stream, ["frame"], handle, "frame long, buffer array<double>", "flat array<double>, sizes array<int>", None)


def endpoints_stream(tokens: DataFrame, stream: str, stop: int) -> DataFrame:
    """Utterance ends of token streams (stream, step) as they come, as endpoints gives them: (stream, eou). State: the last step."""

    def handle(before, rows, closing):
        last, found = (before[0] if before else None), []
        for step in rows["step"].tolist():
            if last is not None and step - last - 1 > stop:
                found.append((int(last) + 1 + stop // 2,))
            last = step
        return found, (int(last),)

    return by_stream(tokens, stream, ["step"], handle, "eou long", "last long", None)


def online_segments(labels: DataFrame, stream: str, gap: float, idle: float | None = None) -> DataFrame:
    """Speech intervals (stream, start, end) arriving in order, merged as they come: closed segments (stream, start, end) once a later one begins beyond gap.

    State per stream: the open segment. A late interval that reaches into it replaces its bounds. The last one is closed after idle seconds without
    rows, or stays open.
    """

    def handle(before, rows, closing):
        current, found = list(before) if before else None, []
        for row in rows.itertuples():
            if current is not None and row.start <= current[1] + gap:
                current = [min(current[0], float(row.start)), max(current[1], float(row.end))]
            else:
                if current is not None:
                    found.append(tuple(current))
                current = [float(row.start), float(row.end)]
        if closing and current is not None:
            found.append(tuple(current))
        return found, tuple(current) if current else None

    return by_stream(labels, stream, ["start", "end"], handle, "start double, end double", "start double, end double", idle)


def online_windows(labels: DataFrame, stream: str, gap: float, window: float, shift: float, idle: float | None = None) -> DataFrame:
    """Windows (stream, start, duration) of new speech as intervals (stream, start, end) come in order: those of sliding_windows over the merged segments.

    State per stream: the open segment and the cursor, the start of its next window. A window goes out when speech has passed its end; a segment's last window,
    which ends with it, when the segment is closed by a later one or after idle seconds.
    """

    def handle(before, rows, closing):
        current, found = list(before) if before else None, []

        def close() -> None:
            start, end, cursor = current
            if end > cursor or cursor == start:
                found.append((cursor, end - cursor))

        for row in rows.itertuples():
            if current is not None and row.start <= current[1] + gap:
                current[1] = max(current[1], float(row.end))
            else:
                if current is not None:
                    close()
                current = [float(row.start), float(row.end), float(row.start)]
            while current[2] + window < current[1]:
                found.append((current[2], window))
                current[2] += shift
        if closing and current is not None:
            close()
        return found, tuple(current) if current else None

    return by_stream(labels, stream, ["start", "end"], handle, "start double, duration double", "start double, end double, cursor double", idle)


def online_clusters(embeddings: DataFrame, stream: str, vector: str, threshold: float = 0.5, most: int = 8) -> DataFrame:
    """Each arriving vector (stream, item, vector) joins the nearest centre within threshold (cosine distance) or opens one, up to most: (stream, item, cluster).

    State per stream: centres (sums of unit vectors, flat) and their sizes, bounded by most.
    """
    schema = f"`{stream}` {kind_of(embeddings, stream)}, item long, cluster int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, width = (np.array(state.get[0], float), state.get[1]) if state.exists else (np.zeros(0), 0)
        centres = [c for c in flat.reshape(-1, width)] if width else []
        out = []
        for row in pd.concat(list(batches)).sort_values("item").itertuples():
            x = np.asarray(getattr(row, vector), float)
            x = x / max(np.linalg.norm(x), 1e-12)
            near = [1 - c @ x / max(np.linalg.norm(c), 1e-12) for c in centres]
            if centres and (min(near) <= threshold or len(centres) >= most):
                label = int(np.argmin(near))
                centres[label] = centres[label] + x
            else:
                label = len(centres)
                centres.append(x)
            out.append((key[0], int(row.item), label))
        state.update(([float(v) for c in centres for v in c], len(centres[0]) if centres else 0))
        yield pd.DataFrame(out, columns=[stream, "item", "cluster"])

    return embeddings.groupBy(stream).applyInPandasWithState(step, schema, "centres array<double>, width int", "append", GroupStateTimeout.NoTimeout)


def majority_labels(runs: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Most frequent label of each segment over its last runs (keys, run, label); ties to the smaller."""
    recent = runs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("run").desc()))).where(F.col("_r") <= last)
    counted = recent.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "label"))).where("_o = 1").select(*keys, "label")
