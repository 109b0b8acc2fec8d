"""Streaming operators give what their batch definition gives, whatever the micro-batches."""

import random

import numpy as np
import pytest

from sonargrid.operators import intervals as iv
from sonargrid.streaming import stateful as sf


def streamed(spark, tmp_path, df_parts, schema, operator, name, mode="append"):
    """operator's output over files that arrive one per micro-batch."""
    folder = tmp_path / name
    for i, rows in enumerate(df_parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part={i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = operator(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_online_segments(spark, tmp_path):
    rng = random.Random(3)
    rows, t = [], 0.0
    for _ in range(60):
        t += rng.choice([0.0, 0.2, 0.5, 3.0])
        rows.append((1, t, t + rng.random()))
    schema = "stream long, start double, end double"
    got = streamed(spark, tmp_path, [rows[i : i + 20] for i in (0, 20, 40)], schema, lambda d: sf.online_segments(d, "stream", 0.3), "segments")
    whole = sorted((r["start"], r["end"]) for r in iv.merge(spark.createDataFrame(rows, schema), ["stream"], 0.3).collect())
    assert sorted((r["start"], r["end"]) for r in got) == whole[:-1]  # the last is still open


def test_last_segment_closes_after_a_pause(spark, tmp_path):
    import time

    schema = "stream string, start double, end double"
    folder = tmp_path / "idle"
    spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.1, 2.0)], schema).coalesce(1).write.parquet(str(folder))
    source = spark.readStream.schema(schema).parquet(str(folder))
    query = sf.online_segments(source, "stream", 0.3, idle=1.0).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "idle-cp")).start()
    try:
        until = time.time() + 60
        while not spark.table("idle").count() and time.time() < until:
            time.sleep(0.5)
        assert [tuple(r) for r in spark.table("idle").collect()] == [("a", 0.0, 2.0)]
    finally:
        query.stop()


def test_framed_and_buffered_streams(spark, tmp_path):
    rng = random.Random(4)
    values, chunks, at = [float(i) for i in range(100)], [], 0
    while at < 100:
        n = rng.randint(1, 17)
        chunks.append((1, len(chunks), values[at : at + n], at + n >= 100))
        at += n
    got = streamed(spark, tmp_path, [chunks[:4], chunks[4:6], chunks[6:]], "stream long, chunk long, samples array<double>, last boolean", lambda d: sf.framed_stream(d, "stream", 8), "framing")
    batch = sf.framed(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "stream long, index int, value double"), ["stream"], 8)
    plain = lambda r: (r["frame"], list(r["samples"]), r["length"], r["is_first"], r["is_last"])
    assert sorted(map(plain, got)) == sorted(map(plain, batch.collect()))
    frames = [(1, r["frame"], r["samples"]) for r in sorted(got, key=lambda r: r["frame"])]
    buffers = streamed(spark, tmp_path, [frames[:5], frames[5:]], "stream long, frame long, samples array<double>", lambda d: sf.buffered_stream(d, "stream", 3), "buffers")
    expected = {r["frame"]: r["buffer"] for r in sf.rolling_buffer(batch, ["stream"], 3).collect()}
    assert {r["frame"]: r["buffer"] for r in buffers} == expected


def test_endpoints_stream(spark, tmp_path):
    rng = random.Random(5)
    steps = sorted(rng.sample(range(400), 60))
    rows = [("s", t) for t in steps]
    got = streamed(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], "stream string, step long", lambda d: sf.endpoints_stream(d, "stream", 6), "ends")
    assert sorted(r["eou"] for r in got) == sorted(r["eou"] for r in sf.endpoints(spark.createDataFrame(rows, "stream string, step long"), "stream", 6).collect())


def test_online_windows(spark, tmp_path):
    rng = random.Random(6)
    rows, t = [], 0.0
    for _ in range(50):
        t += rng.choice([0.0, 0.25, 0.5, 3.0])
        rows.append((1, t, t + rng.randint(1, 9) / 4))
    schema = "stream long, start double, end double"
    got = streamed(spark, tmp_path, [rows[i : i + 17] for i in (0, 17, 34)] + [[(1, 1000.0, 1001.0)]], schema, lambda d: sf.online_windows(d, "stream", 0.25, 1.5, 0.75), "windows")
    merged = iv.merge(spark.createDataFrame(rows, schema), ["stream"], 0.25)
    assert sorted((r["start"], r["duration"]) for r in got) == sorted((r["w_start"], r["w_duration"]) for r in iv.sliding_windows(merged, 1.5, 0.75).collect())


def test_online_clusters(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = np.eye(4)[:2]
    rows = [(7, i, [float(v) for v in centres[i % 2] + rng.normal(0, 0.05, 4)]) for i in range(12)]
    got = streamed(spark, tmp_path, [rows[:5], rows[5:]], "stream long, item long, v array<double>", lambda d: sf.online_clusters(d, "stream", "v"), "clusters")
    assert {r["item"]: r["cluster"] for r in got} == {i: i % 2 for i in range(12)}


def test_windowed_counts(spark, tmp_path):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=7 * i), i % 3, float(i)) for i in range(40)]
    schema = "ts timestamp, k int, v double"
    got = streamed(spark, tmp_path, [rows[:20], rows[20:]], schema, lambda d: sf.windowed_counts(d, "ts", "k", "v", "1 hour"), "counts", "complete")
    expected = {}
    for ts, k, v in rows:
        n, s = expected.get((ts.replace(minute=0), k), (0, 0.0))
        expected[ts.replace(minute=0), k] = (n + 1, s + v)
    assert {(r["window"]["start"], r["k"]): (r["n"], r["total"]) for r in got} == expected


def test_framing(spark):
    samples = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "k string, index int, value double")
    frames = sf.framed(samples, ["k"], 4)
    assert [(r["length"], r["is_first"], r["is_last"]) for r in frames.orderBy("frame").collect()] == [(4, True, False), (4, False, False), (2, False, True)]
    assert [len(r["buffer"]) for r in sf.rolling_buffer(frames, ["k"], 2).orderBy("frame").collect()] == [4, 8, 6]


def test_majority(spark):
    runs = spark.createDataFrame([(1, r, x) for r, x in enumerate([0, 0, 1, 1, 1])] + [(2, 0, 3), (2, 1, 2)], "seg int, run int, label int")
    assert {r["seg"]: r["label"] for r in sf.majority_labels(runs, ["seg"], 3).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("a,b,k", [([1, 2, 3], [2, 3, 4], 2), ([1], [2], 0), ([], [1], 0), ([5, 5], [5, 5], 2)])
def test_overlap(a, b, k):
    assert sf.overlap_of(a, b, 8) == k
