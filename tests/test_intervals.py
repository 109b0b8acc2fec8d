"""Interval and frame operators: worked values, and random inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from sonargrid.operators import frames as fr
from sonargrid.operators import intervals as iv
from sonargrid.operators import joins as jn


def make(spark, items, key="r"):
    return spark.createDataFrame([(key, float(a), float(b)) for a, b in items], "k string, start double, end double")


def pairs(df):
    return sorted((round(r["start"], 6), round(r["end"], 6)) for r in df.collect())


def test_vote_pad_merge_values(spark):
    both = make(spark, [(0, 2), (3, 4), (1, 3.5)])
    voted = iv.vote(both, ["k"], 2)
    assert pairs(voted) == [(1, 2), (3, 3.5)]
    assert pairs(iv.merge(iv.pad(voted, 0.2, 0.2), ["k"], 0.2)) == [(0.8, 2.2), (2.8, 3.7)]
    assert pairs(iv.merge(iv.pad(voted, 0.2, 0.2), ["k"], 1.0)) == [(0.8, 3.7)]
    assert pairs(iv.pad(make(spark, [(0.1, 1)]), 0.2, 0.2)) == [(0.0, 1.2)]


def test_neighbour_merge_keeps_its_quirk(spark):
    nested = make(spark, [(0, 10), (1, 2), (5, 6)])
    assert pairs(iv.merge(nested, ["k"])) == [(0, 10)]
    assert pairs(iv.merge_neighbours(nested, ["k"])) == [(0, 2), (5, 6)]


def test_windows_and_tiles(spark):
    out = iv.sliding_windows(make(spark, [(12.05, 14.45)]), 1.5, 0.75)
    assert sorted((round(r["w_start"], 2), round(r["w_duration"], 2)) for r in out.collect()) == [(12.05, 1.5), (12.8, 1.5), (13.55, 0.9)]
    split = iv.tumbling_split(make(spark, [(8, 20)]).withColumn("words", F.lit("a b")), 10, "words")
    assert sorted((r["start"], r["end"], r["words"]) for r in split.collect()) == [(8, 10, "a b"), (10, 20, ""), (20, 20, "")]


def brute_union(items, gap=0):
    out = []
    for a, b in sorted(x for x in items if x[1] > x[0]):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("seed", range(4))
def test_random_interval_algebra(spark, seed):
    rng = random.Random(seed)
    items = [(a := rng.randint(0, 60), a + rng.randint(0, 12)) for _ in range(rng.randint(0, 30))]
    other = [(a := rng.randint(0, 60), a + rng.randint(0, 12)) for _ in range(rng.randint(0, 30))]
    x, y = make(spark, items), make(spark, other)
    assert pairs(iv.merge(x, ["k"], 2)) == brute_union(items, 2)
    cover = lambda s, t: sum(a <= t < b for a, b in s)
    ticks = range(-1, 80)
    assert {t for a, b in pairs(iv.vote(x, ["k"], 2)) for t in range(int(a), int(b))} == {t for t in ticks if cover(items, t) >= 2}
    assert {t for a, b in pairs(iv.subtract(x, y, ["k"])) for t in range(int(a), int(b))} == {t for t in ticks if cover(items, t) and not cover(other, t)}
    joined = jn.range_join(x.withColumn("i", F.monotonically_increasing_id()), y, ["k"], 7)
    assert sorted((r["o_start"], r["o_end"]) for r in joined.collect()) == sorted((max(a, c), min(b, d)) for a, b in items for c, d in other if max(a, c) < min(b, d) and a < b and c < d)


@pytest.mark.parametrize("onset,offset", [(0.6, 0.4), (0.4, 0.6), (0.5, 0.5), (0.64, 0.74)])
def test_hysteresis_against_a_loop(spark, onset, offset):
    rng = random.Random(7)
    series = [[rng.choice([0.1, 0.3, 0.45, 0.5, 0.55, 0.64, 0.7, 0.74, 0.9]) for _ in range(rng.randint(1, 40))] for _ in range(15)]
    df = spark.createDataFrame([(i, j, v) for i, s in enumerate(series) for j, v in enumerate(s)], "k int, frame int, score double")
    got = {(r["k"], r["frame"]): r["state"] for r in fr.hysteresis(df, ["k"], onset, offset).collect()}
    for i, s in enumerate(series):
        state = 0
        for j, v in enumerate(s):
            state = (1 if v > onset else 0) if state == 0 else (0 if v < offset else 1)
            assert got[i, j] == state


def test_frames_and_labels(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate([0, 1, 1, 0, 1])], "k string, frame int, label int")
    assert pairs(fr.binary_runs(df, ["k"], 0.01)) == [(0.01, 0.02), (0.04, 0.04)]
    labels = fr.frame_labels(make(spark, [(1, 2)], "f"), spark.createDataFrame([("f", 4.0)], "k string, duration double"), ["k"], 1)
    assert [r["label"] for r in labels.orderBy("frame").collect()] == [0, 1, 1, 0]


def test_empty_inputs(spark):
    none = make(spark, [])
    for out in (iv.merge(none, ["k"]), iv.vote(none, ["k"], 2), iv.complement(none, ["k"]), iv.subtract(none, none, ["k"]), jn.range_join(none, none, ["k"], 5)):
        assert rows(out) == []
