"""Pipelines, simulation and further metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonargrid.operators import metrics as me
from sonargrid.operators import simulate as sim
from sonargrid.operators import vectors as ve
from sonargrid.plans import pipelines


def test_diarize(spark):
    rng = np.random.default_rng(1)
    turns = [(i, float(2 * i), 2.0 * i + 2, "AB"[(i // 5) % 2]) for i in range(40)]
    centres = {"A": np.eye(6)[0] * 4, "B": np.eye(6)[1] * 4}
    emb = spark.createDataFrame([("s", i, a, b, [float(x) for x in centres[w] + rng.normal(0, 0.1, 6)]) for i, a, b, w in turns], "k string, item int, start double, end double, vector array<double>")
    channels = spark.createDataFrame([("s", 0.0, 80.0), ("s", 0.0, 80.0), ("s", 10.0, 90.0)], "k string, start double, end double")
    ref = spark.createDataFrame([("s", w, a, b) for _, a, b, w in turns], "k string, speaker string, start double, end double")
    out = pipelines.diarize(channels, emb, ref, ["k"], 10, known=2)
    assert {r["k"]: r["der"] for r in out["error"].collect()}["s"] == 0


def test_tuning(spark):
    scores = spark.createDataFrame([("f", i, 0.9 if 10 <= i < 20 else 0.4) for i in range(40)], "k string, frame int, score double")
    ref = spark.createDataFrame([("f", 10.0, 20.0)], "k string, start double, end double")
    region = spark.createDataFrame([("f", 0.0, 40.0)], "k string, start double, end double")
    out = {r["onset"]: r["error_rate"] for r in pipelines.tune_thresholds(scores, ref, region, ["k"], [0.3, 0.5], [0.5], 1.0).collect()}
    assert out == {0.3: 3.0, 0.5: 0.0}


def test_prepare(spark):
    df = spark.createDataFrame([(i, float(i), "en" if i % 2 else "fr") for i in range(50)], "id int, d double, lang string")
    out = pipelines.prepare(df, "id", "d", 5, 40, [10, 20, 45], 4, ".lang == en").collect()
    assert {r["id"] for r in out} == {i for i in range(5, 41) if i % 2} and max(sum(1 for r in out if (r["bucket"], r["batch"]) == k) for k in {(r["bucket"], r["batch"]) for r in out}) == 4


def test_simulation(spark):
    utt = spark.createDataFrame([(s, f"{s}{i}", 1.0 + i % 3) for s in "abcd" for i in range(20)], "speaker string, utterance string, duration double")
    out = sim.sessions(utt, 3, 2, 30.0, seed=4).toPandas()
    again = sim.sessions(utt.repartition(7), 3, 2, 30.0, seed=4).toPandas()
    assert sorted(map(str, out.to_numpy().tolist())) == sorted(map(str, again.to_numpy().tolist()))
    assert out.groupby("session").speaker.nunique().max() <= 2 and out.end.max() <= 30 and (out.end > out.start).all()
    mixes = sim.code_switched(spark.createDataFrame([(i, "en" if i % 2 else "de", 2.0) for i in range(20)], "sample int, lang string, duration double"), 5, {"en": 0.5, "de": 0.5}, 6, 9).toPandas()
    assert mixes.groupby("mix").duration.sum().between(6, 9).all()


def test_more_metrics(spark):
    df = spark.createDataFrame([("en", "Hi, you.", "hi you!"), ("fr", "a b", "a b")], "lang string, r string, h string")
    marks = {r["mark"]: r for r in me.punctuation_errors(df, "r", "h").collect()}
    assert marks[","]["deletions"] == 1 and marks["."]["substitutions"] == 1 and marks["TOTAL"]["rate"] == 1
    keys = {r["word"]: r for r in me.keyword_scores(spark.createDataFrame([("a key b", "a kee b key")], "r string, h string"), "r", "h", ["key"]).collect()}
    assert (keys["key"]["tp"], keys["key"]["fp"], keys["key"]["fn"]) == (0, 1, 1)
    assert {r["lang"]: r["rate"] for r in me.exact_match(df, "lang", "r", "h").collect()} == {"en": 0, "fr": 1, "TOTAL": 0.5}
    assert me.empty_rate(df, "h").first()["rate"] == 0
    top = me.top_k_accuracy(spark.createDataFrame([([0.1, 0.7, 0.2], 2)], "s array<double>, l int"), "s", "l", (1, 2)).first()
    assert (top["top_1"], top["top_2"]) == (0, 1)


def test_frechet(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 3))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    assert me.frechet_distance(df, df, "v") == pytest.approx(0, abs=1e-6)
    moved = df.select(F.transform("v", lambda e: e + 1).alias("v"))
    assert me.frechet_distance(df, moved, "v") == pytest.approx(3, abs=1e-6)


def test_stitched_labels(spark):
    old = spark.createDataFrame([("s", i, i // 3) for i in range(6)], "k string, i int, label int")
    new = spark.createDataFrame([("s", i, [5, 5, 5, 2, 2, 2, 9][i]) for i in range(7)], "k string, i int, label int")
    assert {r["i"]: r["label"] for r in ve.stitched_labels(old, new, ["k"], "i").collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}
