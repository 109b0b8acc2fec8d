"""Metrics against worked values and enumeration."""

import itertools

import numpy as np
import pytest

from sonargrid.operators import metrics as me
from sonargrid.operators import sampling as sa
from sonargrid.operators import statistics as st
from sonargrid.operators import vectors as ve
from sonargrid.operators.joins import assign, hungarian, link_greedily, words_to_turns


def segments(spark, items):
    return spark.createDataFrame([("f", s, float(a), float(b)) for s, a, b in items], "file string, speaker string, start double, end double")


@pytest.mark.parametrize("collar,scored,confusion", [(0, 20, 2), (0.25, 19, 1.75)])
def test_der_values(spark, collar, scored, confusion):
    ref, hyp = segments(spark, [("A", 0, 10), ("B", 10, 20)]), segments(spark, [("x", 0, 12), ("y", 12, 20)])
    out = {r["file"]: r for r in me.diarization_error(ref, hyp, ["file"], collar).collect()}["f"]
    assert (out["scored"], round(out["confusion"], 9), out["miss"], out["false_alarm"]) == (scored, confusion, 0, 0)
    assert out["der"] == pytest.approx(confusion / scored)


def test_der_of_itself_is_zero(spark):
    ref = segments(spark, [("A", 0, 10), ("B", 5, 20), ("C", 19, 25)])
    assert {r["der"] for r in me.diarization_error(ref, ref, ["file"]).collect()} == {0.0}


def test_hungarian_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        cost = rng.integers(0, 9, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert cost[np.arange(n), hungarian(cost)].sum() == best


def test_assignment_keeps_positive_pairs(spark):
    df = spark.createDataFrame([("s", "a", "x", 5.0), ("s", "a", "y", 4.0), ("s", "b", "x", 4.0), ("s", "c", "z", 0.0)], "k string, ref string, hyp string, v double")
    assert sorted((r["ref"], r["hyp"]) for r in assign(df, ["k"], "ref", "hyp", "v").collect()) == [("a", "y"), ("b", "x")]


def test_word_errors(spark):
    df = spark.createDataFrame([(1, "hi how are you well", "hey how are we"), (2, "", ""), (3, "", "a"), (4, "a b", None)], "id int, r string, h string")
    out = {x["id"]: x for x in me.error_counts(df, "r", "h").collect()}
    assert out[1]["rate"] == pytest.approx(0.6) and out[2]["rate"] == 0 and out[3]["rate"] == float("inf") and out[4]["rate"] == 1
    counts = {x["id"]: x for x in me.alignment_counts(df, "r", "h").collect()}
    assert counts[1]["substitutions"] + counts[1]["deletions"] + counts[1]["insertions"] == 3


def test_cpwer(spark):
    ref = spark.createDataFrame([("s", "A", "one two three"), ("s", "B", "four five")], "session string, speaker string, text string")
    hyp = spark.createDataFrame([("s", "1", "four five"), ("s", "2", "one two")], "session string, speaker string, text string")
    assert me.cpwer(ref, hyp, "session").first()["errors"] == 1


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 60), rng.integers(0, 10, 60) / 10, strict=True)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert me.auc_roc(df).first()["auc"] == pytest.approx(wins)


def test_laal_and_percentile(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0], 4.0, 3)], "id int, delays array<double>, source_length double, target_length int")
    gamma = 3 / 4
    assert me.average_lagging(df, "id").first()["laal"] == pytest.approx(np.mean([1 - 0 / gamma, 2 - 1 / gamma, 4 - 2 / gamma]))
    ten = spark.createDataFrame([("k", i) for i in range(1, 11)], "k string, v int")
    assert st.nearest_rank(ten, ["k"], "v", 99).first()["value"] == 10


def test_temperature_and_labels(spark):
    df = spark.createDataFrame([("a", 197), ("b", 2159)], "s string, n int")
    one = {r["s"]: r["share"] for r in sa.temperature_weights(df, "n", 1.0).collect()}
    assert one["a"] == pytest.approx(0.0836, abs=1e-4)
    assert {r["share"] for r in sa.temperature_weights(df, "n", 0.0).collect()} == {0.5}
    labels = spark.createDataFrame([(i, v) for i, v in enumerate([3, 3, 3, 4, 4, 5])], "i int, l int")
    assert [r["l"] for r in ve.compact_labels(labels, [], "l").orderBy("i").collect()] == [0, 0, 0, 1, 1, 2]


def test_bucket_2d(spark):
    from pyspark.sql import functions as F

    edges = [(10, 5), (10, 10), (20, 12), (20, 18)]
    row = spark.range(1).select(sa.bucket_2d(F.lit(8), F.lit(11), edges).alias("s"), sa.bucket_2d(F.lit(8), F.lit(11), edges, strict=False).alias("l")).first()
    assert row["s"] is None and row["l"] == 2


def test_clusters_separate_what_is_apart(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:3] * 5
    data = [("s", i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.1, 8)]) for i in range(45)]
    df = spark.createDataFrame(data, "s string, i int, v array<double>")
    for out in (ve.cluster_sessions(df, "s", "i", "v"), ve.cluster_sessions(df, "s", "i", "v", "linkage", threshold=0.5), ve.cluster_long_sessions(df, "s", "i", "v", 15, 4, known=3)):
        groups = {}
        for r in out.collect():
            groups.setdefault(r["cluster"], set()).add(r["i"] % 3)
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def test_greedy_linking_and_turns(spark):
    cand = spark.createDataFrame([("s", 0.9, "c1a", "c1", "c2a", "c2"), ("s", 0.8, "c1b", "c1", "c2a", "c2"), ("s", 0.7, "c1b", "c1", "c2b", "c2")], "k string, score double, a string, a_chunk string, b string, b_chunk string")
    groups = {r["item"]: r["group"] for r in link_greedily(cand, ["k"]).collect()}
    assert groups == {"c1a": "c1a", "c2a": "c1a", "c1b": "c1b", "c2b": "c1b"}
    words = spark.createDataFrame([("s", float(i), i + 0.5, float(i)) for i in range(4)], "k string, start double, end double, t double")
    turns = spark.createDataFrame([("s", 0.0, 1.0, "A"), ("s", 1.0, 1.5, "B"), ("s", 1.5, 9.0, "C")], "k string, start double, end double, speaker string")
    assert [r["speaker"] for r in words_to_turns(words, turns, ["k"]).orderBy("start").collect()] == ["A", "A", "B", "C"]


def test_anchors_and_reduction():
    rng = np.random.default_rng(3)
    centres = np.eye(16)[:2]
    x = np.concatenate([c + rng.normal(0, 0.02, (10, 16)) for c in centres])
    assert ve.anchored_count(x) == 2
    small, labels = ve.reduced(x, np.repeat([0, 1], 10), 6)
    assert len(small) == 6 and sorted(np.bincount(labels)) == [3, 3] and np.abs(small - centres[labels]).max() < 0.1


@pytest.mark.parametrize("tolerance", [0, 3, 2_000_000_000])
def test_token_hits_by_enumeration(spark, tolerance):
    rng = np.random.default_rng(tolerance % 97)
    side = lambda n: [(f"f{rng.integers(3)}", int(p), int(rng.integers(2))) for p in rng.integers(-40, 40, n)]
    target, predicted = [*side(60), ("alone", 5, 1), (None, 5, 1), ("f0", None, 1)], [*side(12), (None, 5, 1), ("f1", None, 1)]
    frame = lambda rows: spark.createDataFrame(rows, "file string, pos long, token int")
    out = {r["file"]: r["accuracy"] for r in me.token_hits(frame(target), frame(predicted), ["file"], 1, tolerance).collect()}
    hit = lambda f, p: f is not None and p is not None and any(g == f and q is not None and t == 1 and abs(p - q) <= tolerance for g, q, t in predicted)
    wanted = {f: [hit(g, p) for g, p, t in target if g == f and t == 1] for f in {g for g, _, t in target if t == 1}}
    assert out == pytest.approx({f: sum(x) / len(x) for f, x in wanted.items()})


def test_long_sessions_of_many_centres(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:3] * 5
    data = [(s, i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.1, 8)]) for s, n in (("long", 700), ("short", 40), (None, 33)) for i in range(n)]
    df = spark.createDataFrame(data, "s string, i int, v array<double>").repartition(7)
    out = ve.cluster_long_sessions(df, "s", "i", "v", 20, 6, most_centres=25, known=3).collect()
    assert sorted((r["s"] or "", r["i"]) for r in out) == sorted((s or "", i) for s, i, _ in data)
    for s in ("long", "short", None):
        assert len({(r["cluster"], r["i"] % 3) for r in out if r["s"] == s}) == 3
    numbers = ve.chunk_numbers(df, "s", "i", 20).collect()
    assert all(r["chunk"] == r["i"] // 20 for r in numbers) and len(numbers) == len(data)
