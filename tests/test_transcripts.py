"""Transcript and conversation operators on small rows."""

import pytest

from sonargrid.operators import transcripts as tr


def test_words_and_chunks(spark):
    chars = spark.createDataFrame([("f", i, c, float(i), i + 1.0) for i, c in enumerate("ab  c")], "k string, pos int, char string, start double, end double")
    assert [(r["word"], r["start"], r["end"]) for r in tr.words_of_characters(chars, ["k"]).orderBy("start").collect()] == [("ab", 0, 2), ("c", 4, 5)]
    tokens = spark.createDataFrame([("f", 0, 10.0, 1.0, 2.0), ("f", 1, 5.0, 0.0, 1.0), ("f", 1, 5.0, -1.0, -1.0)], "k string, c int, n double, start double, end double")
    assert sorted((r["start"], r["end"]) for r in tr.shifted_chunks(tokens, ["k"], "c", "n").collect()) == [(-1, -1), (1, 2), (10, 11)]
    back = spark.createDataFrame([("f", 0, 1.0, 3.0), ("f", 1, 2.0, 2.5), ("f", 2, -1.0, -1.0), ("f", 3, 4.0, 5.0)], "k string, i int, start double, end double")
    assert [(r["start"], r["end"]) for r in tr.never_back(back, ["k"], "i").orderBy("i").collect()] == [(1, 3), (3, 3), (-1, -1), (4, 5)]


def test_stitching(spark):
    rows = spark.createDataFrame([(1, "a", "x", 0.0, 1.0), (2, "a", "y", 1.0, 2.0), (3, "b", "z", 0.0, 1.0), (4, "a", "w", 2.0, 3.0)], "i int, file string, text string, start double, end double")
    assert [(r["file"], r["text"], len(r["intervals"])) for r in tr.stitched_segments(rows, "file", "i").orderBy("run").collect()] == [("a", "x y", 2), ("b", "z", 1), ("a", "w", 1)]


def test_conversations(spark):
    agent = spark.createDataFrame([("s", 1.0, 2.0, "hi"), ("t", 0.0, 1.0, "yo")], "k string, start double, end double, text string")
    user = spark.createDataFrame([("s", 0.5, 1.0, "hey"), ("t", 2.0, 3.0, "ok")], "k string, start double, end double, text string")
    out = tr.duplex_turns(agent, user, ["k"], 0.2, drop_agent_first=True)
    assert [(r["k"], r["role"], r["start"]) for r in out.orderBy("place").collect()] == [("s", "user", 0.5), ("s", "agent", 0.8)]
    windows = spark.createDataFrame([("s", 1.0, 4.0)], "k string, low double, high double")
    assert [(r["start"], r["end"]) for r in tr.in_window(agent, windows, ["k"]).collect()] == [(0, 1)]


def test_permutation_and_side_text(spark):
    activity = spark.createDataFrame([("s", "x", 0.7), ("s", "y", 0.3)], "k string, speaker string, share double")
    slots = spark.createDataFrame([("s", 0, 0.25), ("s", 1, 0.75)], "k string, slot int, slot_share double")
    assert {r["speaker"]: r["slot"] for r in tr.permuted(activity, slots, "k").collect()} == {"x": 1, "y": 0}
    side = spark.createDataFrame([(0, "q0"), (1, "q1")], "pos long, text string")
    rows = spark.range(20)
    assert tr.side_text(rows, "id", side, 2).count() == 20 and tr.side_text(rows, "id", side, 2).select("side_text").distinct().count() == 2


def test_metric_registry(spark):
    df = spark.createDataFrame([("a b", "a c")], "r string, h string")
    assert tr.evaluate(df, "wer", "r", "h").first()["rate"] == 0.5
    with pytest.raises(ValueError):
        tr.evaluate(df, "nothing", "r", "h")
