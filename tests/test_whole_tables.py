"""Queries without SQL read whole texts and all rows."""

import pytest

from sonargrid.plans import registry


@pytest.fixture
def talk(spark, tmp_path):
    def said(turn):
        return " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}{turn // 2 * 'x'}" for i in range(30))

    # turns 0 and 2 are repeated by 1 and 3, but for the last word of each
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", said(t) + (" the" if t % 2 == 0 else " la")) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_session_cpwer_reads_all_turns(spark, talk):
    out = registry.QUERIES["session_cpwer"](spark, talk).collect()
    assert [(r["conv_id"], r["errors"], r["n_ref"]) for r in out] == [(1, 2, 62)]


def test_metrics_read_whole_turns(spark, talk):
    counts = registry.QUERIES["alignment_counts"](spark, talk).collect()
    assert sorted((r["pair"], r["hits"], r["substitutions"], r["deletions"], r["insertions"]) for r in counts) == [(1000, 30, 1, 0, 0), (1002, 30, 1, 0, 0)]
    assert [(r["len_ref"], r["len_hyp"]) for r in registry.QUERIES["corpus_bleu"](spark, talk).collect()] == [(62, 62)]
    words = {r["word"]: (r["tp"], r["fp"], r["fn"]) for r in registry.QUERIES["keyword_scores"](spark, talk).collect()}
    assert words["the"] == (0, 0, 2) and words["la"] == (0, 2, 0)


def test_simulated_sessions_draw_from_all_events(spark, tmp_path):
    rows = [(i, f"type{i % 3}", 10.0) for i in range(5000, 5300)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    out = registry.QUERIES["simulated_sessions"](spark, str(tmp_path)).collect()
    assert {r["session"] for r in out} == {0, 1, 2, 3} and {r["utterance"] for r in out} <= {r[0] for r in rows}
