"""Regions, presets and reports."""

import pytest

from sonargrid.operators import evaluation as ev


def test_regions_and_zones(spark):
    tokens = spark.createDataFrame(
        [("SPEAKER", "f", "1", 2.0, 3.0), ("SPEAKER", "f", "1", 8.0, 1.0), ("NOSCORE", "f", "1", 6.0, 0.5), ("NOSCORE", "g", "1", 0.0, 1.0)], "type string, file string, chnl string, tbeg double, tdur double"
    )
    assert [(r["file"], r["start"], r["end"]) for r in ev.region_of_tokens(tokens).collect()] == [("f", 2.0, 9.0)]
    zones = {(r["file"], r["start"], r["end"]) for r in ev.excluded_zones(tokens, most_extension=1.0).collect()}
    assert zones == {("f", 5.0, 7.5), ("g", -1.0, 2.0)}
    left = ev.scored_region(ev.region_of_tokens(tokens), ev.excluded_zones(tokens), ["file", "chnl"])
    assert sorted((r["start"], r["end"]) for r in left.collect()) == [(2.0, 6.0), (6.5, 9.0)]


def test_clamp_and_modes(spark):
    region = spark.createDataFrame([("f", 0.0, 10.0), ("g", 0.0, 5.0)], "file string, start double, end double")
    manifest = spark.createDataFrame([("f", 2.0, 5.0)], "file string, offset double, duration double")
    assert sorted((r["file"], r["start"], r["end"]) for r in ev.clamped(region, manifest, ["file"]).collect()) == [("f", 2.0, 7.0), ("g", 0.0, 5.0)]
    ref = spark.createDataFrame([("f", "A", 0.0, 10.0), ("f", "B", 10.0, 20.0)], "file string, speaker string, start double, end double")
    hyp = spark.createDataFrame([("f", "x", 0.0, 12.0), ("f", "y", 12.0, 20.0)], "file string, speaker string, start double, end double")
    out = {r["mode"]: r["der"] for r in ev.error_by_mode(ref, hyp, ["file"]).where("file = 'f'").collect()}
    assert out["full"] == pytest.approx(0.1) and out["fair"] == out["forgiving"] == pytest.approx(1.75 / 19)


def test_report(spark):
    der = spark.createDataFrame([("s", 10.0, 1.0), ("t", 10.0, 3.0)], "session string, scored double, wrong double")
    words = spark.createDataFrame([("s", 4, 1)], "session string, n_ref long, errors long")
    out = {r["session"]: (r["der"], r["wer"]) for r in ev.report(der, words, "session").collect()}
    assert out == {"s": (0.1, 0.25), "t": (0.3, None), "TOTAL": (0.2, 0.25)}
