"""Properties of the interval algebra on generated recordings; many recordings are one DataFrame, so an example costs one job."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sonargrid.operators import intervals as iv
from sonargrid.operators import metrics as me

interval = st.tuples(st.integers(0, 40), st.integers(0, 12)).map(lambda x: (x[0], x[0] + x[1]))
channels = st.lists(st.lists(interval, max_size=8), min_size=1, max_size=4)
recordings = st.lists(channels, min_size=8, max_size=25)
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, found):
    rows = [(r, c, a, b) for r, chans in enumerate(found) for c, items in enumerate(chans) for a, b in items]
    return spark.createDataFrame(rows, "rec int, chan int, start long, end long")


def ticks(df, n):
    out = [set() for _ in range(n)]
    for r in df.collect():
        out[r["rec"]] |= set(range(r["start"], r["end"]))
    return out


@few
@given(recordings)
def test_union_vote_and_complement(spark, found):
    df, n = frame(spark, found), len(found)
    cover = [set().union(*({t for a, b in items for t in range(a, b)} for items in chans)) if chans else set() for chans in found]
    merged = iv.merge(df, ["rec"])
    assert ticks(merged, n) == cover
    assert sorted(map(tuple, iv.merge(merged, ["rec"]).collect())) == sorted(map(tuple, merged.collect()))  # idempotent
    assert ticks(iv.vote(df.where("end > start"), ["rec"], 1), n) == cover
    per_channel = iv.merge(df, ["rec", "chan"])
    counts = [len(chans) for chans in found]
    for k in (1, 2, 3):
        expected = [{t for t in range(60) if sum(any(a <= t < b for a, b in items) for items in chans) >= k} for chans in found]
        assert ticks(iv.vote(per_channel, ["rec"], k), n) == expected
    assert max(counts) <= 4
    until = spark.createDataFrame([(r, 60) for r in range(n)], "rec int, duration long")
    rest = ticks(iv.complement(df, ["rec"], until), n)
    assert all(a | b == set(range(60)) and not a & b for a, b in zip(cover, rest, strict=True))


@few
@given(recordings)
def test_error_of_itself_is_zero(spark, found):
    df = frame(spark, found).where("end > start").selectExpr("rec", "CAST(chan AS STRING) AS speaker", "start", "end")
    for r in me.diarization_error(df, df, ["rec"]).collect():
        assert (r["miss"], r["false_alarm"], r["confusion"]) == (0, 0, 0)


@few
@given(recordings)
def test_tumbling_pieces_add_up(spark, found):
    df = frame(spark, found)
    whole = sum(b - a for chans in found for items in chans for a, b in items)
    pieces = iv.tumbling_split(df, 10).collect()
    assert sum(r["end"] - r["start"] for r in pieces) == whole
    assert all(r["start"] // 10 == r["chunk"] or r["start"] == r["end"] for r in pieces)
