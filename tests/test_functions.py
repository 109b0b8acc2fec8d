"""Scalar functions, sources and streams."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonargrid.functions import predicates as pr
from sonargrid.functions import signal as sg
from sonargrid.functions import text as tx
from sonargrid.sources import audio, formats, tar
from sonargrid.streaming import stateful as sf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, tx.clean_label(F.lit(" Hello, World 21! "))) == "hello world two one"
    assert one(spark, tx.tighten_punctuation(F.lit("a , b . é !"))) == "a, b. é!"
    assert one(spark, tx.replace_last(F.lit("a.b.c"), ".", "!")) == "a.b!c"
    assert one(spark, tx.fold_accents(F.lit("éàü"))) == "eau"
    assert one(spark, tx.strip_timestamps(F.lit("<|1|> hi <|22|>there"))) == "hi there"
    assert one(spark, tx.byte_ids(F.lit("é"), 3)) == [198, 172]
    assert one(spark, tx.longest_overlap(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [2, 3, 4])), 8)) == 2
    assert one(spark, tx.merged_steps(F.array(*map(F.lit, [1, 5])), F.array(*map(F.lit, [3, 4])))) == [1, 5, 6, 7]
    assert tx.lcs_merge([1, 2, 3, 4], [3, 4, 5], 3) == [1, 2, 3, 4, 5]
    parts = one(spark, tx.split_placeholders(F.lit("hi <sound> there")))
    assert [(p["type"], p["value"]) for p in parts] == [("text", "hi"), ("audio", "<sound>"), ("text", "there")]


def test_speaker_tags(spark):
    df = spark.createDataFrame([(1, "lost <|spltoken1|> hi you <|spltoken0|> yes")], "k int, t string")
    assert [(r["speaker"], r["word"]) for r in tx.tagged_words(df, "k", "t").orderBy("pos").collect()] == [(1, "hi"), (1, "you"), (0, "yes")]


CONSTRAINTS = {
    ".a == x and .b != y": lambda a, b: a == "x" and b != "y",
    "not (.a == x) xor .b == y": lambda a, b: (a != "x") != (b == "y"),
    ".a == x or .b == z": lambda a, b: a == "x" or b == "z",
    ".a == .b": lambda a, b: a == b,
}


@pytest.mark.parametrize("text", CONSTRAINTS)
def test_constraints(spark, text):
    rows = [(1, "x", "z"), (2, "x", "y"), (3, "y", "y")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r["i"] for r in df.where(pr.constraint(text)).collect()) == [i for i, a, b in rows if CONSTRAINTS[text](a, b)]


def test_constraint_errors():
    for bad in (".a ==", "(.a == b", ".a == b c"):
        with pytest.raises(ValueError):
            pr.constraint(bad)


def test_ids(spark):
    assert one(spark, pr.stem(F.lit("/a/b.c.wav"))) == "b.c"
    assert one(spark, pr.chunk_id(F.lit("s"), F.lit(2), F.lit(1.5), F.lit(2.0))) == "s_chunk0002_000001500_000003500"
    assert one(spark, pr.session_of(F.lit("s_chunk0002_1_2"))) == "s"
    assert one(spark, pr.answer_letter(F.lit("The answer is (b)."))) == "B"


def test_signal(spark):
    x = F.array(*map(F.lit, [3.0, -4.0]))
    assert one(spark, sg.rms(x)) == pytest.approx(math.sqrt(12.5))
    assert one(spark, sg.wrap_angle(F.lit(3 * math.pi / 2))) == pytest.approx(-math.pi / 2)
    assert one(spark, sg.tiled(F.array(*map(F.lit, [1, 2, 3])), F.lit(8))) == [1, 2, 3, 1, 2, 3, 2, 3]
    assert sg.prior(5, 7).sum(1) == pytest.approx(np.ones(7))
    assert sg.sdr([1, -1, 1], [1, -1, 1]) > 60 and sg.log_mel(np.sin(np.arange(4000)), 16000).shape[1] == 80
    df = spark.createDataFrame([(1, [0.1] * 50)], "k int, s array<double>")
    steps = [(1.0, "gain", {}), (0.5, "white_noise", {})]
    assert sg.augmented(df, "k", "s", steps).collect() == sg.augmented(df, "k", "s", steps).collect()


def test_formats(spark, tmp_path):
    (tmp_path / "r.rttm").write_text("SPEAKER f 1 0.00 10.00 <NA> <NA> A <NA> <NA>\nSPEAKER f 1 3 0 <NA> <NA> B <NA> <NA>\n;; no\n\n")
    out = formats.read_rttm(spark, str(tmp_path / "r.rttm")).collect()
    assert [(r["file"], r["start"], r["end"], r["speaker"]) for r in out] == [("f", 0.0, 10.0, "A")]
    line = formats.rttm_lines(formats.read_rttm(spark, str(tmp_path / "r.rttm"))).first()["value"]
    assert line == "SPEAKER f 1 0.000 10.000 <NA> <NA> A <NA> <NA>"
    (tmp_path / "a.txt").write_text("0.50 1.25 speech\nbad\n1 0 x\n")
    assert [(r["start"], r["end"]) for r in formats.read_vad_txt(spark, str(tmp_path / "a.txt")).collect()] == [(0.5, 1.75)]
    (tmp_path / "a.frame").write_text("0.1\n\n0.25\n")
    assert [(r["recording"], r["frame"], r["score"]) for r in formats.read_frames(spark, str(tmp_path / "a.frame")).orderBy("frame").collect()] == [("a", 0, 0.1), ("a", 1, 0.25)]
    (tmp_path / "m.json").write_text('{"audio_filename": "x/y.wav", "text": "hi", "duration": 2}\n')
    assert formats.read_items(spark, str(tmp_path / "m.json"), "/data").first()["audio_filepath"] == "/data/x/y.wav"
    assert formats.expand_braces("a_{08..10}_{x,y}.tar")[:3] == ["a_08_x.tar", "a_08_y.tar", "a_09_x.tar"]
    assert formats.scatter(list("abcdefg"), 2, 1) == ["d", "e", "f"]
    with pytest.raises(ValueError):
        formats.reader_of("nothing")


def test_tar_and_wav(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f'{{"i": {i}}}') for i in range(5)], "name string, body string").coalesce(1)
    shards = tar.write_tar_shards(df, str(tmp_path / "out"), "name", "body", 2).collect()
    assert sorted(r["members"] for r in shards) == [1, 2, 2]
    found = tar.read_tar(spark, str(tmp_path / "out")).collect()
    assert sorted((r["member"], bytes(r["data"]).decode()) for r in found) == [(f"s{i}.json", f'{{"i": {i}}}') for i in range(5)]
    with open(found[0]["archive"].removeprefix("file://"), "rb") as f:
        f.seek(found[0]["offset"])
        assert f.read(found[0]["size"]) == bytes(found[0]["data"])
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.array([[1000, -1000], [2000, -2000]], "<i2").tobytes())
    (tmp_path / "x.wav").write_bytes(buffer.getvalue())
    row = audio.read_wav(spark, str(tmp_path / "x.wav")).first()
    assert row["rate"] == 8000 and row["channels"][0] == pytest.approx([1000 / 32768, 2000 / 32768])


def test_endpoints():
    assert sf.utterance_end([3, 4, 9], 12, 3) == (True, 6)
    assert sf.utterance_end([], 12, 0)[0]
    assert sf.silence_end([(0.0, 1.0), (3.0, 4.0)], 0, 4.5, 1.0) == (True, 1.5)


def test_streams_equal_batch(spark, tmp_path):
    chunks = [(1, i, [i, i + 1, i + 2]) for i in range(4)] + [(2, 0, [7, 8])]
    schema = "stream long, chunk long, tokens array<int>"
    spark.createDataFrame(chunks, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = sf.stitched_tokens(stream, "stream").writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = sorted((r["stream"], r["chunk"], list(r["added"])) for r in spark.table("stitched").collect())
    finally:
        query.stop()
    assert got == [(1, 0, [0, 1, 2]), (1, 1, [3]), (1, 2, [4]), (1, 3, [5]), (2, 0, [7, 8])]


def test_numbers(spark):
    assert tx.spell(0) == "zero" and tx.spell(1_215_040) == "one million two hundred fifteen thousand forty"
    assert one(spark, tx.numbers_spelled(F.lit("Pay $1,200.50 on the 21st, 3.14 or 7"))) == "Pay one thousand two hundred dollars, fifty cents on the twenty first, three point one four or seven"
    assert tx.spell_ordinal(20) == "twentieth" and tx.spell_numbers("£1 and €0.05") == "one pound and five cents"


def test_coherence_and_splice(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=(1, 4, 50)) + 1j * rng.normal(size=(1, 4, 50))
    assert np.abs(sg.coherence(np.concatenate([s, 2 * s]))) == pytest.approx(np.ones((4, 2, 2)), abs=1e-6)
    df = spark.createDataFrame([("f", i, [float(i)]) for i in range(3)], "k string, frame int, v array<double>")
    assert [r["v"] for r in sg.spliced(df, ["k"], "v", 2).orderBy("frame").collect()] == [[0, 1], [1, 2], [2, 2]]
