"""Readers and writers of timeline and manifest formats, as lazy DataFrames over Spark's own text, JSON and Parquet sources."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import resolved, stem
from ..operators.intervals import merge

MANIFEST = "audio_filepath STRING, offset DOUBLE, duration DOUBLE, label STRING, text STRING, num_speakers INT, rttm_filepath STRING, uem_filepath STRING, ctm_filepath STRING, uniq_id STRING"
SEGLST = "session_id STRING, speaker STRING, words STRING, start_time DOUBLE, end_time DOUBLE, eou_prob DOUBLE, eou_pred BOOLEAN"

# Names under which manifests carry the audio path and the text.
AUDIO_NAMES = ("audio_file", "audio_filename", "audio_filepath", "audio_path")
TEXT_NAMES = ("text", "normalized_text", "text_filepath")


def _fields(spark: SparkSession, path) -> DataFrame:
    """Lines that aren't blank or comments as arrays of fields, with the file's stem."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), stem(F.input_file_name()).alias("stem"))
    return lines.where("value <> '' AND NOT startswith(value, ';;')").select("stem", F.split("value", r"\s+").alias("f"))


def read_vad_txt(spark: SparkSession, path) -> DataFrame:
    """Lines "start duration label" to (recording, start, end); short lines and durations of 0 or less go."""
    rows = _fields(spark, path).where(F.size("f") >= 2).select(F.col("stem").alias("recording"), F.col("f")[0].cast("double").alias("start"), F.col("f")[1].cast("double").alias("d"))
    return rows.where("d > 0").select("recording", "start", (F.col("start") + F.col("d")).alias("end"))


def read_frames(spark: SparkSession, path) -> DataFrame:
    """One score per line to (recording, frame, score); files are read whole, so that frame numbers follow the lines."""
    files = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("recording"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("x"))
    return files.select("recording", F.posexplode("x").alias("frame", "s")).select("recording", "frame", F.col("s").cast("double").alias("score"))


def read_channels(spark: SparkSession, paths: list[str], read) -> DataFrame:
    """A folder per channel, read by the function given, with the channel's number."""
    out = None
    for i, p in enumerate(paths):
        one = read(spark, p).withColumn("channel", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def pair_channels(intervals: DataFrame, frames: DataFrame, check: bool = True) -> DataFrame:
    """(recording, channel) of both sides; with check, one that only one side has is an error when read."""
    a = intervals.select("recording", "channel").distinct().withColumn("i", F.lit(True))
    b = frames.select("recording", "channel").distinct().withColumn("f", F.lit(True))
    both = a.join(b, ["recording", "channel"], "full")
    if check:
        fine = F.when(F.col("i") & F.col("f"), F.col("recording")).otherwise(F.raise_error(F.concat(F.lit("intervals or frames are missing for "), "recording", F.lit(" channel "), F.col("channel").cast("string"))))
        both = both.withColumn("recording", fine)
    return both.select("recording", "channel")


def read_rttm(spark: SparkSession, path, least_fields: int = 8, speaker: str | None = None) -> DataFrame:
    """SPEAKER lines to (file, chnl, start, end, speaker); durations of 0 or less go; speaker replaces all names if given."""
    rows = _fields(spark, path).where((F.size("f") >= least_fields) & (F.col("f")[0] == "SPEAKER"))
    who = F.lit(speaker) if speaker else F.col("f")[7]
    rows = rows.select("stem", F.col("f")[1].alias("file"), F.col("f")[2].alias("chnl"), F.col("f")[3].try_cast("double").alias("start"), F.col("f")[4].try_cast("double").alias("dur"), who.alias("speaker"))
    return rows.where("dur > 0").select("stem", "file", "chnl", "start", (F.col("start") + F.col("dur")).alias("end"), "speaker")


def read_rttm_tokens(spark: SparkSession, path) -> DataFrame:
    """All token types: (type, file, chnl, tbeg, tdur, ortho, subtype, speaker); <NA> is null."""
    f = lambda i: F.when(F.col("f")[i] != "<NA>", F.col("f")[i])
    return _fields(spark, path).where(F.size("f") >= 8).select(
        F.upper(F.col("f")[0]).alias("type"), F.col("f")[1].alias("file"), F.col("f")[2].alias("chnl"), f(3).try_cast("double").alias("tbeg"), f(4).try_cast("double").alias("tdur"), f(5).alias("ortho"), f(6).alias("subtype"), f(7).alias("speaker")
    )


def read_uem(spark: SparkSession, path) -> DataFrame:
    """file channel begin end."""
    rows = _fields(spark, path).where(F.size("f") >= 4)
    return rows.select(F.regexp_replace(F.col("f")[0], r"\.[^.]*$", "").alias("file"), F.col("f")[1].alias("chnl"), F.col("f")[2].cast("double").alias("start"), F.col("f")[3].cast("double").alias("end"))


def read_ctm(spark: SparkSession, path) -> DataFrame:
    """source channel start duration token [confidence type speaker]."""
    f = lambda i: F.when(F.size("f") > i, F.nullif(F.try_element_at("f", F.lit(i + 1)), F.lit("NA")))
    return _fields(spark, path).where(F.size("f") >= 5).select(
        F.col("f")[0].alias("source"), F.col("f")[1].alias("channel"), F.col("f")[2].cast("double").alias("start"), F.col("f")[3].cast("double").alias("dur"), F.col("f")[4].alias("token"), f(5).try_cast("double").alias("conf"), f(6).alias("type"), f(7).alias("speaker")
    )


def read_seglst(spark: SparkSession, path, digits: int | None = None) -> DataFrame:
    out = spark.read.option("multiLine", True).schema(SEGLST).json(path)
    return out.withColumns({c: F.round(c, digits) for c in ("start_time", "end_time")}) if digits is not None else out


def read_manifest(spark: SparkSession, path, schema: str = MANIFEST, strict: bool = True) -> DataFrame:
    """JSON lines; uniq_id falls back to the audio file's stem. With strict, a line that isn't JSON raises when read."""
    out = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if "uniq_id" in out.columns:
        out = out.withColumn("uniq_id", F.coalesce("uniq_id", stem(F.col("audio_filepath"))))
    return out


def read_items(spark: SparkSession, path, folder: str = "") -> DataFrame:
    """Manifests with any of the usual names, as (audio_filepath, text, duration, all other columns); a row without duration raises when read."""
    df = spark.read.json(path)
    pick = lambda names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    length = F.coalesce(F.col("duration").cast("double"), F.raise_error(F.lit("a manifest row has no duration")).cast("double"))
    rest = [c for c in df.columns if c not in (*AUDIO_NAMES, *TEXT_NAMES, "duration")]
    return df.select(resolved(pick(AUDIO_NAMES), folder).alias("audio_filepath"), pick(TEXT_NAMES).alias("text"), length.alias("duration"), *rest)


def checked_unique(df: DataFrame, key: str) -> DataFrame:
    """df; a key that occurs twice raises when read."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fine = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} isn't unique: "), F.col(key).cast("string"))))
    return df.join(counts, key).withColumn(key, fine).drop("_n")


def unique_ids(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Repeated keys get _1, _2 ... in order."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("_i", i).withColumn(key, F.when(F.col("_i") > 0, F.concat_ws("_", F.col(key), F.col("_i").cast("string"))).otherwise(F.col(key))).drop("_i")


def relaxed_manifest(base: DataFrame, candidates: DataFrame, keys: list[str], pad_by: float) -> DataFrame:
    """Base intervals with padded candidates, merged."""
    wide = candidates.select(*keys, F.greatest(F.col("start") - pad_by, F.lit(0.0)).alias("start"), (F.col("end") + pad_by).alias("end"))
    return merge(base.select(*keys, "start", "end").unionByName(wide), keys)


def manifest_rows(intervals: DataFrame, audio: DataFrame | None, key: str, label: str = "UNK", digits: int = 5) -> DataFrame:
    """Intervals as manifest rows (audio_filepath, offset, duration, label, uniq_id). Without audio the intervals have audio_filepath already.

    Neither side is broadcast: how many windows intervals were cut into is in no estimate.
    """
    rows = intervals.join(audio.hint("merge"), key) if audio is not None else intervals
    return rows.select("audio_filepath", F.round("start", digits).alias("offset"), F.round(F.col("end") - F.col("start"), digits).alias("duration"), F.lit(label).alias("label"), F.col(key).alias("uniq_id"))


def write_json_lines(df: DataFrame, path: str, *order: str, compression: str = "none") -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path, compression=compression)


def rttm_lines(segments: DataFrame, digits: int = 3) -> DataFrame:
    """(value): SPEAKER lines of (file, start, end, speaker); segments without length go."""
    n = lambda c: F.format_string(f"%.{digits}f", c.cast("double"))
    rows = segments.where("end > start")
    return rows.select(F.concat_ws(" ", F.lit("SPEAKER"), "file", F.lit("1"), n(F.col("start")), n(F.col("end") - F.col("start")), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>")).alias("value"))


def label_strings(segments: DataFrame, digits: int = 3) -> DataFrame:
    """(file, value): "start end speaker", both times rounded."""
    return segments.select("file", F.concat_ws(" ", F.round("start", digits).cast("string"), F.round("end", digits).cast("string"), "speaker").alias("value"))


def parse_labels(df: DataFrame, keys: list[str], until: str | None = None) -> DataFrame:
    """"start end speaker" strings (value) to segments, cut at the column until; what begins past it goes."""
    f = F.split(F.trim("value"), r"\s+", 3)
    out = df.select(*keys, *([until] if until else []), f[0].cast("double").alias("start"), f[1].cast("double").alias("end"), f[2].alias("speaker"))
    return out.where(F.col("start") < F.col(until)).withColumn("end", F.least("end", until)).drop(until) if until else out


def ctm_lines(words: DataFrame) -> DataFrame:
    """(value) of (source, channel, start, dur, token, conf, type, speaker); missing fields are NA, negative times raise."""
    sure = F.when((F.col("start") >= 0) & (F.col("dur") >= 0), F.format_string("%.3f", F.col("start").cast("double"))).otherwise(F.raise_error(F.lit("a token has a negative time")))
    na = lambda c, other="NA": F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in words.columns else F.lit(other)
    return words.select(F.concat_ws(" ", "source", na("channel", "1"), sure, F.format_string("%.3f", F.col("dur").cast("double")), "token", na("conf"), na("type", "lex"), na("speaker")).alias("value"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    (lines.orderBy(*order) if order else lines).select("value").write.mode("overwrite").text(path)


def expand_braces(pattern: str) -> list[str]:
    """a_{0..3}.tar and a_{x,y}.tar (also with _OP_ and _CL_ for braces) to all names."""
    text = pattern.replace("_OP_", "{").replace("_CL_", "}")
    parts = re.split(r"\{([^{}]*)\}", text)
    options = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            options.append([p])
        elif m := re.fullmatch(r"(\d+)\.\.(\d+)", p):
            width = len(m[1]) if m[1].startswith("0") else 0
            options.append([str(n).zfill(width) for n in range(int(m[1]), int(m[2]) + 1)])
        else:
            options.append(p.split(","))
    return ["".join(x) for x in product(*options)]


def scatter(paths: list[str], world: int, rank: int) -> list[str]:
    """A rank's equal share of the shards; the remainder is read by none, as data-parallel readers do."""
    n = len(paths) // world
    return paths[rank * n : (rank + 1) * n]


def positional_pairs(left: DataFrame, right: DataFrame, key: str = "pos") -> DataFrame:
    """Rows of two line tables with one number, as far as the shorter goes."""
    return left.join(right, key)


def sharegpt_turns(df: DataFrame, key: str, conversations: str = "conversations") -> DataFrame:
    """Arrays of (from, value) to (key, turn, role, type, value), audio placeholders apart."""
    from ..functions.text import split_placeholders

    rows = df.select(key, F.posexplode(conversations).alias("turn", "t"))
    role = F.when(F.lower("t.from").isin("human", "user"), "user").otherwise("assistant")
    return rows.select(key, "turn", role.alias("role"), F.posexplode(split_placeholders(F.col("t.value"))).alias("part", "p")).select(key, "turn", "part", "role", "p.type", "p.value")


def write_files(rows: DataFrame, folder: str, name: str, *order: str, suffix: str = ".txt", before: str = "", between: str = "\n", after: str = "\n") -> DataFrame:
    """A file of folder for each name with its rows' values, in order: (name, n) of the files written. A file's rows meet in one task; a repeated task writes the same file again."""
    kind = rows.schema[name].dataType.simpleString()

    def run(key, group):
        import pyarrow as pa
        import pyarrow.fs as pafs

        files, top = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(top, recursive=True)
        group = group.sort_by([(c, "ascending") for c in order]) if order else group
        values = group["value"].to_pylist()
        with files.open_output_stream(f"{top}/{key[0].as_py()}{suffix}") as f:
            f.write(b"".join(values) if values and isinstance(values[0], bytes) else (before + between.join(values) + after).encode())
        return pa.table({name: pa.array([key[0].as_py()], group.schema.field(name).type), "n": pa.array([len(values)], pa.int64())})

    return rows.select(name, "value", *order).groupBy(name).applyInArrow(run, f"`{name}` {kind}, n long")


def audio_length(segments: DataFrame, key: str = "file") -> DataFrame:
    """(key, duration): the last end of a recording's segments."""
    return segments.groupBy(key).agg(F.max("end").alias("duration"))


def item_of_session(manifest: DataFrame, session: str, *paths: str) -> DataFrame:
    """The first row, in order of its paths, in which any of them has the session as its stem."""
    same = None
    for p in paths:
        one = stem(F.col(p)) == session
        same = one if same is None else same | one
    return manifest.where(same).orderBy(*paths).limit(1)


def with_speech(manifest: DataFrame, vad: DataFrame, key: str) -> DataFrame:
    """Sessions of the manifest that have speech of some length; none at all is an error when read."""
    kept = manifest.join(vad.where("duration > 0").select(key).distinct(), key, "left_semi")
    found = kept.agg(F.count(F.lit(1)).alias("_n"))
    return kept.crossJoin(F.broadcast(found)).where(F.when(F.col("_n") > 0, True).otherwise(F.raise_error(F.lit("no session has speech")).cast("boolean"))).drop("_n")  # one row


def ranges_in_order(df: DataFrame) -> DataFrame:
    """(ordered): whether every range's end is at or after its start; true without rows."""
    return df.agg(F.coalesce(F.bool_and(F.col("start") <= F.col("end")), F.lit(True)).alias("ordered"))


def with_predictions(manifest: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The manifest with pred_text, empty where there is no prediction."""
    return manifest.join(predictions.select(key, F.col("text").alias("pred_text")), key, "left").na.fill("", ["pred_text"])


def supervisions(hypothesis: DataFrame, reference: DataFrame, key: str, durations: DataFrame | None = None) -> DataFrame:
    """Segments of both sides of the sessions that both have: (key, side, speaker, start, end); a hypothesis ends with the audio (key, duration)."""
    both = hypothesis.select(key).distinct().join(reference.select(key).distinct(), key)
    hyp = hypothesis.select(key, F.lit("hypothesis").alias("side"), "speaker", "start", "end")
    if durations is not None:
        hyp = hyp.join(durations.select(key, "duration"), key, "left").withColumn("end", F.least("end", F.coalesce("duration", "end"))).where("start < end").drop("duration")
    return hyp.unionByName(reference.select(key, F.lit("reference").alias("side"), "speaker", "start", "end")).join(both, key, "left_semi")


def audio_pairs(pairs: DataFrame, audio: DataFrame) -> DataFrame:
    """Labelled pairs (audio_1, audio_2, label) with the duration of both files; pairs with an unknown file go."""
    side = lambda n: audio.select(F.col("audio_filepath").alias(f"audio_{n}"), F.col("duration").alias(f"duration_{n}"))
    return pairs.join(side(1), "audio_1").join(side(2), "audio_2")


READERS: dict[str, object] = {}


def source_type(*names: str):
    """Register a reader (spark, entry) -> DataFrame under its type's names."""
    def keep(f):
        for n in names:
            if n in READERS:
                raise ValueError(f"there is a source type {n} already")
            READERS[n] = f
        return f

    return keep


def reader_of(name: str):
    if name not in READERS:
        raise ValueError(f"no such source type: {name}; there are {sorted(READERS)}")
    return READERS[name]


@source_type("manifest")
def _manifest_source(spark: SparkSession, entry: dict) -> DataFrame:
    return read_manifest(spark, expand_braces(entry["manifest_filepath"]))


@source_type("parquet")
def _parquet_source(spark: SparkSession, entry: dict) -> DataFrame:
    df = spark.read.parquet(*[entry["path"]] if isinstance(entry["path"], str) else entry["path"])
    return df.select(*(F.col(entry[c]).alias(c.removesuffix("_field")) for c in ("audio_field", "text_field", "duration_field", "lang_field") if entry.get(c)), *(c for c in entry.get("columns", [])))


@source_type("txt")
def _text_source(spark: SparkSession, entry: dict) -> DataFrame:
    return spark.read.text(entry["paths"]).select(F.col("value").alias("text"), F.lit(entry.get("language")).alias("lang"))


@source_type("txt_jsonl", "json")
def _json_source(spark: SparkSession, entry: dict) -> DataFrame:
    return spark.read.json(entry["paths"])


SFT = "system STRING, mask STRING, type STRING, conversations ARRAY<STRUCT<from: STRING, value: STRING>>"
CONVERSATION = "id STRING, conversations ARRAY<STRUCT<from: STRING, type: STRING, value: STRING, duration: DOUBLE, offset: DOUBLE>>"


def sft_turns(df: DataFrame, key: str) -> DataFrame:
    """Instruction rows (system, mask, conversations of (from, value)) to (key, turn, role, value): the system text first if there is any; who is masked is the user."""
    said = F.transform("conversations", lambda t: F.struct(F.when(t["from"] == F.coalesce("mask", F.lit("User")), "user").otherwise("assistant").alias("role"), t["value"].alias("value")))
    system = F.when(F.trim(F.coalesce("system", F.lit(""))) != "", F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("value")))).otherwise(F.expr("cast(array() as array<struct<role: string, value: string>>)"))
    return df.select(key, F.posexplode(F.concat(system, said)).alias("turn", "t")).select(key, "turn", "t.*")


def conversation_parts(df: DataFrame, key: str, folder: str = "", locator: str = "[audio]") -> DataFrame:
    """Conversations of (from, type, value, duration, offset) to (key, turn, role, type, text, audio, offset, duration): an audio turn's value is its path, its text the locator."""
    rows = df.select(key, F.posexplode("conversations").alias("turn", "t"))
    audio = F.lower("t.type") == "audio"
    return rows.select(
        key, "turn", F.lower("t.from").alias("role"), F.lower("t.type").alias("type"), F.when(audio, F.lit(locator)).otherwise(F.col("t.value")).alias("text"),
        F.when(audio, resolved(F.col("t.value"), folder) if folder else F.col("t.value")).alias("audio"), F.when(audio, F.coalesce("t.offset", F.lit(0.0))).alias("offset"), F.when(audio, F.col("t.duration")).alias("duration"),
    )


@source_type("sft_jsonl")
def _sft_source(spark: SparkSession, entry: dict) -> DataFrame:
    df = spark.read.schema(SFT).json(entry["paths"])
    return sft_turns(df.withColumn("example", F.monotonically_increasing_id()), "example")


@source_type("conversation_jsonl", "multimodal_conversation")
def _conversation_source(spark: SparkSession, entry: dict) -> DataFrame:
    return conversation_parts(spark.read.schema(CONVERSATION).json(entry["paths"]), "id", entry.get("audio_root", ""), entry.get("audio_locator_tag", "[audio]"))


SHARE_GPT = "id STRING, sound STRING, duration DOUBLE, conversations ARRAY<STRUCT<from: STRING, value: STRING>>"


@source_type("share_gpt")
def _share_gpt_source(spark: SparkSession, entry: dict) -> DataFrame:
    df = spark.read.schema(SHARE_GPT).json(entry["paths"])
    return sharegpt_turns(df, "id").join(df.select("id", "sound", "duration"), "id").withColumns({c: F.when(F.col("type") == "audio", F.col(c)) for c in ("sound", "duration")})


@source_type("share_gpt_webdataset")
def _share_gpt_archives(spark: SparkSession, entry: dict) -> DataFrame:
    """Archives with a JSON and an audio member for each sample: turns with the audio's bytes."""
    from .tar import pairs_of_members, read_tar

    samples = pairs_of_members(read_tar(spark, entry["data_dir"]), entry.get("suffix", ".wav"))
    rows = samples.withColumn("s", F.from_json("json", SHARE_GPT)).select("archive", "sample", "data", "s.conversations")
    turns = sharegpt_turns(rows.select(F.struct("archive", "sample").alias("k"), "conversations"), "k").select("k.*", "turn", "part", "role", "type", "value")
    return turns.join(rows.select("archive", "sample", "data"), ["archive", "sample"]).withColumn("data", F.when(F.col("type") == "audio", F.col("data")))


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line, text) of text files: file counts the paths in the order given, line from 0. A file is read whole, by one task."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        whole = spark.read.text(path, wholetext=True)
        one = whole.select(F.lit(i).alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("line", "text"))
        out = one if out is None else out.unionByName(one)
    return out


@source_type("txt_pair")
def _pair_source(spark: SparkSession, entry: dict) -> DataFrame:
    """Lines of source and target files of one number: (file, line, source, target, their languages)."""
    a, b = (numbered_lines(spark, entry[f"{side}_paths"]).withColumnRenamed("text", side) for side in ("source", "target"))
    return a.join(b, ["file", "line"]).withColumns({f"{side}_lang": F.lit(entry.get(f"{side}_language")) for side in ("source", "target")})


CUT = "id STRING, start DOUBLE, duration DOUBLE, channel INT, supervisions ARRAY<STRUCT<id: STRING, start: DOUBLE, duration: DOUBLE, speaker: STRING, text: STRING, language: STRING>>, recording STRUCT<id: STRING, sampling_rate: INT, duration: DOUBLE>"


@source_type("cuts")
def _cut_source(spark: SparkSession, entry: dict) -> DataFrame:
    """Cut manifests (JSON lines, gzipped or not) as one row per supervision on the recording's axis; a cut without one keeps a row."""
    df = spark.read.schema(CUT).json(entry["cuts_path"])
    rows = df.select(F.col("id").alias("cut"), F.col("recording.id").alias("recording"), "start", "duration", F.explode_outer("supervisions").alias("s"))
    return rows.select("cut", "recording", "duration", (F.col("start") + F.coalesce("s.start", F.lit(0.0))).alias("start"), F.coalesce("s.duration", "duration").alias("length"), "s.speaker", "s.text", "s.language")


def read_sources(spark: SparkSession, config: list[dict]) -> DataFrame:
    """Union of a nested source configuration, tags passed down to the rows."""
    from ..operators.sampling import combine

    return combine(config, lambda e: reader_of(e["type"])(spark, e))
