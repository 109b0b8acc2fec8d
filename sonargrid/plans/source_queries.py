"""Readers and writers over the test tables: each query writes a format to the shared folder and reads it back. Times are milliseconds of the day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as sg
from ..operators import intervals as iv
from ..operators import transcripts as tr
from ..sources import audio, tar
from ..sources import formats as fm
from ..storage import fresh_path
from .registration import Registry
from .views import table

REGISTRY = Registry()
query = REGISTRY.query

REL = "rl AS (SELECT user_id, event_type, event_id, ((epoch_us(ts) // 1000) % 86400000)::BIGINT AS s, CAST(round(value * 1000) AS BIGINT) AS d FROM events)"


def relative(spark, sf_dir):
    """events as (user_id, event_type, event_id, s, d): start and duration in milliseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", F.pmod(F.floor(us / 1000), F.lit(86_400_000)).alias("s"), F.round(F.col("value") * 1000).cast("long").alias("d"))


def seconds(c: str):
    return F.col(c) / 1000.0


def milliseconds(c):
    return F.round((F.col(c) if isinstance(c, str) else c) * 1000).cast("long")


def segments(spark, sf_dir):
    """(file, speaker, start, end) in seconds."""
    return relative(spark, sf_dir).select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("speaker"), seconds("s").alias("start"), ((F.col("s") + F.col("d")) / 1000.0).alias("end"))


def written(spark, lines, name):
    path = fresh_path(spark, name)
    fm.write_lines(lines, path)
    return path


@query(f"WITH {REL} SELECT user_id::VARCHAR AS file, event_type AS speaker, s AS start, s + d AS \"end\" FROM rl WHERE d > 0")
def rttm_round_trip(spark, sf_dir):
    out = fm.read_rttm(spark, written(spark, fm.rttm_lines(segments(spark, sf_dir)), "rttm"))
    return out.select("file", "speaker", milliseconds("start").alias("start"), milliseconds("end").alias("end"))


@query(f"WITH {REL} SELECT user_id::VARCHAR AS file, max(s + d) AS duration FROM rl WHERE d > 0 GROUP BY 1")
def rttm_durations(spark, sf_dir):
    out = fm.audio_length(fm.read_rttm(spark, written(spark, fm.rttm_lines(segments(spark, sf_dir)), "rttm"), speaker="speech"))
    return out.select("file", milliseconds("duration").alias("duration"))


@query(f"WITH {REL} SELECT 'SPEAKER' AS type, user_id::VARCHAR AS file, '1' AS chnl, s AS tbeg, d AS tdur, event_type AS speaker FROM rl WHERE d > 0")
def rttm_tokens(spark, sf_dir):
    out = fm.read_rttm_tokens(spark, written(spark, fm.rttm_lines(segments(spark, sf_dir)), "rttm"))
    return out.where("ortho IS NULL AND subtype IS NULL").select("type", "file", "chnl", milliseconds("tbeg").alias("tbeg"), milliseconds("tdur").alias("tdur"), "speaker")


@query(f"WITH {REL} SELECT user_id::VARCHAR AS file, '1' AS chnl, min(s) AS start, max(s + d) AS \"end\" FROM rl GROUP BY 1")
def uem_round_trip(spark, sf_dir):
    ext = segments(spark, sf_dir).groupBy("file").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    lines = ext.select(F.format_string("%s.wav 1 %.3f %.3f", "file", "a", "b").alias("value"))
    return fm.read_uem(spark, written(spark, lines, "uem")).select("file", "chnl", milliseconds("start").alias("start"), milliseconds("end").alias("end"))


@query(f"WITH {REL} SELECT user_id::VARCHAR AS source, '1' AS channel, s AS start, d AS dur, event_id::VARCHAR AS token, 'lex' AS type, event_type AS speaker FROM rl")
def ctm_round_trip(spark, sf_dir):
    words = relative(spark, sf_dir).select(F.col("user_id").cast("string").alias("source"), seconds("s").alias("start"), seconds("d").alias("dur"), F.col("event_id").cast("string").alias("token"), F.col("event_type").alias("speaker"))
    out = fm.read_ctm(spark, written(spark, fm.ctm_lines(words), "ctm"))
    return out.where("conf IS NULL").select("source", "channel", milliseconds("start").alias("start"), milliseconds("dur").alias("dur"), "token", "type", "speaker")


@query(f"WITH {REL} SELECT user_id::VARCHAR AS recording, s AS start, s + d AS \"end\" FROM rl WHERE d > 0")
def vad_files(spark, sf_dir):
    lines = relative(spark, sf_dir).select("user_id", "event_id", F.format_string("%.3f %.3f speech", seconds("s"), seconds("d")).alias("value"))
    path = fresh_path(spark, "vad")
    fm.write_files(lines, path, "user_id", "event_id").count()
    return fm.read_vad_txt(spark, path).select("recording", milliseconds("start").alias("start"), milliseconds("end").alias("end"))


@query("SELECT user_id::VARCHAR AS recording, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS frame, ((event_id * 37) % 101) / 100.0::DOUBLE AS score FROM events")
def frame_files(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("user_id", "event_id", F.format_string("%.2f", F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0).alias("value"))
    path = fresh_path(spark, "frames")
    fm.write_files(lines, path, "user_id", "event_id", suffix=".frame").count()
    return fm.read_frames(spark, path)


@query(f"WITH {REL} SELECT user_id::VARCHAR AS recording, (event_id % 2)::INT AS channel, count(*) AS n FROM rl WHERE d > 0 GROUP BY 1, 2")
def channel_folders(spark, sf_dir):
    paths = []
    for channel in (0, 1):
        lines = relative(spark, sf_dir).where(F.col("event_id") % 2 == channel).select("user_id", "event_id", F.format_string("%.3f %.3f speech", seconds("s"), seconds("d")).alias("value"))
        paths.append(fresh_path(spark, "channel"))
        fm.write_files(lines, paths[-1], "user_id", "event_id").count()
    rows = fm.read_channels(spark, paths, fm.read_vad_txt)
    frames = rows.select("recording", "channel").distinct()
    return rows.join(fm.pair_channels(rows, frames), ["recording", "channel"]).groupBy("recording", "channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REL} SELECT user_id::VARCHAR AS session_id, event_type AS speaker, event_id::VARCHAR AS words, s AS start, s + d AS \"end\" FROM rl")
def seglst_files(spark, sf_dir):
    rows = relative(spark, sf_dir).select(
        "user_id", "event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("speaker"), F.col("event_id").cast("string").alias("words"), seconds("s").alias("start_time"), ((F.col("s") + F.col("d")) / 1000.0).alias("end_time"))).alias("value")
    )
    path = fresh_path(spark, "seglst")
    fm.write_files(rows, path, "user_id", "event_id", suffix=".seglst.json", before="[", between=",\n", after="]").count()
    out = fm.read_seglst(spark, path, 3)
    return out.select("session_id", "speaker", "words", milliseconds("start_time").alias("start"), milliseconds("end_time").alias("end"))


def manifest(spark, sf_dir):
    rows = relative(spark, sf_dir).where("d > 0").select(F.col("user_id").cast("string").alias("key"), seconds("s").alias("start"), ((F.col("s") + F.col("d")) / 1000.0).alias("end"))
    files = rows.select("key").distinct().select("key", F.concat(F.lit("/audio/"), "key", F.lit(".wav")).alias("audio_filepath"))
    return fm.manifest_rows(rows, files, "key", "speech")


@query(f"WITH {REL} SELECT '/audio/' || user_id || '.wav' AS audio_filepath, user_id::VARCHAR AS uniq_id, s AS \"offset\", d AS duration, 'speech' AS label FROM rl WHERE d > 0")
def manifest_round_trip(spark, sf_dir):
    path = fresh_path(spark, "manifest")
    fm.write_json_lines(manifest(spark, sf_dir).drop("uniq_id"), path)
    out = fm.read_manifest(spark, path)
    return out.select("audio_filepath", "uniq_id", milliseconds("offset").alias("offset"), milliseconds("duration").alias("duration"), "label")


@query(f"""WITH {REL}, w AS (SELECT user_id, s, d, greatest(ceil((d - 1500) / 750.0), 0)::BIGINT AS n FROM rl WHERE d > 0), x AS (SELECT user_id, s + unnest(generate_series(0, n)) * 750 AS a, s + d AS e FROM w)
SELECT user_id::VARCHAR AS uniq_id, a AS "offset", least(1500, e - a) AS duration FROM x WHERE least(1500, e - a) > 50""")
def embedding_manifest(spark, sf_dir):
    rows = relative(spark, sf_dir).where("d > 0").select(F.col("user_id").cast("string").alias("key"), F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    files = rows.select("key").distinct().select("key", F.concat("key", F.lit(".wav")).alias("audio_filepath"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # kept by name: a row becomes hundreds of windows
    named = rows.join(files.hint("merge"), "key").repartition(n, "key", "start")
    windows = iv.sliding_windows(named, 1500, 750, 50).select("key", "audio_filepath", (F.col("w_start") / 1000.0).alias("start"), ((F.col("w_start") + F.col("w_duration")) / 1000.0).alias("end"))
    path = fresh_path(spark, "windows")
    fm.write_json_lines(fm.manifest_rows(windows, None, "key"), path, compression="gzip")
    return fm.read_manifest(spark, path).select("uniq_id", milliseconds("offset").alias("offset"), milliseconds("duration").alias("duration"))


@query("SELECT doc_id, source || CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > 1 THEN '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) ELSE '' END AS uniq_id FROM documents WHERE source IS NOT NULL")
def unique_manifest_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.col("source").alias("uniq_id"))
    return fm.checked_unique(fm.unique_ids(rows, "uniq_id", "doc_id"), "uniq_id").select("doc_id", "uniq_id")


@query(f"""WITH {REL}, p AS (SELECT user_id, s, s + d AS e FROM rl WHERE event_id % 2 = 0 AND d > 0 UNION ALL SELECT user_id, greatest(s - 500, 0), s + d + 500 FROM rl WHERE event_id % 2 = 1),
a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM p WHERE e > s), b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a)
SELECT user_id, min(s) AS start, max(e) AS "end" FROM b GROUP BY user_id, i""")
def relaxed_intervals(spark, sf_dir):
    rows = relative(spark, sf_dir).select("user_id", "event_id", F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    out = fm.relaxed_manifest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], 500)
    return out.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN '/data/' || doc_id || '.wav' ELSE 'root/' || doc_id || '.wav' END AS audio_filepath, lang AS text, n_chars::DOUBLE AS duration, source FROM documents")
def manifest_items(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "/data/").otherwise(""), "doc_id", F.lit(".wav")).alias("audio_file"), F.col("lang").alias("normalized_text"), F.col("n_chars").cast("double").alias("duration"), "source")
    path = fresh_path(spark, "items")
    fm.write_json_lines(rows, path)
    return fm.read_items(spark, path, "root")


@query(f"WITH {REL}, x AS (SELECT user_id, max(s) AS until FROM rl GROUP BY 1) SELECT user_id::VARCHAR AS file, event_type AS speaker, s AS start, least(s + d, until) AS \"end\" FROM rl JOIN x USING (user_id) WHERE s < until")
def label_string_round_trip(spark, sf_dir):
    rows = segments(spark, sf_dir)
    until = rows.groupBy("file").agg(F.max("start").alias("until"))
    out = fm.parse_labels(fm.label_strings(rows).join(until, "file"), ["file"], "until")
    return out.select("file", "speaker", milliseconds("start").alias("start"), milliseconds("end").alias("end"))


@query("SELECT conv_id || '_' || turn || '.json' AS member, role, text FROM conversations")
def tar_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("name"), F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("payload"), "role")
    path = fresh_path(spark, "tar")
    tar.write_tar_shards(rows, path, "name", "payload", 300).count()
    meta = rows.select(F.concat("name", F.lit(".json")).alias("file"), "role")
    found = tar.join_manifest(tar.read_tar(spark, path), meta, "file")
    return found.select("member", "role", F.from_json(F.col("data").cast("string"), "text string")["text"].alias("text"))


@query("SELECT conv_id || '_' || turn || '.json' AS member, strlen('{\"role\":\"' || role || '\"}') AS size FROM conversations")
def tar_index(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("name"), F.to_json(F.struct("role")).alias("payload"))
    path = fresh_path(spark, "tar")
    tar.write_tar_shards(rows, path, "name", "payload", 500).count()
    return tar.read_tar(spark, path, payload=False).where("data IS NULL AND offset >= 512").select("member", "size")


def dialogues(spark, sf_dir):
    """One row per conversation: id and its turns (from, value) in order; every third turn holds a sound."""
    c = table(spark, sf_dir, "conversations")
    value = F.concat(F.when(F.col("turn") % 3 == 2, "<sound>").otherwise(""), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    turn = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), value.alias("value"))
    return c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


SHARED = """r AS (SELECT conv_id::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END) - 1 AS turn, turn % 3 = 2 AS sound, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, length(coalesce(text, ''))::VARCHAR AS value FROM conversations),
sg AS (SELECT id, turn::INT AS turn, 0 AS part, role, 'audio' AS type, '<sound>' AS value FROM r WHERE sound UNION ALL SELECT id, turn::INT, sound::INT, role, 'text', value FROM r)"""


@query(f"WITH {SHARED} SELECT * FROM sg")
def sharegpt_round_trip(spark, sf_dir):
    path = fresh_path(spark, "sharegpt")
    fm.write_json_lines(dialogues(spark, sf_dir), path)
    out = fm.read_sources(spark, [{"type": "share_gpt", "paths": path}])
    return out.select("id", "turn", "part", "role", "type", "value")


@query(f"WITH {SHARED} SELECT id AS sample, turn, part, role, type, value FROM sg")
def sharegpt_archives(spark, sf_dir):
    rows = dialogues(spark, sf_dir).select("id", F.to_json(F.struct("id", "conversations")).alias("payload"))
    path = fresh_path(spark, "archives")
    tar.write_tar_shards(rows, path, "id", "payload", 50).count()
    out = fm.read_sources(spark, [{"type": "share_gpt_webdataset", "data_dir": path}])
    return out.select("sample", "turn", "part", "role", "type", "value")


@query("""WITH r AS (SELECT conv_id, turn, role, length(coalesce(text, ''))::VARCHAR AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 'User' ELSE 'Bot' END) AS place FROM conversations), c AS (SELECT DISTINCT conv_id, conv_id % 2 = 0 AS system FROM r)
SELECT (place - 1 + system::INT)::INT AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, value, count(*) AS n FROM r JOIN c USING (conv_id) GROUP BY 1, 2, 3 UNION ALL SELECT 0, 'system', 'be ' || conv_id, 1 FROM c WHERE system""")
def instruction_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.when(F.col("role") == "user", "User").otherwise("Bot").alias("from"), F.length(F.coalesce("text", F.lit(""))).cast("string").alias("value"))
    rows = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))
    rows = rows.select(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("be "), "conv_id")).otherwise("").alias("system"), F.lit("User").alias("mask"), "conversations")
    path = fresh_path(spark, "sft")
    fm.write_json_lines(rows, path)
    out = fm.read_sources(spark, [{"type": "sft_jsonl", "paths": path}])
    return out.groupBy("turn", "role", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS place FROM conversations) SELECT conv_id::VARCHAR AS id, place::INT AS turn, role, CASE WHEN turn % 2 = 1 THEN 'audio' ELSE 'text' END AS type, CASE WHEN turn % 2 = 1 THEN '[audio]' ELSE 'said' END AS text,
CASE WHEN turn % 2 = 1 THEN 'root/' || conv_id || '_' || turn || '.wav' END AS audio, CASE WHEN turn % 2 = 1 THEN 0.0::DOUBLE END AS "offset", CASE WHEN turn % 2 = 1 THEN turn + 0.5::DOUBLE END AS duration FROM r""")
def conversation_parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sound = F.col("turn") % 2 == 1
    turn = F.struct("turn", "role", F.when(sound, "audio").otherwise("text").alias("type"), F.when(sound, F.concat_ws("", F.concat_ws("_", "conv_id", "turn"), F.lit(".wav"))).otherwise("said").alias("value"), F.when(sound, F.col("turn") + 0.5).alias("duration"))
    fields = ("role", "type", "value", "duration")
    rows = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(*(t[f].alias("from" if f == "role" else f) for f in fields))).alias("conversations"))
    path = fresh_path(spark, "conversations")
    fm.write_json_lines(rows, path)
    return fm.read_sources(spark, [{"type": "conversation_jsonl", "paths": path, "audio_root": "root"}]).select("id", "turn", "role", "type", "text", "audio", "offset", "duration")


@query("SELECT 0 AS file, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS line, doc_id || ' ' || coalesce(lang, '-') AS source, coalesce(source, '-') AS target, 'en' AS source_lang, 'de' AS target_lang FROM documents")
def text_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    paths = {}
    for side, value in (("source", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("-")))), ("target", F.coalesce("source", F.lit("-")))):
        path = fresh_path(spark, side)
        fm.write_files(d.select(F.lit("all").alias("name"), "doc_id", value.alias("value")), path, "name", "doc_id").count()
        paths[f"{side}_paths"] = [f"{path}/all.txt"]
    return fm.read_sources(spark, [{"type": "txt_pair", **paths, "source_language": "en", "target_language": "de"}])


@query("SELECT text, count(*) AS n FROM (SELECT coalesce(source, '-') || ' ' || coalesce(lang, '-') AS text FROM documents) GROUP BY 1")
def text_source(spark, sf_dir):
    path = written(spark, table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))).alias("value")), "txt")
    return fm.read_sources(spark, [{"type": "txt", "paths": path, "language": "en"}]).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT text, lang, count(*) AS n FROM (SELECT source AS text, lang FROM documents) WHERE text IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT role, 'xx', count(*) FROM conversations GROUP BY 1")
def nested_sources(spark, sf_dir):
    parquet, lines = fresh_path(spark, "parquet"), fresh_path(spark, "jsonl")
    table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "lang").write.parquet(parquet)
    fm.write_json_lines(table(spark, sf_dir, "conversations").select(F.col("role").alias("text"), F.lit("xx").alias("lang")), lines)
    config = [{"type": "group", "input_cfg": [{"type": "parquet", "path": parquet, "text_field": "source", "lang_field": "lang"}]}, {"type": "txt_jsonl", "paths": lines}]
    return fm.read_sources(spark, config).groupBy("text", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REL} SELECT event_id::VARCHAR AS cut, user_id::VARCHAR AS recording, s AS start, d AS length, event_type AS speaker, 'w' || event_id AS text FROM rl")
def cut_manifests(spark, sf_dir):
    r = relative(spark, sf_dir)
    sup = F.struct(F.col("event_id").cast("string").alias("id"), F.lit(0.0).alias("start"), seconds("d").alias("duration"), F.col("event_type").alias("speaker"), F.concat(F.lit("w"), "event_id").alias("text"))
    rows = r.select(F.col("event_id").cast("string").alias("id"), seconds("s").alias("start"), seconds("d").alias("duration"), F.lit(0).alias("channel"), F.array(sup).alias("supervisions"), F.struct(F.col("user_id").cast("string").alias("id"), F.lit(16000).alias("sampling_rate")).alias("recording"))
    path = fresh_path(spark, "cuts")
    rows.write.option("compression", "gzip").json(path)
    out = fm.read_sources(spark, [{"type": "cuts", "cuts_path": path}])
    return out.select("cut", "recording", milliseconds("start").alias("start"), milliseconds("length").alias("length"), "speaker", "text")


@query("SELECT 'shard_' || lpad(i::VARCHAR, 2, '0') || '_' || s || '.tar' AS path, (((i - 7) * 2 + (s = 'b')::INT) // 3)::INT AS rank FROM range(7, 13) t(i), (SELECT unnest(['a', 'b']) AS s)")
def shards_of_ranks(spark, sf_dir):
    paths = fm.expand_braces("shard_{07..12}__OP_a,b_CL_.tar".replace("__OP_", "_{").replace("_CL_", "}"))
    rows = [(p, rank) for rank in range(4) for p in fm.scatter(paths, 4, rank)]
    return spark.createDataFrame(rows, "path string, rank int")


@query("SELECT vec_id::VARCHAR AS recording, 8000 AS rate, i::INT AS place, round(least(greatest(round_even(embedding[i + 1]::DOUBLE / 4 * 32768, 0), -32768), 32767) / 32768, 9) + 0.0 AS sample FROM embeddings, range(0, 32) t(i)")
def wav_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    half = lambda sign: F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double") / 4 * sign)
    rows = e.select("vec_id", F.array(half(1), half(1)).alias("channels"))
    path = fresh_path(spark, "wav")
    fm.write_files(rows.select("vec_id", audio.wav_bytes("channels", 8000).alias("value")), path, "vec_id", suffix=".wav").count()
    out = audio.read_wav(spark, path)
    return out.select("recording", "rate", F.posexplode(sg.mono(F.col("channels"))).alias("place", "x")).select("recording", "rate", "place", F.round("x", 9).alias("sample"))


# small operators on manifests and segments


@query(f"WITH {REL} SELECT user_id, s AS start, d AS duration FROM rl WHERE user_id IN (SELECT user_id FROM rl WHERE d > 100000)")
def sessions_with_speech(spark, sf_dir):
    r = relative(spark, sf_dir).select("user_id", F.col("s").alias("start"), F.col("d").alias("duration"))
    return fm.with_speech(r, r.where("duration > 100000"), "user_id")


@query(f"WITH {REL} SELECT bool_and(s <= s + d) AS ordered FROM rl")
def ranges_in_order(spark, sf_dir):
    return fm.ranges_in_order(relative(spark, sf_dir).select(F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end")))


@query("SELECT doc_id, source, coalesce(CASE WHEN quality = 1 THEN 'good' END, '') AS pred_text FROM documents LEFT JOIN labels USING (doc_id)")
def manifest_with_predictions(spark, sf_dir):
    found = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("good").alias("text"))
    return fm.with_predictions(table(spark, sf_dir, "documents").select("doc_id", "source"), found, "doc_id")


@query(f"""WITH {REL}, h AS (SELECT user_id, event_type, s, s + d AS e FROM rl WHERE event_id % 2 = 1), r AS (SELECT user_id, event_type, s, s + d AS e FROM rl WHERE event_id % 2 = 0), u AS (SELECT user_id, max(e) AS m FROM r GROUP BY 1)
SELECT h.user_id, 'hypothesis' AS side, event_type AS speaker, s AS start, least(e, m) AS "end" FROM h JOIN u USING (user_id) WHERE s < least(e, m) UNION ALL SELECT user_id, 'reference', event_type, s, e FROM r WHERE user_id IN (SELECT user_id FROM h)""")
def supervision_pairs(spark, sf_dir):
    rows = relative(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("speaker"), F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    ref = rows.where("event_id % 2 = 0")
    return fm.supervisions(rows.where("event_id % 2 = 1"), ref, "user_id", fm.audio_length(ref, "user_id"))


@query("SELECT a.doc_id AS audio_1, b.doc_id AS audio_2, a.lang = b.lang AS label, a.n_chars AS duration_1, b.n_chars AS duration_2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.lang IS NOT NULL AND b.lang IS NOT NULL")
def audio_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    other = d.select((F.col("doc_id") - 1).alias("audio_1"), F.col("doc_id").alias("audio_2"), F.col("lang").alias("other"))
    pairs = d.select(F.col("doc_id").alias("audio_1"), "lang").join(other, "audio_1").where("lang IS NOT NULL AND other IS NOT NULL").select("audio_1", "audio_2", (F.col("lang") == F.col("other")).alias("label"))
    return fm.audio_pairs(pairs, d.select(F.col("doc_id").alias("audio_filepath"), F.col("n_chars").alias("duration")))


@query("SELECT page_id, url FROM pages WHERE regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') = (SELECT regexp_replace(regexp_extract(min(url), '([^/]*)$', 1), '\\.[^.]*$', '') FROM pages) ORDER BY url LIMIT 1")
def item_of_session(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    first = pages.agg(F.min("url").alias("u")).first()["u"]
    return fm.item_of_session(pages, first.rpartition("/")[2].rpartition(".")[0] or first.rpartition("/")[2], "url")


@query("WITH t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark) SELECT doc_id, source, item_id FROM documents JOIN t ON t.pos = doc_id")
def lines_side_by_side(spark, sf_dir):
    from pyspark.sql import Window

    side = table(spark, sf_dir, "benchmark").select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("pos"))  # a few items
    return fm.positional_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "doc_id", "source"), side).select("doc_id", "source", "item_id")


@query(f"WITH {REL} SELECT user_id, event_type AS speaker, dense_rank() OVER (PARTITION BY user_id ORDER BY f, event_type) - 1 AS local FROM (SELECT user_id, event_type, min((s, s + d)) AS f FROM rl GROUP BY 1, 2)")
def speaker_numbers(spark, sf_dir):
    rows = relative(spark, sf_dir).select("user_id", F.col("event_type").alias("speaker"), F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    return tr.local_speakers(rows, ["user_id"]).select("user_id", "speaker", F.col("local_speaker").cast("long").alias("local")).distinct()
