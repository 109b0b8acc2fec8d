"""Transcripts and conversations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import metrics as me
from ..operators import sampling as sa
from ..operators import statistics as st
from ..operators import transcripts as tr
from ..operators import vectors as ve
from .registration import Registry
from .views import INTERVALS, TURNS, intervals, table, turns

REGISTRY = Registry()
query = REGISTRY.query


def words(spark, sf_dir):
    return intervals(spark, sf_dir).select("user_id", "start", "end", F.col("channel").alias("speaker"), F.col("event_id").cast("string").alias("word"))


@query(f"WITH {INTERVALS} SELECT user_id, channel AS speaker, string_agg(event_id::VARCHAR, ' ' ORDER BY s, e, event_id::VARCHAR) AS text FROM iv GROUP BY 1, 2")
def texts_by_speaker(spark, sf_dir):
    return tr.texts_by_speaker(words(spark, sf_dir), ["user_id"])


@query(f"""WITH {INTERVALS}, x AS (SELECT *, CASE WHEN right(lag(event_id::VARCHAR) OVER w, 1) IN ('0', '5') OR lag(e) OVER w IS NULL OR s - lag(e) OVER w >= 3600000000 THEN 1 ELSE 0 END AS nw FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS segment FROM x)
SELECT user_id, segment::BIGINT AS segment, min(s) AS start, max(e) AS "end", count(*) AS n_words, string_agg(event_id::VARCHAR, ' ' ORDER BY s, e, event_id::VARCHAR) AS text FROM y GROUP BY 1, 2""")
def segments_of_words(spark, sf_dir):
    return iv.segments_of_words(words(spark, sf_dir).drop("speaker"), ["user_id"], 3_600_000_000, ("0", "5"))


@query("""WITH x AS (SELECT source AS shard, lang, doc_id, CASE WHEN lag(lang) OVER (PARTITION BY source ORDER BY doc_id) IS NOT DISTINCT FROM lang THEN 0 ELSE 1 END AS nw FROM documents), y AS (SELECT *, sum(nw) OVER (PARTITION BY shard ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT shard, run::BIGINT AS run, lang, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS text, count(*) AS n FROM y GROUP BY 1, 2, 3""")
def merged_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("shard"), "lang", "doc_id", F.col("doc_id").cast("string").alias("text"))
    return tr.merged_runs(rows, "lang", "doc_id", "shard")


@query("SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND length(d.text) > 600)")
def whole_conversations(spark, sf_dir):
    return tr.whole_conversations(table(spark, sf_dir, "conversations"), "conv_id", F.length("text") <= 600).select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place, max((role NOT IN ('user', 'assistant'))::INT) OVER (PARTITION BY conv_id) = 1 AS failed FROM conversations""")
def role_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("start"), F.col("role").alias("speaker"))
    return tr.role_turns(rows, ["conv_id"], ["user"], ["assistant"]).select("conv_id", "turn", "role", F.col("place").cast("long").alias("place"), "failed")


@query(f"""WITH {INTERVALS}, f AS (SELECT user_id, channel, min((s, e)) AS f FROM iv GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f, channel) - 1 AS l FROM f) SELECT user_id, event_id, l AS local_speaker FROM iv JOIN r USING (user_id, channel)""")
def local_speakers(spark, sf_dir):
    rows = intervals(spark, sf_dir).withColumnRenamed("channel", "speaker")
    return tr.local_speakers(rows, ["user_id"]).select("user_id", "event_id", F.col("local_speaker").cast("long").alias("local_speaker"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def last_good(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return tr.last_good(rows, ["user_id"], "event_id", "v")


@query(f"""WITH {INTERVALS}, n AS (SELECT user_id, count(DISTINCT channel) AS n FROM iv GROUP BY 1) SELECT user_id, a.i::INT AS a, b.i::INT AS b FROM n, range(0, 10) a(i), range(0, 10) b(i) WHERE a.i < b.i AND b.i <= greatest(n - 1, 1)""")
def speaker_pairs(spark, sf_dir):
    return tr.speaker_pairs(intervals(spark, sf_dir).withColumnRenamed("channel", "speaker"), ["user_id"])


@query("SELECT coalesce(lang, 'TOTAL') AS lang, sum((lang = 'en' AND n_chars < 1000)::INT)::BIGINT AS hits, count(*) AS n, round(avg((lang = 'en' AND n_chars < 1000)::INT), 9) AS rate FROM documents GROUP BY ROLLUP (lang)")
def match_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.lit("x").alias("r"), F.when((F.col("lang") == "en") & (F.col("n_chars") < 1000), "x").otherwise("y").alias("h"))
    return me.exact_match(rows, "lang", "r", "h").select("lang", "hits", "n", F.round("rate", 9).alias("rate"))


@query(f"""WITH {TURNS}, g AS (SELECT pair, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(reference), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w, 1 AS k FROM tp UNION ALL SELECT pair, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(hypothesis), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')), 0 FROM tp),
c AS (SELECT pair, w, sum(k) AS r, sum(1 - k) AS h FROM g GROUP BY 1, 2), f AS (SELECT pair, sum(least(r, h))::BIGINT AS common, sum(r)::INT AS n_ref, sum(h)::INT AS n_hyp FROM c GROUP BY 1)
SELECT pair, coalesce(common, 0) AS common, coalesce(n_ref, 0)::INT AS n_ref, coalesce(n_hyp, 0)::INT AS n_hyp, round(CASE WHEN n_ref + n_hyp > 0 THEN 2.0::DOUBLE * common / (n_ref + n_hyp) ELSE 0 END, 9) AS f1 FROM tp LEFT JOIN f USING (pair)""")
def token_f1(spark, sf_dir):
    return me.token_f1(turns(spark, sf_dir), "pair", "reference", "hypothesis").select("pair", "common", "n_ref", "n_hyp", F.round("f1", 9).alias("f1"))


@query("SELECT event_id, user_id, round(sum(value) OVER w, 9) AS value_sum, round(avg(value) OVER w, 9) AS value_avg, max(value) OVER w AS value_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_metrics(spark, sf_dir):
    out = st.running_metrics(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")
    return out.select("event_id", "user_id", F.round("value_sum", 9).alias("value_sum"), F.round("value_avg", 9).alias("value_avg"), "value_max")


@query("SELECT source, lang FROM (SELECT source, lang, count(*) AS n, sum(n_chars) AS w FROM documents GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, w DESC, lang) = 1")
def label_mode(spark, sf_dir):
    return st.mode(table(spark, sf_dir, "documents"), ["source"], "lang", "n_chars")


@query("SELECT doc_id, source, (dense_rank() OVER (PARTITION BY source ORDER BY lang) - 1)::INT AS lang FROM documents")
def compact_labels(spark, sf_dir):
    return ve.compact_labels(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], "lang")


@query("WITH d AS (SELECT DISTINCT source FROM documents) SELECT a.source AS a, b.source AS b, abs(x.n - y.n)::BIGINT AS gap FROM d a JOIN d b ON a.source < b.source JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) x ON x.source = a.source JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) y ON y.source = b.source")
def source_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pairs = n.withColumnsRenamed({"source": "a", "n": "x"}).crossJoin(F.broadcast(n.withColumnsRenamed({"source": "b", "n": "y"}))).where("a < b")  # one row per source
    return pairs.select("a", "b", F.abs(F.col("x") - F.col("y")).alias("gap"))


@query("""WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), y AS (SELECT doc_id, source, unnest(generate_series(i, (ceil(n / 3.0) * 3)::BIGINT - 1, n)) AS j FROM x) SELECT doc_id, source, j % 3 AS rank FROM y""")
def rank_stride(spark, sf_dir):
    return sa.rank_stride(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], 3, F.col("n_chars"), F.col("doc_id")).select("doc_id", "source", "rank")


@query(f"""WITH {INTERVALS}, x AS (SELECT user_id, channel AS speaker, s, e, lag(channel) OVER w AS pc, lag(e) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e, channel)), y AS (SELECT *, sum(CASE WHEN pc = speaker AND pe = s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) AS t FROM x)
SELECT user_id, speaker, min(s) AS start, max(e) AS "end" FROM y GROUP BY user_id, speaker, t""")
def merge_turns(spark, sf_dir):
    return iv.merge_turns(intervals(spark, sf_dir).withColumnRenamed("channel", "speaker"), ["user_id"])
