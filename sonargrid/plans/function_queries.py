"""Scalar functions and smaller operators over the test tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import signal as sg
from ..functions import text as tx
from ..operators import frames as fr
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import metrics as me
from ..operators import sampling as sa
from ..operators import simulate as sim
from ..operators import statistics as st
from ..operators import vectors as ve
from .aggregate_queries import SCORED, VECTORS, scored, sessions
from .frame_queries import RUNS
from .interval_queries import MINUTE, merged_sql
from .registration import Registry
from .views import CHANNEL_FRAMES, FRAMES, HOUR, INTERVALS, channel_frames, frames, intervals, table, turns

REGISTRY = Registry()
query = REGISTRY.query


@query(f"WITH {INTERVALS} SELECT user_id, event_id, greatest(s - {MINUTE}, 0) AS start, e + {2 * MINUTE} AS \"end\" FROM iv")
def pad_intervals(spark, sf_dir):
    return iv.pad(intervals(spark, sf_dir), MINUTE, 2 * MINUTE).select("user_id", "event_id", "start", "end")


@query(f"WITH {INTERVALS} SELECT user_id, event_id FROM iv WHERE e - s >= {HOUR}")
def filter_intervals(spark, sf_dir):
    return iv.filter_intervals(intervals(spark, sf_dir), HOUR).select("user_id", "event_id")


@query(f"WITH {INTERVALS}, x AS (SELECT user_id, s, e, CASE WHEN s <= lag(e) OVER (PARTITION BY user_id ORDER BY s, e) THEN 0 ELSE 1 END AS nw FROM iv), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM x) SELECT user_id, min(s) AS start, arg_max(e, (s, e)) AS \"end\" FROM y GROUP BY user_id, i")
def merge_neighbours(spark, sf_dir):
    return iv.merge_neighbours(intervals(spark, sf_dir), ["user_id"])


@query(f"WITH {INTERVALS} SELECT user_id, channel, s AS start, e AS \"end\" FROM iv WHERE (user_id, s, e) NOT IN (SELECT user_id, s, e FROM iv WHERE event_id % 4 = 0)")
def remove_exact(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    return iv.remove_exact(rows, rows.where("event_id % 4 = 0"), ["user_id"]).select("user_id", "channel", "start", "end")


@query(f"WITH {INTERVALS} SELECT user_id, s AS t FROM iv UNION ALL SELECT user_id, e FROM iv")
def interval_boundaries(spark, sf_dir):
    return iv.boundaries(intervals(spark, sf_dir), ["user_id"])


@query(f"WITH {INTERVALS} SELECT user_id, min(s) AS start, max(e) AS \"end\" FROM iv GROUP BY 1")
def interval_extent(spark, sf_dir):
    return iv.extent(intervals(spark, sf_dir), ["user_id"])


@query(f"WITH {INTERVALS}, b AS (SELECT user_id, min(s) + {24 * HOUR} AS low, min(s) + {72 * HOUR} AS high FROM iv GROUP BY 1) SELECT user_id, event_id, greatest(s, low) AS start, least(e, high) AS \"end\" FROM iv JOIN b USING (user_id) WHERE greatest(s, low) < least(e, high)")
def clip_intervals(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    first = rows.groupBy("user_id").agg((F.min("start") + 24 * HOUR).alias("low"), (F.min("start") + 72 * HOUR).alias("high"))
    return iv.clip(rows, first, ["user_id"]).select("user_id", "event_id", "start", "end")


@query(f"""WITH {INTERVALS}, x AS (SELECT user_id, event_id, s, e, lag(e) OVER w AS p, lead(s) OVER w AS n FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e)) SELECT user_id, event_id, CASE WHEN p > s THEN (p + s) / 2.0::DOUBLE ELSE s END AS start, CASE WHEN e > n THEN (e + n) / 2.0::DOUBLE ELSE e END AS "end" FROM x""")
def contiguous_stamps(spark, sf_dir):
    return iv.contiguous(intervals(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "start", "end")


@query(f"WITH {INTERVALS}, d AS (SELECT user_id, (max(e) - min(s)) AS duration FROM iv GROUP BY 1), x AS (SELECT user_id, duration, unnest(generate_series(0, greatest(ceil(duration / {6.0 * HOUR}::DOUBLE)::BIGINT, 1) - 1)) AS c FROM d WHERE duration > 0) SELECT user_id, c AS chunk, c * {6 * HOUR} AS start, least(c * {6 * HOUR} + {8 * HOUR}, duration) AS \"end\" FROM x WHERE least(c * {6 * HOUR} + {8 * HOUR}, duration) - c * {6 * HOUR} > 0")
def session_tiles(spark, sf_dir):
    d = intervals(spark, sf_dir).groupBy("user_id").agg((F.max("end") - F.min("start")).alias("duration"))
    return iv.tiles(d, 8 * HOUR, 6 * HOUR).select("user_id", F.col("chunk").cast("long").alias("chunk"), "start", "end")


@query(f"""WITH {INTERVALS}, w AS (SELECT user_id, s // {24 * HOUR} * {24 * HOUR} AS s FROM iv GROUP BY 1, 2)
SELECT w.user_id, w.s AS start, sum(greatest(least(w.s + {24 * HOUR}, iv.e) - greatest(w.s, iv.s), 0))::BIGINT AS speech FROM w JOIN iv ON w.user_id = iv.user_id GROUP BY 1, 2""")
def speech_in_days(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    days = rows.select("user_id", (F.floor(F.col("start") / (24 * HOUR)) * 24 * HOUR).alias("start")).distinct().withColumn("end", F.col("start") + 24 * HOUR)
    return jn.speech_in_windows(days, rows, ["user_id"], 6 * HOUR).select("user_id", "start", "speech")


@query(f"""WITH {INTERVALS}, c AS (SELECT a.user_id, a.channel, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM iv a JOIN iv b ON a.user_id = b.user_id AND b.channel = 'view' AND greatest(a.s, b.s) < least(a.e, b.e)), {merged_sql('c', 0, 'mg', 'user_id, channel')} SELECT user_id, channel, s AS start, e AS "end" FROM mg""")
def clipped_tracks(spark, sf_dir):
    rows = intervals(spark, sf_dir).select("user_id", "channel", "start", "end")
    return jn.clipped(rows, rows.where("channel = 'view'"), ["user_id"], HOUR, "channel")


@query(f"WITH {FRAMES} SELECT user_id, frame * 2 + i AS frame, score FROM fr, range(0, 2) t(i)")
def repeated_frames(spark, sf_dir):
    return fr.repeat_frames(frames(spark, sf_dir), ["user_id"], 2)


@query(f"WITH {FRAMES} SELECT user_id, frame // 5 AS frame, round(avg((score >= 0.5)::INT), 9) AS label FROM fr GROUP BY 1, 2")
def soft_labels(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("label", (F.col("score") >= 0.5).cast("int"))
    return fr.soft_labels(rows, ["user_id"], 5).select("user_id", "frame", F.round("label", 9).alias("label"))


@query(f"""WITH {FRAMES}, l AS (SELECT * FROM fr WHERE score >= 0.7), r AS ({RUNS.format('l')}), x AS (SELECT user_id, first AS s, last + 1 AS e FROM r), {merged_sql('x', 2)} SELECT user_id, s AS start, e AS "end" FROM mg WHERE e - s >= 2""")
def runs_above(spark, sf_dir):
    return fr.runs_above(frames(spark, sf_dir), ["user_id"], 0.7, 1, 2, 2)


@query(f"""WITH {FRAMES}, x AS (SELECT user_id, frame, (score >= 0.5) AS g FROM fr), y AS (SELECT *, lag(g) OVER w IS NOT DISTINCT FROM g AS b, lead(g) OVER w IS NOT DISTINCT FROM g AS a FROM x WINDOW w AS (PARTITION BY user_id ORDER BY frame)) SELECT user_id, frame, CASE WHEN b AND a THEN 'next' WHEN b THEN 'end' WHEN a THEN 'start' ELSE 'single' END AS status FROM y""")
def stream_status(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("item", F.col("score") >= 0.5)
    return fr.stream_status(rows, ["user_id"], "item").select("user_id", "frame", "status")


@query(f"WITH {FRAMES}, d AS (SELECT user_id, abs(score - lag(score) OVER (PARTITION BY user_id ORDER BY frame)) AS d FROM fr) SELECT user_id, round(coalesce(avg(d), 0), 9) AS mean_step FROM d GROUP BY 1")
def mean_step(spark, sf_dir):
    return st.mean_step(frames(spark, sf_dir), ["user_id"]).select("user_id", F.round("mean_step", 9).alias("mean_step"))


@query("SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 9) AS norm FROM events WINDOW w AS (PARTITION BY event_type)")
def min_max_norm(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(st.min_max(["event_type"], "value"), 9).alias("norm"))


@query("SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-5), 6) AS value FROM events WINDOW w AS (PARTITION BY user_id)")
def standardised_values(spark, sf_dir):
    return sg.standardised(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, round(20 * log10(value + 1e-16), 6) AS db, round(pow(10.0, value / 2000), 6) AS mag, round(ln(value + 1.0), 6) AS log, round(value - 2 * pi() * floor((value + pi()) / (2 * pi())), 6) AS angle FROM events WHERE value > 0")
def level_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").where("value > 0").select("event_id", *(F.round(c, 6).alias(n) for c, n in ((sg.mag2db(v), "db"), (sg.db2mag(v / 100), "mag"), (sg.log_compressed(v), "log"), (sg.wrap_angle(v), "angle"))))


@query(f"SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding)), 6) AS rms FROM embeddings")
def vector_rms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sg.rms(F.col("embedding")), 6).alias("rms"))


@query(f"WITH {VECTORS} SELECT a.session, a.vec_id AS i, b.vec_id AS j, round(list_distance(a.x, b.x), 5) AS distance FROM v a JOIN v b ON a.session = b.session AND a.vec_id < b.vec_id")
def session_distances(spark, sf_dir):
    v = sessions(spark, sf_dir).select("session", F.col("vec_id").alias("i"), F.col("embedding").alias("a"))
    pairs = v.join(v.withColumnsRenamed({"i": "j", "a": "b"}), "session").where("i < j")
    return pairs.select("session", "i", "j", F.round(ve.euclidean(F.col("a"), F.col("b")), 5).alias("distance"))


@query(f"""WITH {VECTORS}, u AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v), s AS (SELECT a.session, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round(list_dot_product(a.x, b.x) / (a.n * b.n), 6) END AS sim FROM u a JOIN u b USING (session)),
t AS (SELECT session, i, round(sum(sim), 4) AS total FROM s GROUP BY 1, 2) SELECT session, i, total FROM t QUALIFY row_number() OVER (PARTITION BY session ORDER BY total DESC, i) <= 4""")
def closest_vectors(spark, sf_dir):
    sims = ve.affinity(sessions(spark, sf_dir), ["session"], "vec_id", "embedding").withColumn("sim", F.round("sim", 6))
    totals = sims.groupBy("session", "i").agg(F.round(F.sum("sim"), 4).alias("sim")).withColumn("j", F.lit(0))
    return ve.closest(totals, ["session"], 3).select("session", "i", F.round("total", 4).alias("total"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '([.,?])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def separate_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.separate_punctuation(F.col("text")).alias("text"))


@query("SELECT item_id, encode(text)::BLOB IS NOT NULL AS ok, strlen(text) AS n_bytes, length(text) AS n_chars FROM benchmark")
def byte_tokens(spark, sf_dir):
    ids = tx.byte_ids(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.forall(ids, lambda i: (i >= 0) & (i < 256)).alias("ok"), F.size(ids).cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, printf('%s_chunk%04d_%09d_%09d', source, (doc_id % 100)::INT, n_chars * 10, n_chars * 10 + 5000) AS chunk, source AS session FROM documents")
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    chunk = pr.chunk_id(F.col("source"), F.col("doc_id") % 100, F.col("n_chars") / 100.0, F.lit(5.0))
    return d.select("doc_id", chunk.alias("chunk")).withColumn("session", pr.session_of(F.col("chunk")))


@query("SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ticks, round(round_even(value * 1000, 0) / 1000, 3) AS back FROM events")
def tick_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", pr.to_ticks(F.col("value")).alias("ticks"))
    return e.withColumn("back", pr.from_ticks(F.col("ticks")))


@query("SELECT doc_id FROM documents WHERE n_chars / nullif(length(text) - length(replace(text, ' ', '')) + 1, 0) BETWEEN 3 AND 8")
def characters_per_word(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1
    return d.where(pr.ratio_between(F.col("n_chars"), words, 3, 8)).select("doc_id")


@query(f"WITH {SCORED}, m AS (SELECT source, avg(label) AS p, avg(-(label * ln(greatest(least(score, 0.999999), 0.000001)) + (1 - label) * ln(1 - greatest(least(score, 0.999999), 0.000001)))) AS ce FROM sc GROUP BY 1) SELECT source, round(CASE WHEN p > 0 AND p < 1 THEN 1 - ce / -(p * ln(p) + (1 - p) * ln(1 - p)) END, 6) AS nce FROM m")
def cross_entropy_by_source(spark, sf_dir):
    return me.normalised_cross_entropy(scored(spark, sf_dir), "source", eps=1e-6).select("source", F.round("nce", 6).alias("nce"))


@query(f"WITH {SCORED}, t AS (SELECT i FROM range(0, 21) r(i)), p AS (SELECT i, sum((label = 1 AND least(floor(score * 20), 20) >= i)::INT) / sum(label)::DOUBLE AS tpr, sum((label = 0 AND least(floor(score * 20), 20) >= i)::INT) / sum(1 - label)::DOUBLE AS fpr FROM t, sc GROUP BY 1) SELECT i / 20.0::DOUBLE AS threshold, round(tpr - fpr, 9) AS youden FROM p")
def youden_curve(spark, sf_dir):
    return me.youden_curve(scored(spark, sf_dir), 20).select("threshold", F.round("youden", 9).alias("youden"))


@query(f"WITH {SCORED} SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS lang, sum((score >= 0.5 AND label = 1)::INT)::BIGINT AS tp, sum((score >= 0.5)::INT)::BIGINT AS found, sum(label)::BIGINT AS wanted FROM sc GROUP BY ROLLUP (lang)")
def scores_by_language(spark, sf_dir):
    return me.multi_label_scores(scored(spark, sf_dir), ["lang"]).select("lang", "tp", "found", "wanted")


@query(f"WITH {SCORED} SELECT round(avg(CASE WHEN lang = 'en' THEN score END), 9) AS english, round(avg(CASE WHEN lang <> 'en' AND source <> 'src0' THEN score END), 9) AS others FROM sc")
def constrained_means(spark, sf_dir):
    out = me.constrained_mean(scored(spark, sf_dir), "score", {"english": ".lang == en", "others": ".lang != en and .source != src0"})
    return out.select(*(F.round(c, 9).alias(c) for c in ("english", "others")))


@query("SELECT user_id, avg(CASE WHEN EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND abs(q.event_id - e.event_id) <= 50) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM events e WHERE event_type = 'click' GROUP BY 1")
def token_hits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda name: e.where(F.col("event_type") == name).select("user_id", F.col("event_id").alias("pos"), F.lit(1).alias("token"))
    return me.token_hits(side("click"), side("view"), ["user_id"], 1, 50)


@query("WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'click' THEN event_id END) AS u, min(CASE WHEN event_type = 'view' THEN event_id END) AS a FROM events GROUP BY 1) SELECT user_id, u AS user_end, a AS agent_start, a - u AS latency, coalesce(abs(a - u) <= 300, false) AS ok FROM f WHERE u IS NOT NULL")
def turn_taking(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = lambda name: F.when(F.col("event_type") == name, 1).otherwise(0)
    return me.turn_taking(e.select("user_id", F.col("event_id").alias("pos"), code("click").alias("source"), code("view").alias("predicted")), ["user_id"], 1, 1, 300)


@query("WITH c AS (SELECT label, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1) SELECT label, round(m, 7) AS mean FROM c")
def label_means(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))
    return rows.groupBy("label").agg(F.round(st.mean_or_zero(F.col("x").cast("double")), 7).alias("mean"))


@query("SELECT i, j, round(covar_pop(a, b), 7) AS cov FROM (SELECT x.i, y.i AS j, x.v AS a, y.v AS b FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) x JOIN (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) y ON x.vec_id = y.vec_id AND x.i <= y.i) GROUP BY 1, 2")
def embedding_covariance(spark, sf_dir):
    return st.covariance(table(spark, sf_dir, "embeddings"), "embedding").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("cov", 7).alias("cov"))


@query(f"WITH {CHANNEL_FRAMES}, a AS (SELECT user_id, frame, list(score ORDER BY channel) AS p FROM cf GROUP BY 1, 2) SELECT user_id, frame, round((list_max(p) * len(p) - 1) / (len(p) - 1), 6) AS confidence, list_min(p) AS least FROM a WHERE len(p) > 1")
def frame_confidence(spark, sf_dir):
    rows = channel_frames(spark, sf_dir).groupBy("user_id", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("channel", "score"))), lambda x: x["score"]).alias("p")).where(F.size("p") > 1)
    return rows.select("user_id", "frame", F.round(st.confidence(F.col("p")), 6).alias("confidence"), st.pooled_confidence(F.col("p"), "min").alias("least"))


# rows only: choices by hash, sequential walks, alignments


@query()
def split_documents(spark, sf_dir):
    return sa.split_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


@query()
def interleaved_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sa.interleave({x: d.where(F.col("lang") == x) for x in ("en", "fr", "de")}, {"en": 2, "fr": 1, "de": 1}, "doc_id")


@query()
def sampled_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sa.sample_to_weights(d, "lang", "doc_id", {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}, 1000)


@query()
def simulated_sessions(spark, sf_dir):
    utt = table(spark, sf_dir, "events").select(F.col("event_type").alias("speaker"), F.col("event_id").alias("utterance"), (F.col("value") / 10 + 1).alias("duration"))
    return sim.sessions(utt, 4, 2, 120.0)


@query()
def keyword_scores(spark, sf_dir):
    return me.keyword_scores(turns(spark, sf_dir), "reference", "hypothesis", ["the", "and", "of", "la"])


@query()
def alignment_counts(spark, sf_dir):
    return me.alignment_counts(turns(spark, sf_dir), "reference", "hypothesis").select("pair", "hits", "substitutions", "deletions", "insertions")


@query()
def utterance_end_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda name: e.where(F.col("event_type") == name).select("user_id", (F.col("event_id") / 10.0).alias("t"))
    return me.utterance_ends(side("click"), side("view"), "user_id", 1.0)


