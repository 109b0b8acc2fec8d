"""Frame series over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as sg
from ..operators import frames as fr
from ..operators import statistics as st
from .interval_queries import merged_sql
from .registration import Registry
from .views import CHANNEL_FRAMES, FRAMES, channel_frames, frames

REGISTRY = Registry()
query = REGISTRY.query

RUNS = "SELECT user_id, min(frame) AS first, max(frame) AS last FROM (SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM {0}) GROUP BY user_id, r"
STATE = """st AS (SELECT *, CASE WHEN score > {on} AND NOT score < {off} THEN 1 WHEN score < {off} AND NOT score > {on} THEN 0 END AS c, sum(CASE WHEN score > {on} AND score < {off} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS t FROM fr),
ls AS (SELECT *, last_value(c IGNORE NULLS) OVER w AS lc, last_value(CASE WHEN c IS NOT NULL THEN t END IGNORE NULLS) OVER w AS lt FROM st WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hy AS (SELECT user_id, frame, (coalesce(lc, 0) + t - coalesce(lt, 0)) % 2 AS state FROM ls)"""


@query(f"WITH {FRAMES}, {STATE.format(on=0.64, off=0.74)} SELECT user_id, frame, state::BIGINT AS state FROM hy")
def hysteresis_states(spark, sf_dir):
    return fr.hysteresis(frames(spark, sf_dir), ["user_id"], 0.64, 0.74).select("user_id", "frame", F.col("state").cast("long").alias("state"))


@query(f"""WITH {FRAMES}, {STATE.format(on=0.6, off=0.4)}, nx AS (SELECT *, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS nf FROM hy),
o AS (SELECT user_id, frame, coalesce(nf, frame) AS z, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM nx WHERE state = 1), rn AS (SELECT user_id, min(frame)::DOUBLE AS s, max(z)::DOUBLE AS e FROM o GROUP BY user_id, r),
pd AS (SELECT user_id, greatest(s - 1, 0) AS s, e + 1 AS e FROM rn), {merged_sql('pd')} SELECT user_id, s AS start, e AS "end" FROM mg""")
def binarize_frames(spark, sf_dir):
    return fr.binarize(frames(spark, sf_dir), ["user_id"], 0.6, 0.4, 1.0, 1.0, 1.0)


@query(f"WITH {FRAMES}, l AS (SELECT * FROM fr WHERE score >= 0.5), r AS ({RUNS.format('l')}) SELECT user_id, first AS start, last AS \"end\" FROM r")
def binary_runs(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("label", (F.col("score") >= 0.5).cast("int"))
    return fr.binary_runs(rows, ["user_id"], 1)


@query(f"""WITH {CHANNEL_FRAMES}, m AS (SELECT user_id, min(l) AS l FROM (SELECT user_id, channel, max(frame) AS l FROM cf GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT cf.*, row_number() OVER (PARTITION BY user_id, frame ORDER BY score DESC) AS r FROM cf JOIN m USING (user_id) WHERE frame <= l) SELECT user_id, frame, round(avg(score), 9) AS score FROM k WHERE r <= 2 GROUP BY 1, 2""")
def top_k_frames(spark, sf_dir):
    return fr.top_k_mean(channel_frames(spark, sf_dir), ["user_id"], "channel", 2).select("user_id", "frame", F.round("score", 9).alias("score"))


@query(f"""WITH {CHANNEL_FRAMES}, m AS (SELECT user_id, min(l) AS l FROM (SELECT user_id, channel, max(frame) AS l FROM cf GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, frame, round(sum(score * (channel + 1)) / sum(channel + 1), 9) AS score FROM cf JOIN m USING (user_id) WHERE frame <= l GROUP BY 1, 2""")
def weighted_frames(spark, sf_dir):
    rows = channel_frames(spark, sf_dir)
    weights = rows.select("user_id", "channel").distinct().withColumn("weight", F.col("channel") + 1)
    return fr.weighted_mean(rows, weights, ["user_id"], "channel").select("user_id", "frame", F.round("score", 9).alias("score"))


@query(f"""WITH {CHANNEL_FRAMES}, m AS (SELECT user_id, min(l) AS l FROM (SELECT user_id, channel, max(frame) AS l FROM cf GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT user_id, frame, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS a, sum(CAST(round(score * 100) AS BIGINT)) AS t, count(*) AS c FROM cf JOIN m USING (user_id) WHERE frame <= l GROUP BY 1, 2), k AS (SELECT * FROM p WHERE a >= 2 AND t >= 55 * c),
r AS ({RUNS.format('k')}), x AS (SELECT user_id, greatest(first - 1, 0) AS s, last + 2 AS e FROM r), {merged_sql('x')} SELECT user_id, s AS start, e AS "end" FROM mg""")
def overlap_candidates(spark, sf_dir):
    hundredths = channel_frames(spark, sf_dir).withColumn("score", F.round(F.col("score") * 100))
    return fr.overlap_candidates(hundredths, ["user_id"], "channel", 50, 2, 55, 1, 1)


@query(f"""WITH {FRAMES}, s AS (SELECT user_id, unnest(generate_series(frame * 2, frame * 2 + 3)) AS f, score FROM fr) SELECT user_id, f AS frame, round(avg(score), 9) AS mean_score, round(quantile_cont(score, 0.5), 9) AS median_score FROM s GROUP BY 1, 2""")
def smooth_frames(spark, sf_dir):
    rows = frames(spark, sf_dir)
    both = [fr.smooth(rows, ["user_id"], 4, 2, m).select("user_id", "frame", F.round("score", 9).alias(f"{m}_score")) for m in ("mean", "median")]
    return both[0].join(both[1], ["user_id", "frame"])


@query(f"WITH {FRAMES} SELECT user_id, frame // 4 AS frame, max(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS label FROM fr GROUP BY 1, 2")
def pooled_labels(spark, sf_dir):
    return fr.pool_max(frames(spark, sf_dir).withColumn("label", (F.col("score") >= 0.5).cast("int")), ["user_id"], 4)


@query(f"WITH {FRAMES}, r AS (SELECT user_id, quantile_disc(score, 0.01) AS l, quantile_disc(score, 0.99) AS h FROM fr GROUP BY 1) SELECT user_id, round(l + (h - l) * 0.6, 9) AS onset, round(l + (h - l) * 0.4, 9) AS \"offset\" FROM r")
def scaled_thresholds(spark, sf_dir):
    out = fr.scale_thresholds(frames(spark, sf_dir), ["user_id"], 0.6, 0.4, "percentile")
    return out.select("user_id", F.round("onset", 9).alias("onset"), F.round("offset", 9).alias("offset"))


@query(f"""WITH {CHANNEL_FRAMES}, x AS (SELECT *, count(*) OVER (PARTITION BY user_id, channel) AS n, row_number() OVER (PARTITION BY user_id, channel ORDER BY score, frame) AS u, abs(score - lag(score) OVER (PARTITION BY user_id, channel ORDER BY frame)) AS d FROM cf),
p AS (SELECT user_id, channel, avg(CASE WHEN u <= greatest(floor(n * 0.2), 1) THEN score END) AS lo, avg(CASE WHEN u > n - greatest(floor(n * 0.2), 1) THEN score END) AS hi, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS sr, coalesce(avg(d), 0) AS md FROM x GROUP BY 1, 2),
q AS (SELECT user_id, channel, greatest(greatest(hi - lo, 0) * 0.5 + sr * 0.3 + greatest(1 - md, 0) * 0.2, 0.01) AS q FROM p) SELECT user_id, channel, round(q, 9) AS quality, round(q / sum(q) OVER (PARTITION BY user_id), 9) AS weight FROM q""")
def channel_weights(spark, sf_dir):
    profile = st.channel_profile(channel_frames(spark, sf_dir), ["user_id", "channel"])
    out = st.channel_weights(profile, ["user_id"], {"confidence_margin": 0.5, "speech_ratio": 0.3, "stability": 0.2}, 0.01)
    return out.select("user_id", "channel", F.round("quality", 9).alias("quality"), F.round("weight", 9).alias("weight"))


@query(f"""WITH {FRAMES}, a AS (SELECT user_id, round(avg(score), 6) AS v FROM fr GROUP BY 1) SELECT user_id, round(exp((v - max(v) OVER ()) / 0.5) / sum(exp((v - m) / 0.5)) OVER (), 9) AS weight FROM (SELECT *, max(v) OVER () AS m FROM a)""")
def softmax_weights(spark, sf_dir):
    rows = frames(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("score"), 6).alias("v"))
    return st.softmax(rows, [], "v", 0.5).select("user_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH {FRAMES}, r AS (SELECT user_id, frame, sum(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame ROWS 2 PRECEDING) AS n FROM fr) SELECT user_id, min(frame) - 2 AS first, max(frame) AS last FROM r WHERE n = 3 GROUP BY 1""")
def speech_bounds(spark, sf_dir):
    return sg.speech_bounds(frames(spark, sf_dir).withColumn("speech", F.col("score") >= 0.3), ["user_id"], 3)


@query(f"WITH {FRAMES} SELECT user_id, round(avg(score), 9) AS mean, min(score) AS least, max(score) AS most, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.95), 9) AS p95 FROM fr GROUP BY 1")
def frame_percentiles(spark, sf_dir):
    out = st.percentiles(frames(spark, sf_dir), ["user_id"], "score", (0.5, 0.95))
    return out.select("user_id", F.round("mean", 9).alias("mean"), "least", "most", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))
