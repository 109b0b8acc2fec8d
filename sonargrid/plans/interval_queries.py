"""Interval algebra and range joins over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import joins as jn
from .registration import Registry
from .views import HOUR, INTERVALS, intervals, segments, table

REGISTRY = Registry()
query = REGISTRY.query

SWEEP = """
ev AS (SELECT user_id, s AS t, 1 AS d FROM iv UNION ALL SELECT user_id, e, -1 FROM iv),
pt AS (SELECT user_id, t, sum(d) AS d FROM ev GROUP BY 1, 2),
sw AS (SELECT user_id, t AS s, lead(t) OVER w AS e, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t))"""


def merged_sql(source: str, gap: int = 0, name: str = "mg", keys: str = "user_id") -> str:
    return f"""
{name}_a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS nw FROM {source} WHERE e > s),
{name}_b AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_a),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY {keys}, isl)"""


MINUTE = HOUR // 60


@query(f"WITH {INTERVALS}, {SWEEP} SELECT user_id, s AS start, e AS \"end\" FROM sw WHERE n >= 2 AND e IS NOT NULL")
def vote_intervals(spark, sf_dir):
    return iv.vote(intervals(spark, sf_dir), ["user_id"], 2)


@query(f"""WITH {INTERVALS}, {SWEEP},
v AS (SELECT user_id, greatest(s - {MINUTE}, 0) AS s, e + {MINUTE} AS e FROM sw WHERE n >= 2 AND e - s >= {MINUTE}), {merged_sql('v', 5 * MINUTE)}
SELECT user_id, s AS start, e AS "end" FROM mg WHERE e - s >= {MINUTE}""")
def vote_pad_merge(spark, sf_dir):
    return iv.vote_pad_merge(intervals(spark, sf_dir), ["user_id"], 2, MINUTE, MINUTE, MINUTE, 5 * MINUTE)


@query(f"WITH {INTERVALS}, {merged_sql('iv', 30 * MINUTE)} SELECT user_id, s AS start, e AS \"end\" FROM mg WHERE e - s >= {10 * MINUTE}")
def merge_intervals(spark, sf_dir):
    return iv.merge(intervals(spark, sf_dir), ["user_id"], 30 * MINUTE, 10 * MINUTE)


@query(f"WITH {INTERVALS}, {merged_sql('iv', 0, 'mg', 'user_id, channel')} SELECT user_id, channel, s AS start, e AS \"end\" FROM mg")
def union_per_channel(spark, sf_dir):
    return iv.merge(intervals(spark, sf_dir), ["user_id", "channel"])


@query(f"""WITH {INTERVALS}, w AS (SELECT DISTINCT user_id, channel, (length(channel) % 3) AS weight FROM iv), jv AS (SELECT iv.*, weight FROM iv JOIN w USING (user_id, channel) WHERE weight > 0),
ev AS (SELECT user_id, s AS t, weight AS d FROM jv UNION ALL SELECT user_id, e, -weight FROM jv), pt AS (SELECT user_id, t, sum(d) AS d FROM ev GROUP BY 1, 2),
sw AS (SELECT user_id, t AS s, lead(t) OVER w AS e, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, s AS start, e AS "end" FROM sw WHERE n >= 2 AND e IS NOT NULL""")
def weighted_vote(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    weights = rows.select("user_id", "channel").distinct().withColumn("weight", F.length("channel") % 3)
    return iv.weighted_vote(rows, weights, ["user_id"], "channel", 2)


@query(f"WITH {INTERVALS}, {merged_sql('iv')} SELECT user_id, e AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS \"end\" FROM mg QUALIFY \"end\" IS NOT NULL")
def gap_segments(spark, sf_dir):
    return iv.gaps(iv.merge(intervals(spark, sf_dir), ["user_id"]), ["user_id"])


@query(f"""WITH {INTERVALS}, {merged_sql('iv')}, u AS (SELECT user_id, max(e) + {HOUR} AS d FROM iv GROUP BY 1),
g AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 0) AS s, s AS e FROM mg UNION ALL SELECT u.user_id, coalesce(m.l, 0), d FROM u LEFT JOIN (SELECT user_id, max(e) AS l FROM mg GROUP BY 1) m USING (user_id))
SELECT user_id, s AS start, e AS "end" FROM g WHERE s < e""")
def nonspeech(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    return iv.complement(rows, ["user_id"], rows.groupBy("user_id").agg((F.max("end") + HOUR).alias("duration")))


@query(f"WITH {INTERVALS}, {SWEEP}, v AS (SELECT user_id, s, e FROM sw WHERE n >= 2 AND e IS NOT NULL), {merged_sql('v')} SELECT user_id, s AS start, e AS \"end\" FROM mg")
def overlap_regions(spark, sf_dir):
    return iv.overlap_regions(intervals(spark, sf_dir), ["user_id"])


@query(f"""WITH {INTERVALS}, r AS (SELECT user_id, s, least(e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv)
SELECT user_id, s AS start, e AS "end" FROM r WHERE s < p""")
def running_overlaps(spark, sf_dir):
    return iv.running_overlaps(intervals(spark, sf_dir), ["user_id"])


@query(f"""WITH {INTERVALS}, a AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 0), b AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 1), {merged_sql('a', 0, 'ma')}, {merged_sql('b', 0, 'mb')},
ev AS (SELECT user_id, s AS t, 1 AS d FROM ma UNION ALL SELECT user_id, e, -1 FROM ma UNION ALL SELECT user_id, s, -2 FROM mb UNION ALL SELECT user_id, e, 2 FROM mb),
pt AS (SELECT user_id, t, sum(d) AS d FROM ev GROUP BY 1, 2),
sw AS (SELECT user_id, t AS s, lead(t) OVER w AS e, sum(d) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t)),
v AS (SELECT user_id, s, e FROM sw WHERE n = 1 AND e IS NOT NULL), {merged_sql('v')} SELECT user_id, s AS start, e AS "end" FROM mg""")
def subtract_intervals(spark, sf_dir):
    return iv.subtract(segments(spark, sf_dir, 0), segments(spark, sf_dir, 1), ["user_id"])


@query(f"""WITH {INTERVALS}, x AS (SELECT user_id, event_id, s, e, unnest(generate_series(0, greatest(ceil((e - s - {30 * MINUTE}) / {10 * MINUTE}.0)::BIGINT, 0))) AS i FROM iv WHERE e > s)
SELECT user_id, event_id, i AS index, s + i * {10 * MINUTE} AS w_start, least({30 * MINUTE}, e - (s + i * {10 * MINUTE})) AS w_duration FROM x WHERE least({30 * MINUTE}, e - (s + i * {10 * MINUTE})) > {MINUTE}""")
def sliding_windows(spark, sf_dir):
    return iv.sliding_windows(intervals(spark, sf_dir), 30 * MINUTE, 10 * MINUTE, MINUTE).select("user_id", "event_id", F.col("index").cast("long").alias("index"), "w_start", "w_duration")


@query(f"""WITH {INTERVALS}, x AS (SELECT user_id, event_id, channel, s, e, s // {HOUR} AS f, unnest(generate_series(s // {HOUR}, e // {HOUR})) AS c FROM iv)
SELECT user_id, event_id, c AS chunk, greatest(s, c * {HOUR}) AS start, least(e, (c + 1) * {HOUR}) AS "end", CASE WHEN c = f THEN channel ELSE '' END AS channel FROM x""")
def tumbling_split(spark, sf_dir):
    return iv.tumbling_split(intervals(spark, sf_dir), HOUR, "channel").select("user_id", "event_id", "chunk", "start", "end", "channel")


@query(f"""WITH {INTERVALS}, r AS (SELECT user_id, s, channel, lag(channel) OVER (PARTITION BY user_id ORDER BY s, e, channel) AS b FROM iv) SELECT user_id, s AS t FROM r WHERE b <> channel""")
def speaker_switches(spark, sf_dir):
    return iv.switches(intervals(spark, sf_dir), ["user_id"], "channel")


@query(f"WITH {INTERVALS} SELECT user_id, sum(greatest(e - s, 0))::BIGINT AS duration FROM iv GROUP BY 1")
def total_duration(spark, sf_dir):
    return iv.total_duration(intervals(spark, sf_dir), ["user_id"])


@query(f"""WITH {INTERVALS} SELECT a.user_id, a.event_id AS a, b.event_id AS b, greatest(a.s, b.s) AS o_start, least(a.e, b.e) AS o_end
FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND greatest(a.s, b.s) < least(a.e, b.e)""")
def range_join(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    pairs = jn.range_join(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], HOUR)
    return pairs.select("user_id", F.col("event_id_l").alias("a"), F.col("event_id_r").alias("b"), "o_start", "o_end")


@query(f"""WITH {INTERVALS}, a AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 0), b AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 1), {merged_sql('a', 0, 'ma')}, {merged_sql('b', 0, 'mb')},
i AS (SELECT ma.user_id, sum(least(ma.e, mb.e) - greatest(ma.s, mb.s)) AS d FROM ma JOIN mb ON ma.user_id = mb.user_id AND greatest(ma.s, mb.s) < least(ma.e, mb.e) GROUP BY 1),
x AS (SELECT user_id, sum(e - s) AS d FROM ma GROUP BY 1), y AS (SELECT user_id, sum(e - s) AS d FROM mb GROUP BY 1)
SELECT coalesce(x.user_id, y.user_id) AS user_id, round(2 * coalesce(i.d, 0)::DOUBLE / (coalesce(x.d, 0) + coalesce(y.d, 0)), 9) AS dice FROM x FULL JOIN y USING (user_id) LEFT JOIN i ON i.user_id = coalesce(x.user_id, y.user_id)""")
def dice_overlap(spark, sf_dir):
    a, b = (iv.merge(segments(spark, sf_dir, i), ["user_id"]) for i in (0, 1))
    return jn.dice(a, b, ["user_id"], HOUR).select("user_id", F.round("dice", 9).alias("dice"))


@query(f"""WITH {INTERVALS}, p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT p.user_id, p.event_id, p.t, count(iv.s) AS n FROM p LEFT JOIN iv ON p.user_id = iv.user_id AND iv.s <= p.t AND p.t < iv.e GROUP BY 1, 2, 3""")
def points_in_intervals(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    points = rows.where("channel = 'click'").select("user_id", "event_id", F.col("start").alias("t"))
    return jn.points_in_intervals(points, rows, ["user_id"], HOUR).select("user_id", "event_id", "t", "n")


@query(f"""WITH {INTERVALS}, l AS (SELECT user_id, event_id, s AS t FROM iv WHERE channel = 'click'), r AS (SELECT user_id, s AS t, max(event_id) AS v FROM iv WHERE channel = 'view' GROUP BY 1, 2)
SELECT l.user_id, l.event_id, l.t, r.v AS found FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t""")
def asof_join(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    left = rows.where("channel = 'click'").select("user_id", "event_id", F.col("start").alias("t"))
    right = rows.where("channel = 'view'").groupBy("user_id", F.col("start").alias("t")).agg(F.max("event_id").alias("found"))
    return jn.asof(left, right, ["user_id"], "found")


@query(f"""WITH {INTERVALS}, l AS (SELECT user_id, event_id, s AS t FROM iv WHERE channel = 'click'), r AS (SELECT user_id, s AS t, max(event_id) AS v FROM iv WHERE channel = 'view' GROUP BY 1, 2)
SELECT l.user_id, l.event_id, l.t, arg_min(r.v, (abs(r.t - l.t), r.t)) AS found FROM l LEFT JOIN r ON l.user_id = r.user_id GROUP BY 1, 2, 3""")
def nearest_join(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    left = rows.where("channel = 'click'").select("user_id", "event_id", F.col("start").alias("t"))
    right = rows.where("channel = 'view'").groupBy("user_id", F.col("start").alias("t")).agg(F.max("event_id").alias("found"))
    return jn.nearest(left, right, ["user_id"], "found")


@query(f"""WITH {INTERVALS} SELECT a.user_id, a.event_id FROM iv a WHERE NOT EXISTS (SELECT 1 FROM iv b WHERE a.user_id = b.user_id AND a.channel <> b.channel AND a.s < a.e AND b.s < b.e AND greatest(a.s, b.s) < least(a.e, b.e))""")
def clean_windows(spark, sf_dir):
    rows = intervals(spark, sf_dir)
    return jn.clean_windows(rows, rows, ["user_id"], HOUR, "channel").select("user_id", "event_id")


@query("SELECT DISTINCT a.event_type AS a, b.event_type AS b FROM events a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def cannot_link_pairs(spark, sf_dir):
    return jn.cannot_link(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(f"""WITH {INTERVALS}, h AS (SELECT user_id, max(e) AS l FROM iv WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, channel AS speaker, s AS start, least(e, l) AS "end" FROM iv JOIN h USING (user_id) WHERE event_id % 2 = 0 AND s < l""")
def partial_reference(spark, sf_dir):
    return iv.clip_to_last(segments(spark, sf_dir, 0), segments(spark, sf_dir, 1), ["user_id"]).select("user_id", "speaker", "start", "end")


@query(f"""WITH {INTERVALS}, x AS (SELECT user_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s, e) - 1 AS i FROM iv), g AS (SELECT user_id, s, i, lead(e) OVER (PARTITION BY user_id ORDER BY i) AS u FROM x WHERE i % 4 = 0) SELECT user_id, s AS start, u AS "end" FROM g WHERE u IS NOT NULL""")
def grouped_windows(spark, sf_dir):
    return iv.group_windows(intervals(spark, sf_dir), ["user_id"], 4)


@query(f"""WITH {INTERVALS}, x AS (SELECT *, sum(CASE WHEN channel IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, lag(channel) OVER (PARTITION BY user_id ORDER BY s, e) AS p FROM iv))
SELECT user_id, turn::BIGINT AS turn, channel AS speaker, min(s) AS start, max(e) AS "end", string_agg(event_id::VARCHAR, ' ' ORDER BY s, e, event_id::VARCHAR) AS text FROM x GROUP BY 1, 2, 3""")
def words_to_turns(spark, sf_dir):
    words = intervals(spark, sf_dir).select("user_id", "start", "end", F.col("channel").alias("speaker"), F.col("event_id").cast("string").alias("word"))
    return iv.turns_of_words(words, ["user_id"])
