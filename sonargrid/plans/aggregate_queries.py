"""Metrics, sampling and vectors over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import sampling as sa
from ..operators import vectors as ve
from .interval_queries import merged_sql
from .registration import Registry
from .views import HOUR, INTERVALS, TURNS, segments, table, turns

REGISTRY = Registry()
query = REGISTRY.query


def scored(spark, sf_dir):
    """documents with labels: (doc_id, source, lang, label, score in thousandths)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", "source", "lang", F.col("quality").alias("label"), (F.pmod(F.col("n_chars") * 7 + F.col("doc_id"), F.lit(1000)) / 1000.0).alias("score"))


SCORED = "sc AS (SELECT d.doc_id, source, lang, quality AS label, ((n_chars * 7 + d.doc_id) % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels USING (doc_id))"


@query(f"""WITH {INTERVALS}, a AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 1), b AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 0), {merged_sql('a', 0, 'ma')}, {merged_sql('b', 0, 'mb')},
x AS (SELECT ma.user_id, least(ma.e, mb.e) - greatest(ma.s, mb.s) AS i, 0 AS h, 0 AS r FROM ma JOIN mb ON ma.user_id = mb.user_id AND greatest(ma.s, mb.s) < least(ma.e, mb.e) UNION ALL SELECT user_id, 0, e - s, 0 FROM ma UNION ALL SELECT user_id, 0, 0, e - s FROM mb),
g AS (SELECT CASE WHEN grouping(user_id) = 1 THEN 'TOTAL' ELSE user_id::VARCHAR END AS user_id, sum(i)::BIGINT AS i, sum(h)::BIGINT AS h, sum(r)::BIGINT AS r FROM x GROUP BY ROLLUP (user_id)),
p AS (SELECT *, CASE WHEN h > 0 THEN i / h::DOUBLE ELSE 0 END AS p, CASE WHEN r > 0 THEN i / r::DOUBLE ELSE 0 END AS c FROM g)
SELECT user_id, i AS intersection, h AS hypothesis, r AS reference, round(p, 9) AS precision, round(c, 9) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 9) AS f1 FROM p""")
def interval_prf(spark, sf_dir):
    out = me.interval_prf(segments(spark, sf_dir, 1), segments(spark, sf_dir, 0), ["user_id"], HOUR)
    return out.select("user_id", "intersection", "hypothesis", "reference", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


COLLAR = HOUR // 240


@query(f"""WITH {INTERVALS}, a AS (SELECT user_id, channel, s, e FROM iv WHERE event_id % 2 = 0), b AS (SELECT user_id, channel, s, e FROM iv WHERE event_id % 2 = 1 AND user_id IN (SELECT user_id FROM a)), {merged_sql('a', 0, 'ma', 'user_id, channel')}, {merged_sql('b', 0, 'mb', 'user_id, channel')},
co AS (SELECT user_id, t - {COLLAR} AS s, t + {COLLAR} AS e FROM (SELECT user_id, s AS t FROM a UNION ALL SELECT user_id, e FROM a)), {merged_sql('co', 0, 'mc')},
ev AS (SELECT user_id, s AS t FROM ma UNION SELECT user_id, e FROM ma UNION SELECT user_id, s FROM mb UNION SELECT user_id, e FROM mb UNION SELECT user_id, s FROM mc UNION SELECT user_id, e FROM mc),
pc AS (SELECT user_id, t AS s, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS e FROM ev),
ps AS (SELECT pc.*, NOT EXISTS (SELECT 1 FROM mc WHERE mc.user_id = pc.user_id AND mc.s <= pc.s AND mc.e >= pc.e) AS scored FROM pc WHERE e IS NOT NULL),
rs AS (SELECT ps.user_id, ps.s, ps.e, scored, channel AS r FROM ps JOIN ma ON ma.user_id = ps.user_id AND ma.s <= ps.s AND ma.e >= ps.e), hs AS (SELECT ps.user_id, ps.s, ps.e, scored, channel AS h FROM ps JOIN mb ON mb.user_id = ps.user_id AND mb.s <= ps.s AND mb.e >= ps.e),
n AS (SELECT user_id, s, e, scored, sum(r)::BIGINT AS nr, sum(h)::BIGINT AS nh FROM (SELECT user_id, s, e, scored, 1 AS r, 0 AS h FROM rs UNION ALL SELECT user_id, s, e, scored, 0, 1 FROM hs) GROUP BY ALL),
pr AS (SELECT rs.user_id, r, h, sum(rs.e - rs.s) AS o, sum(CASE WHEN rs.scored THEN rs.e - rs.s ELSE 0 END) AS c FROM rs JOIN hs ON rs.user_id = hs.user_id AND rs.s = hs.s GROUP BY 1, 2, 3),
ch AS (SELECT list(DISTINCT channel) AS l FROM iv), pe AS (SELECT row_number() OVER () AS pid, * FROM (SELECT unnest(l) AS c1 FROM ch), (SELECT unnest(l) AS c2 FROM ch), (SELECT unnest(l) AS c3 FROM ch), (SELECT unnest(l) AS c4 FROM ch), (SELECT unnest(l) AS c5 FROM ch) WHERE len(list_distinct([c1, c2, c3, c4, c5])) = 5),
pm AS (SELECT pid, unnest(list_sort(l)) AS r, unnest([c1, c2, c3, c4, c5]) AS h FROM pe, ch),
tt AS (SELECT user_id, pid, sum(o) AS o, sum(c) AS c FROM pr JOIN pm USING (r, h) GROUP BY 1, 2), ok AS (SELECT user_id, arg_max(c, o) AS correct FROM tt GROUP BY 1),
k AS (SELECT user_id, sum(nr * (e - s)) AS scored, sum(greatest(nr - nh, 0) * (e - s)) AS miss, sum(greatest(nh - nr, 0) * (e - s)) AS false_alarm, sum(least(nr, nh) * (e - s)) AS m, 0 AS c FROM n WHERE scored GROUP BY 1 UNION ALL SELECT user_id, 0, 0, 0, 0, 0 FROM a UNION ALL SELECT user_id, 0, 0, 0, 0, correct FROM ok),
g AS (SELECT CASE WHEN grouping(user_id) = 1 THEN 'TOTAL' ELSE user_id::VARCHAR END AS user_id, sum(scored)::BIGINT AS scored, sum(miss)::BIGINT AS miss, sum(false_alarm)::BIGINT AS false_alarm, (sum(m) - sum(c))::BIGINT AS confusion FROM k GROUP BY ROLLUP (user_id))
SELECT *, round((miss + false_alarm + confusion) / nullif(scored, 0)::DOUBLE, 9) AS der FROM g""")
def diarization_error(spark, sf_dir):
    out = me.diarization_error(segments(spark, sf_dir, 0), segments(spark, sf_dir, 1), ["user_id"], collar=COLLAR)
    return out.withColumn("der", F.round("der", 9))


@query(f"""WITH {INTERVALS}, a AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 0), b AS (SELECT user_id, s, e FROM iv WHERE event_id % 2 = 1), {merged_sql('a', 0, 'ma')}, {merged_sql('b', 0, 'mb')},
ev AS (SELECT user_id, s AS t, 1 AS r, 0 AS h FROM ma UNION ALL SELECT user_id, e, -1, 0 FROM ma UNION ALL SELECT user_id, s, 0, 1 FROM mb UNION ALL SELECT user_id, e, 0, -1 FROM mb), pt AS (SELECT user_id, t, sum(r) AS r, sum(h) AS h FROM ev GROUP BY 1, 2),
sw AS (SELECT user_id, lead(t) OVER w - t AS d, sum(r) OVER x AS r, sum(h) OVER x AS h FROM pt WINDOW w AS (PARTITION BY user_id ORDER BY t), x AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
g AS (SELECT CASE WHEN grouping(user_id) = 1 THEN 'TOTAL' ELSE user_id::VARCHAR END AS user_id, sum(CASE WHEN r > 0 THEN d ELSE 0 END)::BIGINT AS scored, sum(CASE WHEN r > h THEN d ELSE 0 END)::BIGINT AS miss, sum(CASE WHEN r < h THEN d ELSE 0 END)::BIGINT AS false_alarm FROM sw WHERE d IS NOT NULL AND r + h > 0 GROUP BY ROLLUP (user_id))
SELECT *, round((miss + false_alarm) / nullif(scored, 0)::DOUBLE, 9) AS error_rate FROM g""")
def detection_error(spark, sf_dir):
    ref, hyp = segments(spark, sf_dir, 0), segments(spark, sf_dir, 1)
    region = ref.unionByName(hyp).groupBy("user_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = me.detection_error(hyp, ref, region, ["user_id"])
    return out.select("user_id", "scored", "miss", "false_alarm", F.round("error_rate", 9).alias("error_rate"))


@query(f"""WITH {INTERVALS}, r AS (SELECT user_id, count(DISTINCT channel) AS n FROM iv WHERE event_id % 2 = 0 GROUP BY 1), h AS (SELECT user_id, count(DISTINCT channel) AS n FROM iv WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, r.n AS n_ref, coalesce(h.n, 0) AS n_hyp, r.n = coalesce(h.n, 0) AS "right" FROM r LEFT JOIN h USING (user_id)""")
def speaker_counts(spark, sf_dir):
    return me.speaker_counts(segments(spark, sf_dir, 0), segments(spark, sf_dir, 1), ["user_id"])


@query(f"""WITH RECURSIVE {TURNS}, t AS (SELECT pair, list_filter(string_split(reference, ' '), lambda x: x <> '') AS r, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS h FROM tp),
c AS (SELECT pair, r, h, 0 AS i, range(0, len(h) + 1)::BIGINT[] AS cur FROM t
UNION ALL SELECT pair, r, h, i + 1, list_transform(range(1, len(h) + 2), lambda j: j - 1 + list_min(step[1:j])) FROM (SELECT *, list_transform(range(0, len(h) + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(cur[k + 1] + 1, cur[k] + CASE WHEN r[i + 1] = h[k] THEN 0 ELSE 1 END) END - k) AS step FROM c WHERE i < len(r)))
SELECT pair, len(r)::INT AS n_ref, cur[-1]::INT AS n_err, round(CASE WHEN len(r) > 0 THEN cur[-1] / len(r)::DOUBLE WHEN cur[-1] > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS rate FROM c WHERE i = len(r)""")
def word_error_counts(spark, sf_dir):
    return me.error_counts(turns(spark, sf_dir), "reference", "hypothesis").select("pair", "n_ref", "n_err", F.round("rate", 9).alias("rate"))


@query(f"""WITH {TURNS} SELECT pair, length(reference) AS n_ref, levenshtein(reference, hypothesis) AS n_err, round(CASE WHEN length(reference) > 0 THEN levenshtein(reference, hypothesis) / length(reference)::DOUBLE WHEN length(hypothesis) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS rate FROM tp""")
def character_error_counts(spark, sf_dir):
    return me.error_counts(turns(spark, sf_dir), "reference", "hypothesis", by_character=True).select("pair", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_err").cast("long").alias("n_err"), F.round("rate", 9).alias("rate"))


@query()
def session_cpwer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    side = lambda parity: c.where(F.col("turn") % 2 == parity).groupBy("conv_id", F.col("role").alias("speaker")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return me.cpwer(side(0), side(1), "conv_id")


@query(f"""WITH {TURNS}, g AS (SELECT pair, unnest(list_filter(string_split(reference, ' '), lambda x: x <> '')) AS w, 1 AS k FROM tp UNION ALL SELECT pair, unnest(list_filter(string_split(hypothesis, ' '), lambda x: x <> '')), 0 FROM tp),
c AS (SELECT pair, w, sum(k) AS r, sum(1 - k) AS h FROM g GROUP BY 1, 2) SELECT pair, 1 AS n, sum(least(r, h))::BIGINT AS matches, sum(h)::BIGINT AS total FROM c WHERE h > 0 GROUP BY 1""")
def unigram_matches(spark, sf_dir):
    return me.ngram_matches(turns(spark, sf_dir), "pair", "reference", "hypothesis", 1)


@query(f"""WITH {TURNS}, t AS (SELECT pair, list_filter(string_split(reference, ' '), lambda x: x <> '') AS r, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') AS h FROM tp),
g AS (SELECT pair, 1 AS n, unnest(r) AS g, 1 AS k FROM t UNION ALL SELECT pair, 1, unnest(h), 0 FROM t UNION ALL SELECT pair, 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 1 FROM t UNION ALL SELECT pair, 2, unnest(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])), 0 FROM t),
c AS (SELECT pair, n, g, sum(k) AS r, sum(1 - k) AS h FROM g GROUP BY 1, 2, 3), m AS (SELECT n, (sum(least(r, h)) + (n > 1)::INT) / (sum(h) + (n > 1)::INT)::DOUBLE AS p FROM c WHERE h > 0 GROUP BY 1), l AS (SELECT sum(len(h))::BIGINT AS len_hyp, sum(len(r))::BIGINT AS len_ref FROM t)
SELECT len_hyp, len_ref, round(CASE WHEN len_hyp >= len_ref THEN 1 ELSE exp(1 - len_ref / len_hyp::DOUBLE) END * (SELECT exp(avg(ln(p))) FROM m), 9) AS bleu FROM l""")
def corpus_bleu(spark, sf_dir):
    return me.bleu(turns(spark, sf_dir), "pair", "reference", "hypothesis", 2, smooth=True).withColumn("bleu", F.round("bleu", 9))


@query(f"""WITH {SCORED}, p AS (SELECT source, score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY 1, 2), u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT source, round(CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (b + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) ELSE 0.5 END, 9) AS auc FROM u GROUP BY 1""")
def auc_by_source(spark, sf_dir):
    return me.auc_roc(scored(spark, sf_dir), "source").select("source", F.round("auc", 9).alias("auc"))


@query(f"""WITH {SCORED}, p AS (SELECT score, sum(label) AS p, count(*) AS c FROM sc GROUP BY 1), u AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k FROM p WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p * tp / k::DOUBLE) / sum(p), 9) AS average_precision FROM u""")
def average_precision(spark, sf_dir):
    return me.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {SCORED}, b AS (SELECT source, ceil(score * 10) AS bin, score, CASE WHEN (score >= (ceil(score * 10) - 0.5) / 10)::INT = label THEN 1.0::DOUBLE ELSE 0 END AS ok FROM sc WHERE score > 0),
p AS (SELECT source, bin, count(*) AS n, avg(ok) AS a, avg(score) AS c FROM b GROUP BY 1, 2), t AS (SELECT source, count(*) AS t FROM sc GROUP BY 1) SELECT source, round(sum(abs(a - c) * n / t::DOUBLE), 9) AS ece FROM p JOIN t USING (source) GROUP BY 1""")
def calibration_error(spark, sf_dir):
    return me.calibration_error(scored(spark, sf_dir), "source").select("source", F.round("ece", 9).alias("ece"))


@query(f"""WITH {SCORED}, c AS (SELECT label, (score >= 0.5)::INT AS predicted FROM sc), s AS (SELECT label::VARCHAR AS class, (label = predicted)::INT AS tp, 0 AS fp, (label <> predicted)::INT AS fn FROM c UNION ALL SELECT predicted::VARCHAR, 0, 1, 0 FROM c WHERE label <> predicted),
p AS (SELECT class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM s GROUP BY 1), m AS (SELECT * FROM p UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM p),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS c FROM m), f AS (SELECT *, CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END AS f FROM r)
SELECT class, tp, fp, fn, round(p, 9) AS precision, round(c, 9) AS recall, round(f, 9) AS f1 FROM f UNION ALL SELECT 'macro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(p), 9), round(avg(c), 9), round(avg(f), 9) FROM f WHERE class <> 'micro'""")
def classification_report(spark, sf_dir):
    rows = scored(spark, sf_dir).select("label", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    out = me.classification_report(rows)
    return out.select("class", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH s AS (SELECT source, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1) SELECT source, round(pow(chars::DOUBLE, 0.5) / sum(pow(chars::DOUBLE, 0.5)) OVER (), 9) AS share FROM s""")
def temperature_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return sa.temperature_weights(rows, "chars", 0.5).select("source", F.round("share", 9).alias("share"))


@query("SELECT doc_id, CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 2000 THEN 2 WHEN n_chars <= 5000 THEN 3 END AS bucket FROM documents")
def duration_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sa.bucket(F.col("n_chars"), [500, 1000, 2000, 5000]).alias("bucket"))


@query("SELECT doc_id, CASE WHEN n_chars <= 1000 THEN CASE WHEN doc_id % 50 <= 20 THEN 0 WHEN doc_id % 50 <= 40 THEN 1 END WHEN n_chars <= 4000 THEN CASE WHEN doc_id % 50 <= 30 THEN 2 WHEN doc_id % 50 <= 45 THEN 3 END END AS bucket FROM documents")
def buckets_2d(spark, sf_dir):
    edges = [(1000, 20), (1000, 40), (4000, 30), (4000, 45)]
    return table(spark, sf_dir, "documents").select("doc_id", sa.bucket_2d(F.col("n_chars"), F.col("doc_id") % 50, edges).alias("bucket"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 16 AS batch FROM documents")
def fixed_batches(spark, sf_dir):
    out = sa.fixed_batches(table(spark, sf_dir, "documents"), ["source"], 16, F.col("n_chars").desc(), F.col("doc_id"))
    return out.select("doc_id", "source", "batch")


@query("""WITH RECURSIVE d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), b AS (SELECT *, 0::BIGINT AS batch, 1 AS n, n_chars AS most FROM d WHERE i = 1
UNION ALL SELECT doc_id, source, n_chars, i, batch + fresh, CASE WHEN fresh = 1 THEN 1 ELSE n + 1 END, CASE WHEN fresh = 1 THEN n_chars ELSE greatest(most, n_chars) END FROM (SELECT d.*, b.batch, b.n, b.most, ((b.n + 1) * greatest(b.most, d.n_chars) > 20000)::INT AS fresh FROM b JOIN d ON d.source IS NOT DISTINCT FROM b.source AND d.i = b.i + 1))
SELECT doc_id, source, n_chars, batch FROM b""")
def budget_batches(spark, sf_dir):
    return sa.budget_batches(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], "n_chars", "doc_id", 20_000.0)


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def top_documents(spark, sf_dir):
    return sa.top_k(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], 3, F.col("n_chars").desc(), F.col("doc_id"))


VECTORS = "v AS (SELECT vec_id, label, vec_id // 50 AS session, embedding::DOUBLE[] AS x FROM embeddings)"


def sessions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("session", F.floor(F.col("vec_id") / 50))


@query(f"""WITH {VECTORS}, u AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v) SELECT a.session, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round(list_dot_product(a.x, b.x) / (a.n * b.n), 6) END AS sim FROM u a JOIN u b USING (session)""")
def session_affinity(spark, sf_dir):
    return ve.affinity(sessions(spark, sf_dir), ["session"], "vec_id", "embedding").select("session", "i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH {VECTORS}, u AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v), s AS (SELECT a.session, a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round(list_dot_product(a.x, b.x) / (a.n * b.n), 6) END AS sim FROM u a JOIN u b USING (session)),
t AS (SELECT session, i, j FROM s QUALIFY row_number() OVER (PARTITION BY session, i ORDER BY sim DESC, j) <= 5), b AS (SELECT * FROM t UNION ALL SELECT session, j, i FROM t) SELECT session, i, j, count(*) / 2.0::DOUBLE AS weight FROM b GROUP BY 1, 2, 3""")
def affinity_graph(spark, sf_dir):
    sims = ve.affinity(sessions(spark, sf_dir), ["session"], "vec_id", "embedding").withColumn("sim", F.round("sim", 6))
    return ve.affinity_graph(sims, ["session"], 5)


@query("SELECT label, i, round(sqrt(0) + m, 6) AS x FROM (SELECT label, i, avg(x / n) AS m FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) GROUP BY 1, 2)")
def mean_vectors(spark, sf_dir):
    unit = table(spark, sf_dir, "embeddings").withColumn("embedding", ve.normalized(F.col("embedding")))
    out = ve.mean_vector(unit, ["label"], "embedding", unit=False)
    return out.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query()
def cluster_sessions(spark, sf_dir):
    return ve.cluster_sessions(sessions(spark, sf_dir), "session", "vec_id", "embedding")


@query()
def linkage_sessions(spark, sf_dir):
    return ve.cluster_sessions(sessions(spark, sf_dir), "session", "vec_id", "embedding", "linkage", threshold=0.6, most=8)


@query()
def long_session_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("session", F.lit(0).cast("long"))
    return ve.cluster_long_sessions(rows, "session", "vec_id", "embedding", 100, 10)
