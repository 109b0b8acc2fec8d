"""Signals, prompts, tags, assignments and preparation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import signal as sg
from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import intervals as iv
from ..operators import joins as jo
from ..operators import metrics as me
from ..operators import sampling as sa
from ..operators import statistics as st
from . import pipelines
from .registration import Registry
from .source_queries import REL, relative
from .views import table

REGISTRY = Registry()
query = REGISTRY.query


def exploded(df, key, column, digits=9):
    return df.select(key, F.posexplode(column).alias("place", "x")).select(key, "place", F.round("x", digits).alias("x"))


X = "x AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS x FROM embeddings)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("x"))


@query("SELECT doc_id FROM documents WHERE n_chars / 1000.0::DOUBLE >= 1.5 AND (doc_id % 10) / 10.0::DOUBLE >= 0.3")
def evidence_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(pr.evidence([(F.col("n_chars") / 1000.0, 1.5), ((F.col("doc_id") % 10) / 10.0, 0.3), (F.lit(0.0), 0.0)])).select("doc_id")


@query(f"WITH {X}, y AS (SELECT vec_id, list_transform(x, lambda v: round(v * pow(10, 6 / 20.0::DOUBLE), 9)) AS y FROM x) SELECT vec_id, i::INT AS place, y[i + 1] AS x FROM y, range(0, 16) t(i)")
def gained_samples(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).withColumn("x", sg.gained(F.col("x"), F.lit(6.0))), "vec_id", "x")


@query(f"WITH {X}, y AS (SELECT vec_id, list_concat([0.0, 0.0], list_concat(x, [0.0])) AS y FROM x) SELECT vec_id, i::INT AS place, round(y[i + 1]::DOUBLE, 9) AS x FROM y, range(0, 19) t(i)")
def padded_samples(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).withColumn("x", sg.silence_padded(F.col("x"), 2, 1)), "vec_id", "x")


@query(f"WITH {X} SELECT vec_id, i::INT AS place, round(CASE WHEN i < 3 THEN 0 ELSE x[i - 2] END, 9) AS later, round(CASE WHEN i > 10 THEN 0 ELSE x[i + 6] END, 9) AS earlier FROM x, range(0, 16) t(i)")
def shifted_samples(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", F.arrays_zip(sg.shifted(F.col("x"), 3).alias("later"), sg.shifted(F.col("x"), -5).alias("earlier")).alias("z"))
    return v.select("vec_id", F.posexplode("z").alias("place", "z")).select("vec_id", "place", F.round("z.later", 9).alias("later"), F.round("z.earlier", 9).alias("earlier"))


@query(f"WITH {X} SELECT vec_id, i::INT AS place, round(CASE WHEN i < 32 THEN x[i % 16 + 1] ELSE x[i - 32 + 12] END, 9) AS x FROM x, range(0, 37) t(i)")
def tiled_samples(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).withColumn("x", sg.tiled(F.col("x"), F.lit(37))), "vec_id", "x")


@query(f"WITH {X}, y AS (SELECT vec_id, x[floor((vec_id % 5) / 10.0::DOUBLE * 10)::INT + 1 : floor(1.2::DOUBLE * 10)::INT] AS y FROM x) SELECT vec_id, unnest(generate_series(0, len(y) - 1))::INT AS place, round(unnest(y), 9) AS x FROM y")
def cut_samples(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).withColumn("x", sg.cut_seconds(F.col("x"), (F.col("vec_id") % 5) / 10.0, F.lit(1.2), 10)), "vec_id", "x")


@query(f"WITH {REL} SELECT event_id, greatest(s - 400, 0) AS start, least(s + d + 400, 86400000) AS \"end\" FROM rl")
def padded_ranges(spark, sf_dir):
    r = relative(spark, sf_dir).withColumn("p", sg.padded_range(F.col("s"), F.col("s") + F.col("d"), F.lit(86_400_000), 1000, 0.4))
    return r.select("event_id", "p.start", "p.end")


@query(f"WITH {X}, p AS (SELECT vec_id, unnest(list_transform(x, lambda v: abs(v) / list_sum(list_transform(x, lambda w: abs(w))))) AS p FROM x), h AS (SELECT vec_id, exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS e FROM p GROUP BY 1) SELECT round(avg(e), 6) AS perplexity FROM h")
def mean_perplexity(spark, sf_dir):
    total = F.aggregate(F.transform("x", F.abs), F.lit(0.0), lambda a, v: a + v)
    probs = F.flatten(F.transform(F.array(total), lambda t: F.transform("x", lambda v: F.abs(v) / t)))
    return st.mean_perplexity(vectors(spark, sf_dir).withColumn("x", probs), "x").select(F.round("perplexity", 6).alias("perplexity"))


@query("SELECT role, sum((trim(CASE WHEN turn % 4 = 0 THEN '  ' ELSE coalesce(text, '') END) = '')::INT)::BIGINT AS empty, round(avg((trim(CASE WHEN turn % 4 = 0 THEN '  ' ELSE coalesce(text, '') END) = '')::INT), 9) AS rate FROM conversations GROUP BY 1")
def empty_rates(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 0, "  ").otherwise(F.col("text")))
    return me.empty_rate(c, "text", "role").select("role", "empty", F.round("rate", 9).alias("rate"))


LETTERS = "substr('ABCD', (doc_id % 4)::INT + 1, 1)"


@query(f"SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN {LETTERS} END AS letter FROM documents")
def answer_letters(spark, sf_dir):
    letter = F.substring(F.lit("ABCD"), 1, 4).substr((F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    said = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("I think the answer is ("), letter, F.lit(") for sure")))
    said = said.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("option "), F.lower(letter), F.lit(", or so")))
    said = said.when(F.col("doc_id") % 6 == 2, F.concat(letter, F.lit(") it is"))).when(F.col("doc_id") % 6 == 3, F.concat(F.lit(" "), letter, F.lit(" ")))
    said = said.when(F.col("doc_id") % 6 == 4, F.concat(F.lit("maybe ("), letter, F.lit(")"))).otherwise("no idea at all")
    return table(spark, sf_dir, "documents").select("doc_id", pr.answer_letter(said).alias("letter"))


@query("SELECT conv_id, turn, role || ': ' || coalesce(text, '') || chr(10) AS prompt FROM conversations")
def chat_prompts(spark, sf_dir):
    return tx.apply_prompt(table(spark, sf_dir, "conversations"), "chat").select("conv_id", "turn", "prompt")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'assistant: ctx' ELSE 'user: ' || coalesce(lang, '?') END AS first, (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + 1 + (source IS NOT NULL)::INT)::INT AS n FROM documents")
def prompt_turns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    turns = tx.conversation_turns(F.coalesce("lang", F.lit("?")), F.col("source"), context=F.when(F.col("doc_id") % 2 == 0, F.lit("ctx")))
    turns = F.when(F.col("doc_id") % 2 == 0, tx.swap_roles(turns)).otherwise(turns)
    return d.select("doc_id", turns.alias("t")).select("doc_id", tx.render_turn("|role|: |value|", role=F.col("t")[0]["role"], value=F.col("t")[0]["value"]).alias("first"), F.size("t").alias("n"))


@query("SELECT doc_id, length(strip_accents(text)) AS n, md5(strip_accents(text)) AS digest FROM documents")
def folded_accents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.compose(tx.fold_accents(F.col("text"))).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


TAGGED = "w AS (SELECT conv_id, (turn % 3)::INT AS speaker, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word FROM conversations WHERE text IS NOT NULL)"


def tagged(spark, sf_dir):
    """Conversations as one text with a speaker tag before each turn."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    turn = F.struct("turn", F.concat(F.lit("<|spltoken"), F.col("turn") % 3, F.lit("|> "), "text").alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]), " ").alias("text"))


@query(f"WITH {TAGGED} SELECT conv_id, speaker, count(*) AS n, sum(length(word))::BIGINT AS chars FROM w GROUP BY 1, 2")
def tagged_words(spark, sf_dir):
    words = tx.tagged_words(tagged(spark, sf_dir), "conv_id", "text")
    return words.groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars"))


@query(f"WITH {TAGGED}, p AS (SELECT conv_id, speaker, sum(length(word)) AS c FROM w WHERE speaker < 2 GROUP BY 1, 2) SELECT conv_id, speaker, round(c / sum(c) OVER (PARTITION BY conv_id)::DOUBLE, 9) AS share FROM p")
def speaker_shares(spark, sf_dir):
    return tx.speaker_character_shares(tagged(spark, sf_dir), "conv_id", "text", 2).select("conv_id", "speaker", F.round("share", 9).alias("share"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<|spltoken1|> x' ELSE '<|spltoken0|> ' || role END AS text FROM conversations")
def ensured_tags(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.ensure_speaker_tag(F.when(F.col("turn") % 2 == 0, "<|spltoken1|> x").otherwise(F.col("role"))).alias("text"))


@query(f"""WITH {REL}, a AS (SELECT user_id, event_type AS r, event_id, s, s + d AS e FROM rl WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type AS h, s, s + d AS e FROM rl WHERE event_id % 2 = 1),
o AS (SELECT user_id, r, h, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS o FROM a JOIN b USING (user_id) WHERE greatest(a.s, b.s) < least(a.e, b.e) GROUP BY 1, 2, 3),
ch AS (SELECT list(DISTINCT event_type) AS l FROM rl), pe AS (SELECT row_number() OVER () AS pid, * FROM (SELECT unnest(l) AS c1 FROM ch), (SELECT unnest(l) AS c2 FROM ch), (SELECT unnest(l) AS c3 FROM ch), (SELECT unnest(l) AS c4 FROM ch), (SELECT unnest(l) AS c5 FROM ch) WHERE len(list_distinct([c1, c2, c3, c4, c5])) = 5),
pm AS (SELECT pid, unnest(list_sort(l)) AS r, unnest([c1, c2, c3, c4, c5]) AS h FROM pe, ch), t AS (SELECT user_id, pid, sum(o)::DOUBLE AS o FROM o JOIN pm USING (r, h) GROUP BY 1, 2) SELECT user_id, max(o) AS matched FROM t GROUP BY 1""")
def speaker_assignment(spark, sf_dir):
    r = relative(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("speaker"), F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    both = jo.range_join(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), ["user_id"], 600_000)
    scores = both.groupBy("user_id", "speaker_l", "speaker_r").agg(F.sum(F.col("o_end") - F.col("o_start")).cast("double").alias("o"))
    return jo.assign(scores, ["user_id"], "speaker_l", "speaker_r", "o").groupBy("user_id").agg(F.sum("o").alias("matched"))


@query(f"""WITH {REL}, w AS (SELECT event_id, user_id, s // 60000 AS a, greatest((s + d) // 60000, s // 60000) AS b FROM rl), f AS (SELECT event_id, user_id, unnest(generate_series(a, b)) AS frame FROM w), p AS (SELECT event_id, spk, avg(((frame * 7 + spk * 31 + user_id) % 101)::DOUBLE) AS p FROM f, (SELECT unnest([0, 1, 2]) AS spk) GROUP BY 1, 2)
SELECT event_id, arg_max(spk, (p, -spk))::INT AS spk FROM p GROUP BY 1""")
def word_speakers(spark, sf_dir):
    r = relative(spark, sf_dir).select("event_id", "user_id", F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    frame = lambda c: F.floor(F.col(c) / 60_000).cast("int")
    grid = r.select("user_id", F.explode(F.sequence(frame("start"), F.greatest(frame("start"), frame("end")))).alias("frame")).distinct()
    probs = grid.withColumn("spk", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("prob", ((F.col("frame") * 7 + F.col("spk") * 31 + F.col("user_id")) % 101).cast("double"))
    return jo.word_speakers(r, probs, ["user_id"], 60_000).select("event_id", "spk")


@query(f"""WITH {REL}, t AS (SELECT user_id, s + 2 AS s, s + d AS e FROM rl), a AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM t WHERE e > s),
b AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT user_id, round((min(s) - 2) / 1000.0::DOUBLE, 3) AS start, round(max(e) / 1000.0::DOUBLE, 3) AS "end" FROM b GROUP BY user_id, i""")
def merged_float_intervals(spark, sf_dir):
    r = relative(spark, sf_dir).select("user_id", (F.col("s") / 1000.0).alias("start"), ((F.col("s") + F.col("d")) / 1000.0).alias("end"))
    return iv.merge_scaled(r, ["user_id"], 3)


@query("""WITH k AS (SELECT CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 2000 THEN 2 WHEN n_chars <= 5000 THEN 3 END AS bucket, row_number() OVER (PARTITION BY CASE WHEN n_chars <= 500 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 2000 THEN 2 WHEN n_chars <= 5000 THEN 3 END) AS i FROM documents WHERE n_chars BETWEEN 100 AND 4000 AND lang = 'en')
SELECT bucket, (i - 1) // 32 AS batch, count(*) AS n FROM k GROUP BY 1, 2""")
def prepared_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    out = pipelines.prepare(rows, "doc_id", "n_chars", 100, 4000, [500, 1000, 2000, 5000], 32, ".lang == en")
    return out.groupBy("bucket", F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), d AS (SELECT source, count(*) AS scored, sum((lang = 'en')::INT) AS wrong FROM documents WHERE source IS NOT NULL GROUP BY 1), w AS (SELECT source, sum(n_chars)::BIGINT AS n_ref, sum(n_chars % 7)::BIGINT AS errors FROM documents WHERE source IS NOT NULL AND lang = 'fr' GROUP BY 1),
b AS (SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, sum(scored)::BIGINT AS scored, sum(wrong)::BIGINT AS wrong, sum(coalesce(n_ref, 0))::BIGINT AS n_ref, sum(coalesce(errors, 0))::BIGINT AS errors FROM d LEFT JOIN w USING (source) GROUP BY ROLLUP (source)) SELECT *, round(CASE WHEN scored > 0 THEN wrong / scored::DOUBLE END, 9) AS der, round(CASE WHEN n_ref > 0 THEN errors / n_ref::DOUBLE END, 9) AS wer FROM b""")
def error_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    der = d.groupBy("source").agg(F.count(F.lit(1)).alias("scored"), F.sum((F.col("lang") == "en").cast("long")).alias("wrong"))
    words = d.where("lang = 'fr'").groupBy("source").agg(F.sum("n_chars").alias("n_ref"), F.sum(F.col("n_chars") % 7).alias("errors"))
    return ev.report(der, words, "source").withColumns({"der": F.round("der", 9), "wer": F.round("wer", 9)})


@query("WITH p AS (SELECT nation.n_nationkey AS row, [n_name, n_name || '2'] AS speakers FROM nation), n AS (SELECT count(*) AS n FROM p) SELECT event_id, speakers[1] AS first, speakers[2] AS second FROM events, n JOIN p ON p.row = event_id % n")
def session_speakers(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.array("n_name", F.concat("n_name", F.lit("2"))).alias("speakers"))
    out = sa.session_speakers(table(spark, sf_dir, "events").select("event_id"), p, "event_id")
    return out.select("event_id", F.col("speakers")[0].alias("first"), F.col("speakers")[1].alias("second"))


@query("SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [1, 3, 5, 6, 8] ELSE [1, 3, 5, 7, 9] END) AS step FROM documents")
def merged_steps(spark, sf_dir):
    second = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(7), F.lit(9)))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.merged_steps(F.array(F.lit(1), F.lit(3), F.lit(5)), second)).alias("step"))


@query("SELECT doc_id, ceil(n_chars / 80.0::DOUBLE)::BIGINT AS tokens, regexp_replace(source, '_dup\\d+$', '') AS key FROM documents")
def audio_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pr.audio_tokens(F.col("n_chars"), 80.0).cast("long").alias("tokens"), pr.item_key(F.col("source")).alias("key"))


@query(f"WITH {REL} SELECT user_id, event_id, s AS start, least(s + d, 70000000) AS \"end\" FROM rl WHERE s < least(s + d, 70000000)")
def clamped_regions(spark, sf_dir):
    r = relative(spark, sf_dir).select("user_id", "event_id", F.col("s").alias("start"), (F.col("s") + F.col("d")).alias("end"))
    m = r.select("user_id").distinct().withColumns({"offset": F.lit(0), "duration": F.lit(70_000_000)})
    out = ev.clamped(r, m, ["user_id"])
    return out.select("user_id", "event_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
