"""Text, predicates and stream operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import text as tx
from ..operators import sampling as sa
from ..streaming import stateful as sf
from .registration import Registry
from .views import INTERVALS, intervals, table

REGISTRY = Registry()
query = REGISTRY.query


@query("""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(translate(text, '.,?!;:', '')), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS plain FROM conversations""")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.plain(F.col("text")).alias("plain"))


@query("SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '' GROUP BY 1")
def character_vocabulary(spark, sf_dir):
    return tx.character_vocabulary(table(spark, sf_dir, "conversations"), "text")


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words, strlen(text) AS n_bytes FROM documents")
def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.regex_tokens(F.col("text"), "[A-Za-z]+")).cast("long").alias("n_words"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT item_id, left(text, length(text) - 1) || '!' AS text FROM benchmark WHERE text LIKE '%.'")
def replace_last_mark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where(F.col("text").endswith(".")).select("item_id", tx.replace_last(F.col("text"), ".", "!").alias("text"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars BETWEEN 200 AND 5000 AND (quality IS NULL OR quality = 1) AND coalesce(toxic <= 0, true)")
def row_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(pr.duration_between(F.col("n_chars"), 200, 5000) & pr.equal_or_missing(F.col("quality"), 1) & pr.at_most_or_missing(F.col("toxic"), 0)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'en' AND NOT source = 'src0') OR ((lang = 'fr') <> (source = 'src1'))")
def constraint_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(pr.constraint(".lang == en and not .source == src0 or (.lang == fr xor .source == src1)")).select("doc_id")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM pages")
def path_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pr.stem(F.col("url")).alias("stem"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), x AS (SELECT doc_id, w, unnest(generate_series(0, (len(w) - 1) // 10)) AS i FROM t WHERE len(w) > 0) SELECT doc_id, i::INT AS "window", array_to_string(w[i * 10 + 1 : i * 10 + 10], ' ') AS words FROM x""")
def token_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.word_tokens(F.col("text")).alias("words"))
    return sa.token_windows(rows, "words", 10).select("doc_id", "window", F.array_join("words", " ").alias("words"))


@query(f"WITH {INTERVALS}, x AS (SELECT user_id, s // 60000000 AS step FROM iv), n AS (SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY step) AS nx FROM x) SELECT user_id, step + 1 + 15 AS eou FROM n WHERE nx - step - 1 > 30")
def utterance_ends(spark, sf_dir):
    rows = intervals(spark, sf_dir).select("user_id", F.floor(F.col("start") / 60_000_000).alias("step"))
    return sf.endpoints(rows, "user_id", 30)


@query("SELECT user_id, event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.window(F.col("ts"), "1 hour")
    us = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(w.start AS TIMESTAMP_NTZ))")
    return e.groupBy("user_id", "event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", "event_type", us.alias("start"), "n", "total")


@query("""WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(w.start AS TIMESTAMP_NTZ))")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", us.alias("start"), "n")
