"""Chat formatting by quotation linking.

A message's lines carry nested quote levels (leading '>' signs). Its own lines and its quoted passages are normalised and hashed; a quoted
passage joins the earlier message of the conversation whose own text, paragraph, line or sentence it is. The latest message that has the longest such unit
is what the quoting one replies to. Replies form threads; a message's place in reply order is the path of turns from its thread's first message, found by
pointer doubling, so no long conversation is gathered in one task. Quotes are left out of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, cut, drop_cut, table

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: Lines such as "On Monday, A wrote:" that introduce a quote; one right before a quote goes with it.
INTRODUCTION = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)


#: Sentences end at these marks before white space, or after those of scripts without spaces.
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


def normalised(text: str) -> str:
    return " ".join(text.split()).casefold()


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def levels(text: str) -> list[tuple[int, str]]:
    """(level, passage) of the runs of lines with one quote level, in order; level 0 is the message's own."""
    out: list[tuple[int, list[str]]] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        m = MARKS.match(line)
        level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            if level and out and out[-1][0] == 0 and INTRODUCTION.match(out[-1][1][-1]):
                out[-1][1].pop()
            out.append((level, [rest]))
    return [(level, "\n".join(lines)) for level, lines in out if any(x.strip() for x in lines)]


def units(passage: str) -> list[str]:
    """What of a passage can be quoted: all of it, its paragraphs, lines and sentences, however they were wrapped; normalised, none of them empty."""
    paragraphs = re.split(r"\n\s*\n", passage)
    parts = [passage, *paragraphs, *passage.split("\n"), *(x for p in paragraphs for x in SENTENCE.split(p))]
    return [x for x in dict.fromkeys(map(normalised, parts)) if x]


def parse(text: str) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """(own text, hashes of what can be quoted, (level, number, size, hash) of the quoted passages' units)."""
    own, quoted = [], []
    for level, passage in levels(text):
        if level:
            quoted.append((level, passage))
        else:
            own.append(passage.strip("\n"))
    clean = "\n".join(own)
    offered = sorted({digest(u) for p in [clean, *own] for u in units(p)})
    return clean, offered, [(level, i, len(u), digest(u)) for i, (level, passage) in enumerate(quoted) for u in units(passage)]


PARSED = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType())]))


def parsed(messages: DataFrame, text: str) -> DataFrame:
    """messages plus own_text, offered (hashes) and quoted (level, number, size, hash)."""
    arrow_batches(messages.sparkSession)
    schema = T.StructType([*messages.schema.fields, T.StructField("own_text", T.StringType()), T.StructField("offered", T.ArrayType(T.LongType())), T.StructField("quoted", PARSED)])
    kind = pa.list_(pa.struct([("level", pa.int32()), ("number", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t or "") for t in batch.column(text).to_pylist()]
            quoted = [[dict(zip(("level", "number", "size", "hash"), x, strict=True)) for x in q] for _, _, q in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _, _ in found], pa.string()), pa.array([o for _, o, _ in found], pa.list_(pa.int64())), pa.array(quoted, kind)], schema.names)

    return messages.mapInArrow(run, schema)


def link_quotes(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, reply_to, depth, reply_path, n_quotes, n_linked, text) of every row; text is without quotes.

    reply_to: the turn that a quoted passage comes from, the latest earlier one of the conversation that has the longest of the passage's units that any has; of
    several passages that of the outermost level, then the latest turn. Without one a message starts a thread (null). depth counts the replies above it.
    reply_path: the turns from the thread's start to the message; conversations in this order are reply-ordered. n_quotes: quoted passages, n_linked: those
    found. Null text is empty. Rows that repeat (conv_id, turn) may all be quoted and share the turn's place. Turns are whole numbers. Null conv_id or turn: no links, a thread of its own. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = cut(parsed(rows, "text").drop("text"), "messages")
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    offered = placed.select("conv_id", "turn", F.explode("offered").alias("hash"), F.col("turn").alias("source"))
    quoted = placed.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    # the latest earlier offer as a running maximum, not a join: short passages are offered and quoted by many messages. A turn's quotes come before its offers
    both = quoted.unionByName(offered.distinct(), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "hash").orderBy("turn", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("source", F.max("source").over(before)).where("number IS NOT NULL AND source IS NOT NULL")
    latest = found.groupBy("conv_id", "turn", "level", "number").agg(F.max(F.struct("size", "source"))["source"].alias("source"))
    link = latest.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("source")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("n_linked"))
    link = cut(link.select("conv_id", "turn", (-F.col("best.back")).alias("reply_to"), "n_linked"), "links")
    path = reply_paths(link.select("conv_id", "turn", "reply_to"))
    out = rows.join(link, ["conv_id", "turn"], "left").join(path, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("path", F.array(F.col("turn").cast("long"))).alias("reply_path"),
        F.size(F.array_distinct(F.transform("quoted", lambda q: q["number"]))).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own_text").alias("text"),
    )


def reply_paths(link: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, path) of the messages that reply, by doubling: each round joins a message to the ancestor it has reached."""
    place = lambda c: F.array(F.col(c).cast("long"))
    state = cut(link.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth"), place("turn").alias("path")), "paths")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("path").alias("path2"))
        if not state.join(above, ["conv_id", "up"], "left_semi").limit(1).count():
            break
        joined = state.join(above, ["conv_id", "up"], "left")
        more = F.col("up2").isNotNull()
        further = cut(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.when(more, F.concat("path2", "path")).otherwise(F.col("path")).alias("path")), "paths")
        drop_cut(state)
        state = further
    return state.select("conv_id", "turn", "depth", F.concat(place("up"), "path").alias("path"))


def threads(linked: DataFrame, most: int = 10_000) -> DataFrame:
    """(conv_id, thread, part, messages) of link_quotes's rows: the conversations, one thread a row, messages (turn, depth, role, text) in reply order.

    thread: the turn that starts it (null for messages without a turn or conversation, which are threads of their own). A thread of more than most messages goes
    on in further parts, in order, so that no row grows without bound.
    """
    order = Window.partitionBy("conv_id", "thread", "alone").orderBy("reply_path")
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.monotonically_increasing_id())
    placed = linked.withColumns({"thread": F.get("reply_path", F.lit(0)), "alone": alone}).withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumn("part", (F.col("place") / most).cast("int"))
    grouped = placed.groupBy("conv_id", "thread", "alone", "part").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "depth", "role", "text"))).alias("rows"))
    return grouped.select("conv_id", "thread", "part", F.transform("rows", lambda x: F.struct(*(x[c].alias(c) for c in ("turn", "depth", "role", "text")))).alias("messages"))


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
