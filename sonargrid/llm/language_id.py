"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of length 0 to ORDER with the counts of the byte that followed. A byte costs
-log2 of its probability in the longest context the tree holds; a byte unseen there pays the escape (method C) and is looked up one byte shorter,
down to the uniform distribution. No context is left out. Statistics are frozen, so all costs are computed once: the contexts of up to TOGETHER
languages are the states of one automaton (the state after a byte is the longest known suffix). Its transitions are kept for the bytes that follow a
context only, in a hash table, with the costs by language; other bytes pay the escape and are looked up from the context one byte shorter.
So a model grows in proportion to what was learned, and a language's code lengths don't depend on the others.

Documents are scored whole. Long ones are split into lanes that start ORDER bytes early, which restores the state exactly, and all
lanes of a batch step through their bytes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, bytes_of, slices, table

ORDER = 4
#: Training sample: of each language the labelled documents that come first by hash, whole, within both bounds; those that do not fit are skipped.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 600_000
#: Languages that share an automaton.
TOGETHER = 8
#: Cells (states x kinds of bytes) of the look-up tables that a worker unfolds from its model at most; automata beyond that are looked up by hash.
TABLE_CELLS = 16_000_000
LANE = 1024
NO_LANGUAGE = "und"


def training_sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Texts by language, bounded by docs and size for each language. Ranks are taken over slim rows; only the chosen texts reach the driver."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = usable.select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.xxhash64("doc_id", "text").alias("h"))
    # about four times as many candidates as wanted, by hash, so that no language's rows meet in one task
    share = rows.groupBy("lang").agg((F.lit(4.0 * docs) / F.count(F.lit(1))).alias("share"))  # one row per language
    draw = (F.shiftrightunsigned(F.xxhash64("h"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.join(F.broadcast(share), "lang").where(draw < F.col("share")).drop("share")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs)
    # a text that does not fit is skipped, not all that come after it; if none fits, the first is taken, its beginning. A language has docs rows here at most
    ranked = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "h", "bytes"))).alias("ranked"))

    def fit(acc: Column, x: Column) -> Column:
        total = acc["total"] + x["bytes"]
        return F.when(total <= size, F.struct(total.alias("total"), F.concat(acc["kept"], F.array(x["h"])).alias("kept"))).otherwise(acc)

    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("kept"))
    kept = F.aggregate("ranked", none, fit, lambda acc: F.when(F.size(acc["kept"]) > 0, acc["kept"]).otherwise(F.array(F.col("ranked")[0]["h"])))
    chosen = ranked.select(F.explode(kept).alias("h")).distinct()
    bounded = F.when(F.octet_length("text") > size, F.substring("text", 1, size // 4)).otherwise(F.col("text")).alias("text")
    texts = usable.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen), "h").select("h", "lang", bounded).dropDuplicates(["h", "lang"])
    out: dict[str, list[bytes]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(row["lang"], []).append(row["text"].encode())
    return out


def grams(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the k-grams of bytes within texts. Digits are byte + 1 in base 257, so codes of different lengths differ."""
    parts = []
    for t in texts:
        x = np.frombuffer(t, np.uint8).astype(np.int64) + 1
        if len(x) >= k:
            code = np.zeros(len(x) - k + 1, np.int64)
            for i in range(k):
                code = code * 257 + x[i : len(x) - k + 1 + i]
            parts.append(code)
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def place_of(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where the codes are in sorted_codes, -1 where they aren't."""
    if not len(sorted_codes):
        return np.full(codes.shape, -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, at, -1)


class Automaton:
    """Contexts of some languages as states; escape (state x language, bits), shorter (state to the state of its suffix) and, by transition, go and cost (x language)."""

    def __init__(self, samples: list[list[bytes]], order: int):
        counts = [[grams(texts, k + 1) for texts in samples] for k in range(order + 1)]
        pairs = [np.unique(np.concatenate([code for code, _ in level])) for level in counts]  # (context, byte) by length of the context
        levels = [np.unique(p // 257) if k else np.zeros(1, np.int64) for k, p in enumerate(pairs)]
        starts = np.cumsum([0, *map(len, levels)])
        n, m, langs = int(starts[-1]), sum(map(len, pairs)), len(samples)
        self.escape = np.zeros((n, langs), np.float32)
        self.shorter = np.zeros(n, np.int32)
        self.go = np.zeros(m, np.int32)
        self.cost = np.zeros((m, langs), np.float32)
        keys = np.zeros(m, np.int64)
        self.starts, self.places = starts, np.cumsum([0, *map(len, pairs)])  # states and transitions by length of the context
        at = 0
        below = np.zeros((0, langs))
        for k, (level, pair) in enumerate(zip(levels, pairs, strict=True)):
            context = np.searchsorted(level, pair // 257)
            if k:
                self.shorter[starts[k] : starts[k + 1]] = starts[k - 1] + np.searchsorted(levels[k - 1], level % 257 ** (k - 1))
                cost = below[np.searchsorted(pairs[k - 1], pair % 257**k)]
            else:
                cost = np.full((len(pair), langs), 8.0)
            for j in range(langs):
                code, number = counts[k][j]
                mine = np.searchsorted(level, code // 257)
                total, kinds = np.bincount(mine, number, len(level)), np.bincount(mine, minlength=len(level))
                some = total > 0
                escape = np.zeros(len(level))
                escape[some] = np.log2((total[some] + kinds[some]) / kinds[some])
                self.escape[starts[k] : starts[k + 1], j] = escape
                cost[:, j] += escape[context]
                cost[np.searchsorted(pair, code), j] = np.log2((total + kinds)[mine] / number)
            here = slice(at, at + len(pair))
            self.cost[here], below = cost, cost
            keys[here] = (starts[k] + context) * 256 + pair % 257 - 1
            go = np.zeros(len(pair), np.int64)
            todo = np.ones(len(pair), bool)
            for length in range(min(k + 1, order), 0, -1):
                found = place_of(levels[length], pair % 257**length)
                hit = todo & (found >= 0)
                go[hit] = starts[length] + found[hit]
                todo &= ~hit
            self.go[here] = go
            at += len(pair)
        self.shift = np.uint64(64 - max(4, (2 * m).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot = np.zeros(len(self.keys), np.int32)
        where, todo = self.hashed(keys), np.arange(m)
        while len(todo):  # linear probing, all keys at once
            free = self.keys[where[todo]] < 0
            _, first = np.unique(where[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[where[put]], self.slot[where[put]] = keys[put], put
            todo = todo[self.keys[where[todo]] != keys[todo]]
            where[todo] = (where[todo] + 1) & (len(self.keys) - 1)

    def unfold(self) -> "Table":
        return Table(self)

    def cells(self) -> int:
        return len(self.escape) * (1 + len(np.unique(self.keys[self.keys >= 0] & 255)))

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
        """The states after the bytes; their costs are added to bits."""
        out = np.zeros(len(state), np.int64)
        key = state * 256 + byte
        at = self.hashed(key)
        found = self.keys[at]
        hit = found == key
        if hit.all():
            slot = self.slot[at]
            if bits is not None:
                bits += self.cost[slot]
            return self.go[slot].astype(np.int64)
        slot = self.slot[at[hit]]
        out[hit] = self.go[slot]
        if bits is not None:
            bits[hit] += self.cost[slot]
        todo = np.flatnonzero(~hit)
        key, at, found, here = key[todo], at[todo], found[todo], state[todo]
        while len(todo):
            missing = found < 0  # not a transition: escape to the shorter context, of which the empty one ends at the uniform distribution
            if bits is not None:
                bits[todo[missing]] += self.escape[here[missing]] + np.where(here[missing] == 0, np.float32(8), np.float32(0))[:, None]
            done = missing & (here == 0)
            shorter = self.shorter[here].astype(np.int64)
            here = np.where(missing, shorter, here)
            key = np.where(missing, here * 256 + (key & 255), key)
            at = np.where(missing, self.hashed(key), (at + 1) & (len(self.keys) - 1))
            found = self.keys[at]
            hit = ~done & (found == key)
            slot = self.slot[at[hit]]
            out[todo[hit]] = self.go[slot]
            if bits is not None:
                bits[todo[hit]] += self.cost[slot]
            left = ~(done | hit)
            todo, key, at, found, here = todo[left], key[left], at[left], found[left], here[left]
        return out


class Table:
    """An automaton with every state's transition for every byte: its own or that of the longest shorter context that has one."""

    def __init__(self, automaton: Automaton):
        used = automaton.keys[automaton.keys >= 0]
        slots = automaton.slot[automaton.keys >= 0]
        seen = np.unique(used & 255)
        m, langs, depth = len(slots), automaton.cost.shape[1], len(automaton.starts)
        self.kind = np.zeros(256, np.int64)
        self.kind[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        states = len(automaton.escape)
        slot = np.full((states, self.width), m, np.int32)  # m: known to no context
        # what is paid on the way to a transition of a shorter context: by state, the context's length + 1
        self.depth = depth
        paid = np.zeros((states, depth, langs), np.float32)
        state, kind = used >> 8, self.kind[used & 255]
        for k in range(depth - 1):
            rows = np.arange(automaton.starts[k], automaton.starts[k + 1])
            if k:
                slot[rows] = slot[automaton.shorter[rows]]
                paid[rows, : k + 1] = paid[automaton.shorter[rows], : k + 1]
            paid[rows, : k + 1] += automaton.escape[rows][:, None]
            mine = (state >= automaton.starts[k]) & (state < automaton.starts[k + 1])
            slot[state[mine], kind[mine]] = slots[mine]
        self.slot, self.paid = slot.reshape(-1), paid.reshape(-1, langs)
        self.go = np.append(automaton.go, 0).astype(np.int64)
        self.cost = np.concatenate([automaton.cost, np.full((1, langs), 8, np.float32)])
        self.level = np.append(np.repeat(np.arange(1, depth), np.diff(automaton.places)), 0)

    def step(self, state: np.ndarray, byte: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
        slot = self.slot.take(state * self.width + self.kind.take(byte))
        if bits is not None:
            bits += self.cost.take(slot, 0)
            bits += self.paid.take(state * self.depth + self.level.take(slot), 0)
        return self.go.take(slot)


class Ppm:
    """langs, in order, and the automata that score them, TOGETHER at a time."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, together: int = TOGETHER):
        self.langs = sorted(samples)
        self.order = order
        self.unfolded: tuple | None = None
        self.automata = [Automaton([samples[x] for x in self.langs[i : i + together]], order) for i in range(0, len(self.langs), together)]

    def steppers(self, cells: int = TABLE_CELLS) -> list:
        """The automata, the first of them unfolded to tables as long as there is room; both give the same code lengths. Kept by the worker."""
        if self.unfolded is None or self.unfolded[0] != cells:
            room, out = cells, []
            for a in self.automata:
                need = a.cells()
                out.append(a.unfold() if need <= room else a)
                room -= need if need <= room else 0
            self.unfolded = (cells, out)
        return self.unfolded[1]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "unfolded": None}

    def bits(self, data: np.ndarray, offs: np.ndarray, lane: int = LANE, cells: int = TABLE_CELLS) -> np.ndarray:
        """Code length of each text under each language. data: all bytes; offs: n + 1 offsets."""
        n = len(offs) - 1
        sizes = np.diff(offs)
        lanes = -(-sizes // lane)
        doc = np.repeat(np.arange(n), lanes)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = offs[doc] + number * lane
        length = np.minimum(lane, offs[doc + 1] - begin) if len(doc) else begin
        by = np.argsort(-length, kind="stable")
        doc, begin, length, number = doc[by], begin[by], length[by], number[by]
        later = np.flatnonzero(number > 0)  # lanes are longer than the order, so the warm-up stays in the text
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left").tolist()
        out = np.zeros((n, len(self.langs)))
        first = 0
        for automaton in self.steppers(cells):
            langs = automaton.cost.shape[1]
            state = np.zeros(len(doc), np.int64)
            warm = state[later]
            for back in range(self.order, 0, -1):
                warm = automaton.step(warm, data[begin[later] - back], None)
            state[later] = warm
            total = np.zeros((len(doc), langs))
            for t, m in enumerate(active):
                state[:m] = automaton.step(state[:m], data[begin[:m] + t], total[:m])
            np.add.at(out[:, first : first + langs], doc, total)
            first += langs
        return out


def predict(docs: DataFrame, model: Ppm, text: str = "text") -> DataFrame:
    """docs, all columns and rows, plus lang_pred and score (posterior of the best language at equal priors, 0 to 1).

    A null text, or one without a letter of any script, is "und" with score 0, as is every text if no language was learned. Ties go to the
    language that sorts first. Result names that docs has already get underscores.
    """
    from .shared import clash_free

    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample: at most ORDER + 1 transitions for each byte of it
    lang_pred, score = clash_free(docs, "lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for whole in batches:
            for batch in slices([whole], whole.schema.names[place], 4 << 20):
                texts = batch.column(place)
                data, offs = bytes_of(texts)
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
                if ppm.langs:
                    bits = ppm.bits(data, offs)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    sure = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                    names = np.array([*ppm.langs, NO_LANGUAGE], object)[np.where(lettered, best, len(ppm.langs))]
                    sure = np.where(lettered, sure, 0.0)
                else:
                    names, sure = np.full(len(texts), NO_LANGUAGE, object), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure)], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> Ppm:
    return Ppm(training_sample(docs.where(~held_out()).select("doc_id", "text", "lang")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
