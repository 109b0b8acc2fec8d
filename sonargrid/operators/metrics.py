"""Alignment, detection and classification metrics. Ratios are always formed from sums, so totals are right for any grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from .intervals import Keys
from .joins import assign, hungarian, range_join


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """numerator / denominator; empty where the denominator is 0 or less."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def with_total(df: DataFrame, keys: Keys, *sums: Column, total: str = "TOTAL") -> DataFrame:
    """Sums per key and over all, the total row named."""
    rolled = df.rollup(*keys).agg(*sums, F.grouping_id().alias("_g"))
    full = 2 ** len(keys) - 1
    return rolled.where(f"_g IN (0, {full})").withColumns({k: F.when(F.col("_g") == full, F.lit(total)).otherwise(F.col(k).cast("string")) for k in keys}).drop("_g")


def precision_recall(tp: Column, found: Column, wanted: Column) -> list[Column]:
    p, r = ratio(tp, found), ratio(tp, wanted)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def interval_prf(hypothesis: DataFrame, reference: DataFrame, keys: Keys, width) -> DataFrame:
    """Duration precision, recall and F1 of merged intervals, per key and TOTAL."""
    h, r = iv.merge(hypothesis, keys), iv.merge(reference, keys)
    parts = [
        range_join(h, r, keys, width).select(*keys, (F.col("o_end") - F.col("o_start")).alias("both"), F.lit(0).alias("h"), F.lit(0).alias("r")),
        h.select(*keys, F.lit(0).alias("both"), (F.col("end") - F.col("start")).alias("h"), F.lit(0).alias("r")),
        r.select(*keys, F.lit(0).alias("both"), F.lit(0).alias("h"), (F.col("end") - F.col("start")).alias("r")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = with_total(rows, keys, *(F.sum(c).alias(c) for c in ("both", "h", "r")))
    return sums.select(*keys, F.col("both").alias("intersection"), F.col("h").alias("hypothesis"), F.col("r").alias("reference"), *precision_recall(F.col("both"), F.col("h"), F.col("r")))


def detection_error(hypothesis: DataFrame, reference: DataFrame, region: DataFrame, keys: Keys) -> DataFrame:
    """False alarm, miss and scored time of one-class segments, per key and TOTAL; rate = (fa + miss) / scored."""
    one = lambda d: iv.merge(d, keys).withColumn("speaker", F.lit("s"))
    pieces = iv.atomic_timeline(region, one(reference), one(hypothesis), keys).withColumn("d", F.col("end") - F.col("start"))
    sums = with_total(
        pieces, keys, F.sum(F.when(F.col("n_ref") > 0, F.col("d")).otherwise(0)).alias("scored"), F.sum(F.when(F.col("n_ref") > F.col("n_hyp"), F.col("d")).otherwise(0)).alias("miss"), F.sum(F.when(F.col("n_ref") < F.col("n_hyp"), F.col("d")).otherwise(0)).alias("false_alarm")
    )
    return sums.withColumn("error_rate", ratio(F.col("false_alarm") + F.col("miss"), F.col("scored"), None))


#: Speakers that one running mask of bits holds.
MASK = 62


def speaker_masks(reference: DataFrame, hypothesis: DataFrame, keys: Keys, collar=0, skip_overlap: bool = False, region: DataFrame | None = None) -> DataFrame:
    """Merged rows (keys, side, speaker, start, end, number) of one sweep: side 0 reference, 1 hypothesis, 2 region, 3 collars, 4 raw reference.

    All sides are dealt by key once. number counts a key's speakers of a side from 0. Keys without reference are left out.
    """
    side = lambda d, n, speaker: d.where("end > start").select(*keys, F.lit(n).alias("side"), speaker.cast("string").alias("speaker"), "start", "end")
    rows = side(reference, 0, F.col("speaker")).unionByName(side(hypothesis, 1, F.col("speaker")))
    if region is not None:
        rows = rows.unionByName(side(region, 2, F.lit("")))
    if collar > 0:
        rows = rows.unionByName(side(iv.collars(reference, keys, collar), 3, F.lit("")))
    if skip_overlap:  # each interval by itself: a speaker's own overlapping ones count
        rows = rows.unionByName(side(reference, 4, F.monotonically_increasing_id()))
    rows = rows.repartition(*keys).withColumn("first", F.min("side").over(Window.partitionBy(*keys))).where("first = 0").drop("first")
    by_speaker = [*keys, "side", "speaker"]
    merged = iv.merge(rows, by_speaker)
    return merged.withColumn("number", F.dense_rank().over(Window.partitionBy(*keys, "side").orderBy("speaker")) - 1)


def speaker_pieces(reference: DataFrame, hypothesis: DataFrame, keys: Keys, collar=0, skip_overlap: bool = False, region: DataFrame | None = None, masks: int = 2) -> DataFrame:
    """(keys, d, refs, hyps, scored) of the pieces inside the region in which anyone speaks: length, numbers of the active speakers, whether they are scored.

    Active speakers are bits of running sums, MASK in each of masks columns a side; a key with more speakers is an error, to be run with more masks.
    """
    rows = speaker_masks(reference, hypothesis, keys, collar, skip_overlap, region)
    number = F.when((F.col("side") > 1) | (F.col("number") < masks * MASK), F.col("number")).otherwise(F.raise_error(F.lit(f"more than {masks * MASK} speakers: raise masks")))
    bit = F.expr(f"shiftleft(1L, cast(number % {MASK} as int))")
    columns = {f"{name}{m}": F.when((F.col("side") == n) & (F.floor(F.col("number") / MASK) == m), bit).otherwise(F.lit(0).cast("long")) for n, name in ((0, "r"), (1, "h")) for m in range(masks)}
    columns |= {name: F.when(F.col("side") == n, 1).otherwise(0) for n, name in ((2, "u"), (3, "c"), (4, "o"))}
    edge = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("s")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("s")))
    edges = rows.withColumn("number", number).select(*keys, *(c.alias(n) for n, c in columns.items()), F.explode(edge).alias("e"))
    points = edges.groupBy(*keys, F.col("e.t").alias("start")).agg(*(F.sum(F.col(c) * F.col("e.s")).alias(c) for c in columns))
    w = Window.partitionBy(*keys).orderBy("start")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = points.select(*keys, (F.lead("start").over(w) - F.col("start")).alias("d"), *(F.sum(c).over(run).alias(c) for c in columns))
    spoken = F.expr(" + ".join(f"bit_count({n}{m})" for n in "rh" for m in range(masks)))
    pieces = pieces.where(F.col("d").isNotNull() & (spoken > 0))
    if region is not None:
        pieces = pieces.where("u > 0")
    active = lambda n: F.expr("concat(" + ", ".join(f"transform(filter(sequence(0, {MASK - 1}), i -> getbit({n}{m}, i) = 1), i -> i + {m * MASK})" for m in range(masks)) + ")")
    return pieces.select(*keys, "d", active("r").alias("refs"), active("h").alias("hyps"), ((F.col("c") == 0) & (F.col("o") < 2)).alias("scored"))


def pair_times(pieces: DataFrame, keys: Keys) -> DataFrame:
    """(keys, ref, hyp, overlap, scored): common time of the speakers' numbers, all of it and what is scored of it."""
    pairs = pieces.where("size(refs) > 0 AND size(hyps) > 0").select(*keys, "d", "scored", "hyps", F.explode("refs").alias("ref")).select(*keys, "d", "scored", "ref", F.explode("hyps").alias("hyp"))
    return pairs.groupBy(*keys, "ref", "hyp").agg(F.sum("d").cast("double").alias("overlap"), F.sum(F.when(F.col("scored"), F.col("d")).otherwise(0)).alias("correct"))


def speaker_mapping(reference: DataFrame, hypothesis: DataFrame, keys: Keys, region: DataFrame | None = None) -> DataFrame:
    """One-to-one speakers of highest common time inside the region (before collars): (keys, ref, hyp, overlap)."""
    best = assign(pair_times(speaker_pieces(reference, hypothesis, keys, region=region), keys).drop("correct"), keys, "ref", "hyp", "overlap")
    names = speaker_masks(reference, hypothesis, keys).select(*keys, "side", "speaker", "number").distinct()
    name = lambda n, c: names.where(F.col("side") == n).select(*keys, F.col("number").alias(c), F.col("speaker").alias(f"{c}_name"))
    joined = best.join(name(0, "ref"), [*keys, "ref"]).join(name(1, "hyp"), [*keys, "hyp"])
    return joined.select(*keys, F.col("ref_name").alias("ref"), F.col("hyp_name").alias("hyp"), "overlap")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, keys: Keys, collar=0, skip_overlap: bool = False, region: DataFrame | None = None) -> DataFrame:
    """Scored, missed, false alarm and confused speaker time, per key and TOTAL, and their rate.

    The mapping uses the region without collars, scoring the region with them (half-width collar) and, if asked, without reference overlap.
    Without a region it is the extent of reference and hypothesis. Keys without reference speakers are left out. No scored time: a null rate.
    One sweep over a key's boundaries gives the pieces, the speakers active in each and the common time of all pairs.
    """
    pieces = speaker_pieces(reference, hypothesis, keys, collar, skip_overlap, region)
    n_ref, n_hyp, none = F.size("refs"), F.size("hyps"), F.lit(0)
    time = lambda n: F.when(F.col("scored"), F.col("d") * n).otherwise(none)
    sums = pieces.select(
        *keys, time(n_ref).alias("scored"), time(F.greatest(n_ref - n_hyp, none)).alias("miss"), time(F.greatest(n_hyp - n_ref, none)).alias("false_alarm"), time(F.least(n_ref, n_hyp)).alias("matchable"), none.alias("correct")
    )
    right = assign(pair_times(pieces, keys), keys, "ref", "hyp", "overlap", "correct").select(*keys, *(none.alias(c) for c in ("scored", "miss", "false_alarm", "matchable")), "correct")
    out = with_total(sums.unionByName(right), keys, *(F.sum(c).alias(c) for c in ("scored", "miss", "false_alarm", "matchable", "correct")))
    out = out.withColumn("confusion", F.col("matchable") - F.col("correct")).drop("matchable", "correct")
    return out.withColumn("der", ratio(F.col("miss") + F.col("false_alarm") + F.col("confusion"), F.col("scored"), None))


#: Collar and overlap handling by evaluation mode.
DER_MODES = {"full": (0.0, False), "fair": (0.25, False), "forgiving": (0.25, True)}


def speaker_counts(reference: DataFrame, hypothesis: DataFrame, keys: Keys) -> DataFrame:
    """Speakers of reference and hypothesis per key, and whether they agree."""
    r = reference.groupBy(*keys).agg(F.countDistinct("speaker").alias("n_ref"))
    h = hypothesis.groupBy(*keys).agg(F.countDistinct("speaker").alias("n_hyp"))
    return r.join(h, keys, "left").na.fill(0, ["n_hyp"]).withColumn("right", F.col("n_ref") == F.col("n_hyp"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of strings, in the JVM: each distinct word becomes a character, and the texts of these are compared."""
    known = F.array_distinct(F.concat(a, b))
    code = lambda w, dictionary: F.coalesce(F.array_position(dictionary, w), F.lit(0)) + 256
    text = lambda c, dictionary: F.decode(F.unhex(F.array_join(F.transform(c, lambda w: F.lpad(F.hex(F.when(code(w, dictionary) < 0xD800, code(w, dictionary)).otherwise(code(w, dictionary) + 0x800)), 8, "0")), "")), "UTF-32")
    both = F.transform(F.array(known), lambda d: F.levenshtein(text(a, d), text(b, d)))  # the dictionary is built once
    return F.element_at(both, 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def error_counts(df: DataFrame, reference: str, hypothesis: str, by_character: bool = False) -> DataFrame:
    """df plus n_ref and n_err, and the row's own rate: without reference, 0 for an empty hypothesis and infinity otherwise."""
    cut = characters if by_character else words
    r, h = cut(F.col(reference)), cut(F.col(hypothesis))
    err = F.levenshtein(F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))) if by_character else edit_distance(r, h)
    n = F.length(F.coalesce(F.col(reference), F.lit(""))) if by_character else F.size(r)
    out = df.withColumns({"n_ref": n, "n_err": err})
    return out.withColumn("rate", F.when(F.col("n_ref") > 0, F.col("n_err") / F.col("n_ref")).when(F.col("n_err") > 0, float("inf")).otherwise(0.0))


def pooled_rate(counts: DataFrame, *keys: str) -> DataFrame:
    """Summed errors over summed reference length; infinity without reference."""
    out = counts.groupBy(*keys).agg(F.sum("n_err").alias("n_err"), F.sum("n_ref").alias("n_ref"))
    return out.withColumn("rate", F.when(F.col("n_ref") > 0, F.col("n_err") / F.col("n_ref")).otherwise(float("inf")))


def align(r: list, h: list) -> list[tuple[str, int, int]]:
    """One cheapest alignment as (op, reference index, hypothesis index), op of "=", "s", "d", "i"."""
    table = np.zeros((len(r) + 1, len(h) + 1), np.int32)
    table[:, 0], table[0, :] = np.arange(len(r) + 1), np.arange(len(h) + 1)
    ids = {w: i for i, w in enumerate(dict.fromkeys([*r, *h]))}
    b = np.array([ids[w] for w in h], np.int64)
    steps = np.arange(len(h) + 1)
    for i, w in enumerate(r, 1):  # a row at a time: insertions are a running minimum
        row = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (b != ids[w]))
        row = np.concatenate([[i], row]) - steps
        table[i] = np.minimum.accumulate(row) + steps
    out, i, j = [], len(r), len(h)
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (r[i - 1] != h[j - 1]):
            i, j = i - 1, j - 1
            out.append(("=" if r[i] == h[j] else "s", i, j))
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            out.append(("d", i, j))
        else:
            j -= 1
            out.append(("i", i, j))
    return out[::-1]


def alignment_counts(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """df plus hits, substitutions, deletions, insertions (arrays cut by white space; vectorised rows of the table, for long texts too) and marks, the
    rightness of each hypothesis word."""
    @F.pandas_udf("hits int, substitutions int, deletions int, insertions int, marks array<boolean>")
    def count(rs: pd.Series, hs: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(rs, hs, strict=True):
            ops = align((r or "").split(), (h or "").split())
            n = {k: sum(o == k for o, _, _ in ops) for k in "=sdi"}
            rows.append((n["="], n["s"], n["d"], n["i"], [o == "=" for o, _, _ in ops if o != "d"]))
        return pd.DataFrame(rows, columns=["hits", "substitutions", "deletions", "insertions", "marks"])

    return df.withColumn("_a", count(reference, hypothesis)).select("*", "_a.*").drop("_a")


def cpwer(reference: DataFrame, hypothesis: DataFrame, session: str) -> DataFrame:
    """Concatenated minimum-permutation word error rate per session: rows (session, speaker, text), one per speaker. (session, errors, n_ref, cpwer)."""
    kind = reference.schema[session].dataType.simpleString()

    def one(key, r: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        rs, hs = [t.split() for t in r.sort_values("speaker")["text"].fillna("")], [t.split() for t in h.sort_values("speaker")["text"].fillna("")]
        n = max(len(rs), len(hs))
        rs, hs = rs + [[]] * (n - len(rs)), hs + [[]] * (n - len(hs))
        cost = np.array([[sum(o != "=" for o, _, _ in align(a, b)) for b in hs] for a in rs], float).reshape(n, n)
        errors = int(cost[np.arange(n), hungarian(cost)].sum()) if n else 0
        total = sum(map(len, rs))
        return pd.DataFrame({session: [key[0]], "errors": [errors], "n_ref": [total], "cpwer": [errors / total if total else (float("inf") if errors else 0.0)]})

    return reference.groupBy(session).cogroup(hypothesis.groupBy(session)).applyInPandas(one, f"`{session}` {kind}, errors long, n_ref long, cpwer double")


def ngram_matches(df: DataFrame, pair: str, reference: str, hypothesis: str, n_max: int = 4) -> DataFrame:
    """Clipped n-gram matches and counts per pair and n: (pair, n, matches, total), the accumulators of BLEU."""
    def grams(text: str, name: str) -> DataFrame:
        w = words(F.col(text))
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n_max)), lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(n.alias("n"), F.array_join(F.slice(w, i, n), " ").alias("g")))))
        return df.select(pair, F.explode(every).alias("x")).groupBy(pair, "x.n", "x.g").agg(F.count(F.lit(1)).alias(name))

    both = grams(hypothesis, "c").join(grams(reference, "r"), [pair, "n", "g"], "left")
    return both.groupBy(pair, "n").agg(F.sum(F.least("c", F.coalesce("r", F.lit(0)))).alias("matches"), F.sum("c").alias("total"))


def bleu(df: DataFrame, pair: str, reference: str, hypothesis: str, n_max: int = 4, group: str | None = None, smooth: bool = False) -> DataFrame:
    """Corpus BLEU (0 to 1) from summed matches, with brevity penalty; per group if given."""
    by = [group] if group else []
    lengths = df.groupBy(*by).agg(F.sum(F.size(words(F.col(hypothesis)))).alias("len_hyp"), F.sum(F.size(words(F.col(reference)))).alias("len_ref"))
    counts = ngram_matches(df, pair, reference, hypothesis, n_max)
    if group:
        counts = counts.join(df.select(pair, group), pair)
    add = F.when(F.col("n") > 1, 1 if smooth else 0).otherwise(0)
    per_n = counts.groupBy(*by, "n").agg(F.sum("matches").alias("m"), F.sum("total").alias("t")).withColumns({"m": F.col("m") + add, "t": F.col("t") + add})
    p = per_n.groupBy(*by).agg(F.sum(F.when(F.col("m") > 0, F.log(F.col("m") / F.col("t")))).alias("logs"), F.count(F.when(F.col("m") > 0, 1)).alias("k"))
    out = lengths.join(p, by, "left") if by else lengths.crossJoin(p)
    penalty = F.when(F.col("len_hyp") >= F.col("len_ref"), 1.0).otherwise(F.exp(1 - F.col("len_ref") / F.col("len_hyp")))
    return out.withColumn("bleu", F.when(F.col("k") == n_max, penalty * F.exp(F.col("logs") / n_max)).otherwise(0.0)).drop("logs", "k")


def token_f1(df: DataFrame, pair: str, reference: str, hypothesis: str) -> DataFrame:
    """Multiset token F1 per pair after lower-casing and without punctuation and articles: (pair, common, n_ref, n_hyp, f1)."""
    def tokens(c: str) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[\p{Punct}]", ""), r"\b(a|an|the)\b", " ")
        return words(plain)

    count = lambda c, name: df.select(pair, F.explode(tokens(c)).alias("w")).groupBy(pair, "w").agg(F.count(F.lit(1)).alias(name))
    common = count(reference, "r").join(count(hypothesis, "h"), [pair, "w"]).groupBy(pair).agg(F.sum(F.least("r", "h")).alias("common"))
    out = df.select(pair, F.size(tokens(reference)).alias("n_ref"), F.size(tokens(hypothesis)).alias("n_hyp")).join(common, pair, "left").na.fill(0, ["common"])
    return out.withColumn("f1", ratio(2.0 * F.col("common"), F.col("n_ref") + F.col("n_hyp")))


def auc_roc(df: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve of (label 0/1, score), from counts per distinct score; 0.5 with one class only."""
    per = df.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    out = rows.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return out.select(*keys, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).otherwise(0.5).alias("auc"))


def average_precision(df: DataFrame, *keys: str) -> DataFrame:
    """Sum over falling scores of precision times the rise in recall."""
    per = df.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.withColumns({"tp": F.sum("p").over(down), "k": F.sum("c").over(down)})
    out = rows.groupBy(*keys).agg(F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("s"), F.sum("p").alias("np"))
    return out.select(*keys, ratio(F.col("s"), F.col("np")).alias("average_precision"))


def negative_precision_area(df: DataFrame, *keys: str) -> DataFrame:
    """Average precision of the negatives, lowest scores first."""
    return average_precision(df.withColumns({"label": 1 - F.col("label"), "score": -F.col("score")}), *keys).withColumnRenamed("average_precision", "auc_nt")


def normalised_cross_entropy(df: DataFrame, *keys: str, eps: float = 1e-12) -> DataFrame:
    """1 - cross entropy / entropy of the base rate."""
    s = F.greatest(F.least(F.col("score"), F.lit(1 - eps)), F.lit(eps))
    out = df.groupBy(*keys).agg(F.avg("label").alias("p"), F.avg(-(F.col("label") * F.log(s) + (1 - F.col("label")) * F.log(1 - s))).alias("ce"))
    h = -(F.col("p") * F.log("p") + (1 - F.col("p")) * F.log(1 - F.col("p")))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("p") < 1), 1 - F.col("ce") / h).alias("nce"))


def calibration_error(df: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over right-closed bins; right means the label agrees with the decision at the bin's centre. Score 0 is in no bin."""
    b = F.ceil(F.col("score") * bins)
    rows = df.withColumn("bin", b).where((F.col("bin") >= 1) & (F.col("bin") <= bins))
    centre = (F.col("bin") - 0.5) / bins
    rows = rows.withColumn("right", ((F.col("score") >= centre).cast("int") == F.col("label")).cast("double"))
    per = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("acc"), F.avg("score").alias("conf"))
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    joined = per.join(total, list(keys)) if keys else per.crossJoin(F.broadcast(total))
    return joined.groupBy(*keys).agg(F.sum(F.abs(F.col("acc") - F.col("conf")) * F.col("n") / F.col("total")).alias("ece"))


def youden_curve(df: DataFrame, bins: int = 20) -> DataFrame:
    """(threshold, youden): true positive rate + true negative rate - 1 at each of bins + 1 thresholds, from counts per step."""
    step = F.least(F.floor(F.col("score") * bins), F.lit(bins))
    per = df.groupBy(step.alias("step")).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    grid = df.sparkSession.range(bins + 1).select(F.col("id").alias("step")).join(per, "step", "left").na.fill(0)
    above, everything = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    tpr = F.sum("p").over(above) / F.sum("p").over(everything)
    fpr = F.sum("n").over(above) / F.sum("n").over(everything)
    return grid.select((F.col("step") / bins).alias("threshold"), (tpr - fpr).alias("youden"))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Per class tp, fp, fn, precision, recall, f1; rows "macro" and "micro" over the classes."""
    sides = df.select(F.col(label).cast("string").alias("class"), (F.col(label) == F.col(predicted)).cast("long").alias("tp"), F.lit(0).alias("fp"), (F.col(label) != F.col(predicted)).cast("long").alias("fn"))
    sides = sides.unionByName(df.where(F.col(label) != F.col(predicted)).select(F.col(predicted).cast("string").alias("class"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")))
    per = sides.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    scored = lambda d: d.select("class", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))
    classes = scored(per)
    micro = scored(per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn("class", F.lit("micro")))
    macro = classes.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).withColumn("class", F.lit("macro"))
    return classes.unionByName(micro).unionByName(macro)


def utterance_ends(predictions: DataFrame, references: DataFrame, session: str, collar: float, threshold: float = 0.0) -> DataFrame:
    """Greedy ordered match of predicted to reference end times (t) with a collar: per session tp, fp, fn, mean latency, early cut-offs. Sequential by nature."""
    kind = references.schema[session].dataType.simpleString()

    def one(key, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if threshold > 0 and len(p):
            p = p[p["prob"] >= threshold]
        ps, rs = sorted(p["t"]) if len(p) else [], sorted(r["t"]) if len(r) else []
        i = tp = fn = early = 0
        waits = []
        for n, t in enumerate(rs):
            until = rs[n + 1] if n + 1 < len(rs) else float("inf")
            before = 0
            while i < len(ps) and ps[i] < t - collar:
                i, before = i + 1, before + 1
            early += before
            if i < len(ps) and ps[i] <= min(t + collar, until):
                tp += 1
                waits.append(ps[i] - t)
                i += 1
            else:
                fn += 1
        return pd.DataFrame({session: [key[0]], "tp": [tp], "fp": [len(ps) - tp], "fn": [fn], "early": [early], "latency": [float(np.mean(waits)) if waits else None]})

    return predictions.groupBy(session).cogroup(references.groupBy(session)).applyInPandas(one, f"`{session}` {kind}, tp long, fp long, fn long, early long, latency double")


def average_lagging(df: DataFrame, key: str) -> DataFrame:
    """Length-adaptive average lagging per row: delays (array), source_length, target_length; up to and with the first delay at or past the source's end."""
    n = F.size("delays")
    gamma = F.greatest(n, F.col("target_length")) / F.col("source_length")
    first = F.array_position(F.transform("delays", lambda d: d >= F.col("source_length")), True)
    used = F.when(first > 0, first).otherwise(n).cast("int")
    total = F.aggregate(F.zip_with(F.slice("delays", 1, used), F.sequence(F.lit(0), used - 1), lambda d, i: d - i / gamma), F.lit(0.0), lambda a, x: a + x)
    return df.select(key, F.when(n == 0, F.lit(0.0)).otherwise(total / used).alias("laal"))


def turn_taking(tokens: DataFrame, keys: Keys, end_id: int, start_id: int, tolerance: int) -> DataFrame:
    """First user end against first agent start of a sequence (pos, source, predicted): ok within tolerance, with signed latency; no end: left out."""
    firsts = tokens.groupBy(*keys).agg(F.min(F.when(F.col("source") == end_id, F.col("pos"))).alias("user_end"), F.min(F.when(F.col("predicted") == start_id, F.col("pos"))).alias("agent_start"))
    firsts = firsts.where("user_end IS NOT NULL").withColumn("latency", F.col("agent_start") - F.col("user_end"))
    return firsts.withColumn("ok", F.coalesce(F.abs("latency") <= tolerance, F.lit(False)))


def token_hits(target: DataFrame, predicted: DataFrame, keys: Keys, token: int, tolerance: int) -> DataFrame:
    """Share of the target's tokens found in the prediction within tolerance positions.

    Positions fall into bins of tolerance + 1: any prediction in a token's own bin is a hit, of the bins beside it only the nearest can be.
    """
    start = F.col("pos") - F.pmod(F.col("pos"), F.lit(tolerance + 1))
    t = target.where(F.col("token") == token).select(*keys, "pos", start.alias("bin"))
    ends = predicted.where(F.col("token") == token).select(*keys, "pos", start.alias("bin")).groupBy(*keys, "bin").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    near = ends.select(*keys, F.explode(F.array(*(F.struct((F.col("bin") + i * (tolerance + 1)).alias("bin"), F.when(F.lit(i == 0), True).alias("own"), F.when(F.lit(i == 1), F.col("last")).alias("before"), F.when(F.lit(i == -1), F.col("first")).alias("after")) for i in (-1, 0, 1)))).alias("n"))
    near = near.select(*keys, "n.*").groupBy(*keys, "bin").agg(*(F.max(c).alias(c) for c in ("own", "before", "after")))  # one row a bin and column
    hit = F.coalesce("own", F.lit(False)) | F.coalesce(F.col("pos") - F.col("before") <= tolerance, F.lit(False)) | F.coalesce(F.col("after") - F.col("pos") <= tolerance, F.lit(False))
    return t.join(near.hint("merge"), [*keys, "bin"], "left").groupBy(*keys).agg(F.avg(hit.cast("int")).alias("accuracy"))


def punctuation_errors(df: DataFrame, reference: str, hypothesis: str, marks: str = ".,!?") -> DataFrame:
    """Per mark and in total: hits, substitutions, deletions, insertions and their rate, from alignments of words and marks."""
    @F.pandas_udf("array<struct<mark: string, op: string>>")
    def found(rs: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(rs, hs, strict=True):
            a, b = (("".join(f" {c} " if c in marks else c for c in (t or "").lower())).split() for t in (r, h))
            row = []
            for op, i, j in align(a, b):
                left, right = a[i] if op in "=sd" else None, b[j] if op in "=si" else None
                if left in set(marks):
                    row.append({"mark": left, "op": "hit" if op == "=" else "sub" if op == "s" and right in set(marks) else "del"})
                elif right in set(marks):
                    row.append({"mark": right, "op": "ins"})
            out.append(row)
        return pd.Series(out)

    rows = df.select(F.explode(found(reference, hypothesis)).alias("e")).select("e.mark", "e.op")
    sums = with_total(rows, ["mark"], *(F.sum((F.col("op") == o).cast("long")).alias(n) for o, n in (("hit", "hits"), ("sub", "substitutions"), ("del", "deletions"), ("ins", "insertions"))))
    wrong = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return sums.withColumn("rate", ratio(wrong, wrong + F.col("hits")))


def keyword_scores(df: DataFrame, reference: str, hypothesis: str, keywords: list[str]) -> DataFrame:
    """Per keyword and TOTAL: found, wanted, precision, recall and F1 of aligned words."""
    wanted = set(keywords)

    @F.pandas_udf("array<struct<word: string, tp: int, fp: int, fn: int>>")
    def found(rs: pd.Series, hs: pd.Series) -> pd.Series:
        out = []
        for r, h in zip(rs, hs, strict=True):
            a, b = (r or "").split(), (h or "").split()
            row = []
            for op, i, j in align(a, b):
                if op in "=sd" and a[i] in wanted:
                    row.append({"word": a[i], "tp": int(op == "="), "fp": 0, "fn": int(op != "=")})
                if op in "si" and b[j] in wanted:
                    row.append({"word": b[j], "tp": 0, "fp": 1, "fn": 0})
            out.append(row)
        return pd.Series(out)

    rows = df.select(F.explode(found(reference, hypothesis)).alias("e")).select("e.*")
    sums = with_total(rows, ["word"], *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return sums.select("word", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")))


def exact_match(df: DataFrame, category: str, reference: str, hypothesis: str) -> DataFrame:
    """Rate of equal strings per category and overall."""
    hit = F.sum((F.col(reference).eqNullSafe(F.col(hypothesis))).cast("long")).alias("hits")
    return with_total(df, [category], hit, F.count(F.lit(1)).alias("n")).withColumn("rate", ratio(F.col("hits"), F.col("n")))


def empty_rate(df: DataFrame, hypothesis: str, *keys: str) -> DataFrame:
    """Share of blank hypotheses."""
    blank = (F.trim(F.coalesce(F.col(hypothesis), F.lit(""))) == "").cast("double")
    return df.groupBy(*keys).agg(F.sum(blank).cast("long").alias("empty"), F.avg(blank).alias("rate"))


def top_k_accuracy(df: DataFrame, scores: str, label: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Share of rows whose label (an index) is among the k best scores, from summed hits."""
    order = F.transform(F.sort_array(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))), lambda p: p["i"])
    place = F.array_position(order, F.col(label))
    return df.agg(*(F.avg(((place > 0) & (place <= k)).cast("double")).alias(f"top_{k}") for k in ks))


def multi_label_scores(df: DataFrame, keys: Keys, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 of frames x speakers (label, score), per key and TOTAL."""
    hit = F.col("score") >= threshold
    sums = with_total(df, keys, F.sum((hit & (F.col("label") == 1)).cast("long")).alias("tp"), F.sum(hit.cast("long")).alias("found"), F.sum("label").alias("wanted"))
    return sums.select(*keys, "tp", "found", "wanted", *precision_recall(F.col("tp"), F.col("found"), F.col("wanted")))


def constrained_mean(df: DataFrame, value: str, constraints: dict[str, str]) -> DataFrame:
    """Mean of value over the rows of each named constraint, in one pass."""
    from ..functions.predicates import constraint

    return df.agg(*(F.avg(F.when(constraint(text), F.col(value))).alias(name) for name, text in constraints.items()))


def frechet(a_mean: np.ndarray, a_cov: np.ndarray, b_mean: np.ndarray, b_cov: np.ndarray) -> float:
    """Distance of two Gaussians. The root of the product's trace comes from the eigenvalues of the symmetric form."""
    values, vectors = np.linalg.eigh(a_cov)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b_cov @ root), 0)).sum()
    return float(((a_mean - b_mean) ** 2).sum() + np.trace(a_cov) + np.trace(b_cov) - 2 * cross)


def frechet_distance(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Distance of the Gaussian fits of two sets of vectors; the driver gets means and covariances, a bound by the vector's width."""
    from .statistics import covariance

    fits = []
    for df in (a, b):
        means = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()
        n = len(means)
        mean, cov = np.zeros(n), np.zeros((n, n))
        for r in means:
            mean[r["i"]] = r["m"]
        for r in covariance(df, vector).collect():
            cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cov"]
        fits += [mean, cov]
    return frechet(*fits)
