"""Text and token functions as Column expressions; Python only where Unicode decomposition or alignment asks for it."""

from __future__ import annotations

import re
import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# Abbreviations and their expansions, symbols and their words.
ABBREVIATIONS = {"mrs": "misess", "mr": "mister", "dr": "doctor", "st": "saint", "co": "company", "jr": "junior", "maj": "major", "gen": "general", "drs": "doctors", "rev": "reverend", "lt": "lieutenant", "hon": "honorable", "sgt": "sergeant", "capt": "captain", "esq": "esquire", "ltd": "limited", "col": "colonel", "ft": "fort"}
SYMBOLS = {"+": "plus", "&": "and", "%": "percent"}


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def digits_to_words(text: Column) -> Column:
    """Every digit as a word of its own."""
    out = text
    for i, w in enumerate(DIGIT_WORDS):
        out = F.replace(out, F.lit(str(i)), F.lit(f" {w} "))
    return squeeze(out)


def clean_label(text: Column, numbers: bool = True, deleted: str = "’‘“”\"", blanked: str = ",.?!;:()[]{}-–—") -> Column:
    """Lower case without the deleted characters, the blanked ones as spaces, digits as words, spaces squeezed."""
    out = F.translate(F.lower(F.trim(text)), deleted, "")
    out = F.translate(out, blanked, " " * len(blanked))
    return digits_to_words(out) if numbers else squeeze(out)


def tighten_punctuation(text: Column) -> Column:
    """No space between a word and the punctuation after it."""
    return F.regexp_replace(text, r"(?U)(\w)\s+([.,;!?])", "$1$2")


def separate_punctuation(text: Column, marks: str = ".,?") -> Column:
    quoted = "".join("\\" + m for m in marks)
    return squeeze(F.regexp_replace(text, f"([{quoted}])", " $1 "))


def plain(text: Column, marks: str = ".,?!;:") -> Column:
    """Lower case without punctuation marks."""
    return squeeze(F.lower(without(text, marks)))


def expand_abbreviations(text: Column) -> Column:
    out = text
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\.", full)
    return out


def expand_symbols(text: Column) -> Column:
    out = text
    for mark, word in SYMBOLS.items():
        out = F.replace(out, F.lit(mark), F.lit(f" {word} "))
    return squeeze(out)


def strip_timestamps(text: Column) -> Column:
    """Without <|n|> marks."""
    return squeeze(F.regexp_replace(text, r"<\|\d+\|>", ""))


def replace_last(text: Column, old: str, new: str) -> Column:
    """The last occurrence of old replaced."""
    at = F.locate(old[::-1], F.reverse(text))
    start = F.length(text) - at - len(old) + 2
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), start - 1), F.lit(new), F.substr(text, start + len(old)))).otherwise(text)


def _decompose(form: str):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def fold_accents(text: Column) -> Column:
    """Decomposed, without combining marks."""
    return F.regexp_replace(_decompose("NFD")(text), r"\p{Mn}+", "")


def compose(text: Column) -> Column:
    """Composed form with plain apostrophes."""
    return F.translate(_decompose("NFC")(text), "’‘", "''")


def wrapped(text: Column, width: int = 90) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "\n".join(textwrap.wrap(t, width)))

    return run(text)


# speaker tags <|spltoken0|>


def has_speaker_tags(text: Column) -> Column:
    return text.rlike(r"<\|spltoken\d+\|>")


def ensure_speaker_tag(text: Column) -> Column:
    return F.when(has_speaker_tags(text), text).otherwise(F.concat(F.lit("<|spltoken0|> "), text))


def tagged_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, speaker, word): every word with the last tag before it; words before the first tag go."""
    parts = F.filter(F.split(F.regexp_replace(F.col(text), r"(<\|spltoken\d+\|>)", " $1 "), r"\s+"), lambda w: w != "")
    rows = df.select(key, F.posexplode(parts).alias("pos", "word"))
    tag = F.regexp_extract("word", r"^<\|spltoken(\d+)\|>$", 1)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("speaker", F.last(F.when(tag != "", tag.try_cast("int")), ignorenulls=True).over(w))
    return rows.where((tag == "") & F.col("speaker").isNotNull())


def speaker_character_shares(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Share of characters of each of the speakers 0 ... n - 1: (key, speaker, share)."""
    per = tagged_words(df, key, text).where((F.col("speaker") >= 0) & (F.col("speaker") < n)).groupBy(key, "speaker").agg(F.sum(F.length("word")).alias("c"))
    return per.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(key))).drop("c")


# tokens


def character_ids(text: Column, labels: list[str], unknown: int = -1, lower: bool = True) -> Column:
    """Index in labels of each character; unknown ones go."""
    table = F.create_map(*[x for i, c in enumerate(labels) for x in (F.lit(c), F.lit(i))])
    chars = F.filter(F.split(F.lower(text) if lower else text, ""), lambda c: c != "")
    return F.filter(F.transform(chars, lambda c: F.coalesce(table[c], F.lit(unknown))), lambda i: i != unknown)


def character_vocabulary(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """(char, n) by falling count, then character."""
    out = df.select(F.explode(F.filter(F.split(text, ""), lambda c: c != "")).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.col("n").desc(), "char")
    return out.limit(size) if size else out


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def regex_tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def byte_ids(text: Column, specials: int = 0) -> Column:
    """UTF-8 bytes as numbers, after the special ids."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + specials)).otherwise(F.array().cast("array<int>"))


def offset_by_language(ids: Column, lang: Column, sizes: dict[str, int]) -> Column:
    """Ids of one tokenizer per language in one id space: each language's ids follow the one before."""
    out, base = F.lit(None).cast("array<int>"), 0
    for name, size in sizes.items():
        out = F.when(lang == name, F.transform(ids, lambda i, b=base: i + b)).otherwise(out)
        base += size
    return out


def decode_ids(ids: Column, length: Column, vocabulary: dict[int, str], specials: tuple[int, ...] = ()) -> Column:
    """Text of the first length ids without special ones."""
    table = F.create_map(*[x for i, t in vocabulary.items() for x in (F.lit(i), F.lit(t))])
    used = F.filter(F.slice(ids, 1, length), lambda i: ~i.isin(*specials)) if specials else F.slice(ids, 1, length)
    return F.array_join(F.transform(used, lambda i: table[i]), "")


# stitching of token buffers


def longest_overlap(state: Column, new: Column, limit: int) -> Column:
    """Longest suffix of state, up to limit tokens, that begins new."""
    most = F.least(F.size(state), F.size(new), F.lit(limit))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.slice(state, F.greatest(F.size(state) - k + 1, F.lit(1)), k) == F.slice(new, F.lit(1), k)))
    return F.array_max(fits)


def stitched(state: Column, new: Column, limit: int) -> Column:
    k = longest_overlap(state, new, limit)
    return F.concat(state, F.slice(new, k + 1, F.greatest(F.size(new) - k, F.lit(0))))


def merged_steps(first: Column, second: Column) -> Column:
    """Second time steps appended, moved past the first's end if they go back."""
    shift = F.when((F.size(first) > 0) & (F.size(second) > 0) & (second[0] <= F.element_at(first, -1)), F.element_at(first, -1) - second[0] + 1).otherwise(0)
    return F.concat(first, F.transform(second, lambda x: x + shift))


def common_substring(a: list, b: list) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equal ones the rightmost in a."""
    best, last = (0, 0, 0), {}
    for i, x in enumerate(a):
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = n = last.get(j - 1, 0) + 1
                if n >= best[2]:
                    best = (i - n + 1, j - n + 1, n)
        last = now
    return best


def lcs_merge(buffer: list, data: list, search: int, least: int = 1, separator: list | None = None) -> list:
    """data joined to buffer at the longest common run within the last search tokens; without one of at least least tokens, after a separator."""
    tail = buffer[-search:] if search else []
    a, b, n = common_substring(tail, data)
    if n < least:
        return buffer + (separator or []) + data
    keep = len(buffer) - len(tail) + a
    return buffer[:keep] + data[b:]


def lcs_merged(buffer: Column, data: Column, search: int, least: int = 1) -> Column:
    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_merge(list(a), list(b), search, least) for a, b in zip(x, y, strict=True)])

    return run(buffer, data)


# conversations and prompts


def render_turn(template: str, **slots: Column) -> Column:
    """A template with |slot| places filled."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit(f"|{name}|"), F.coalesce(value.cast("string"), F.lit("")))
    return out


PROMPTS: dict[str, object] = {}


def prompt_format(name: str):
    """Register a function of a DataFrame under a format's name."""
    def keep(f):
        PROMPTS[name] = f
        return f

    return keep


def apply_prompt(df: DataFrame, name: str) -> DataFrame:
    if name not in PROMPTS:
        raise ValueError(f"no such prompt format: {name}; there are {sorted(PROMPTS)}")
    return PROMPTS[name](df)


@prompt_format("chat")
def chat_prompt(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt", render_turn("<|role|>: |text|\n".replace("<|role|>", "|role|"), role=F.col("role"), text=F.col("text")))


def conversation_turns(question: Column, answer: Column, system: Column | None = None, context: Column | None = None) -> Column:
    """Turns (role, value) with optional system and context turns in front; null ones go."""
    turn = lambda role, value: F.when(value.isNotNull(), F.struct(F.lit(role).alias("role"), value.alias("value")))
    parts = [turn("system", system)] if system is not None else []
    parts += [turn("user", context)] if context is not None else []
    return F.filter(F.array(*parts, turn("user", question), turn("assistant", answer)), lambda t: t.isNotNull())


def swap_roles(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.when(t["role"] == "user", "assistant").when(t["role"] == "assistant", "user").otherwise(t["role"]).alias("role"), t["value"].alias("value")))


def placeholders(value: str | list[str] | tuple[str, ...]) -> list[str]:
    """A setting of one placeholder or several as a list."""
    return [value] if isinstance(value, str) else list(value)


def split_placeholders(text: Column, placeholder: str = "<sound>") -> Column:
    """Parts (type, value) around the first audio placeholder: text before, audio, text after; blank text goes."""
    parts = F.split(text, placeholder, 3)
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), F.trim(value).alias("value"))
    all_parts = F.when(F.size(parts) > 1, F.array(item("text", parts[0]), item("audio", F.lit(placeholder)), item("text", parts[1]))).otherwise(F.array(item("text", text)))
    return F.filter(all_parts, lambda p: p["value"] != "")


def fixed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def label_line(start: Column, end: Column, speaker: Column, word: Column) -> Column:
    return F.concat_ws("\t", fixed(start), fixed(end), F.concat(F.lit("["), speaker, F.lit("] "), word))


TENS = ["", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
SCALES = ["", "thousand", "million", "billion", "trillion"]
# Ordinals that aren't the number with "th".
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
CURRENCIES = {"$": ("dollar", "cent"), "£": ("pound", "penny"), "€": ("euro", "cent")}


def spell(n: int) -> str:
    """A whole number in English words."""
    if n == 0:
        return DIGIT_WORDS[0]
    parts, scale = [], 0
    while n:
        n, group = divmod(n, 1000)
        if group:
            hundreds, rest = divmod(group, 100)
            words = [DIGIT_WORDS[hundreds], "hundred"] if hundreds else []
            if 10 <= rest < 20:
                words.append(TEENS[rest - 10])
            else:
                words += [w for w in (TENS[rest // 10], DIGIT_WORDS[rest % 10] if rest % 10 else "") if w]
            parts.append(" ".join([*words, SCALES[scale]]).strip() if scale < len(SCALES) else " ".join(DIGIT_WORDS[int(c)] for c in str(group)))
        scale += 1
    return " ".join(reversed(parts))


def spell_ordinal(n: int) -> str:
    *head, last = spell(n).split(" ")
    last = ORDINALS.get(last, last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return " ".join([*head, last])


def _amount(symbol: str, whole: str, cents: str | None) -> str:
    unit, small = CURRENCIES[symbol]
    plural = lambda n, name: f"{spell(n)} {name if n == 1 else {'penny': 'pence'}.get(name, name + 's')}"
    parts = [plural(int(whole), unit)] if int(whole) or not cents else []
    return ", ".join(parts + ([plural(int(cents.ljust(2, '0')[:2]), small)] if cents and int(cents) else []))


def spell_numbers(text: str) -> str:
    """Amounts, ordinals, decimals and numbers (with thousands' commas) in English words."""
    text = re.sub(r"(?<=\d),(?=\d{3}\b)", "", text)
    text = re.sub(r"([$£€])(\d+)(?:\.(\d{1,2})\b)?", lambda m: _amount(m[1], m[2], m[3]), text)
    text = re.sub(r"\b(\d+)(?:st|nd|rd|th)\b", lambda m: spell_ordinal(int(m[1])), text)
    text = re.sub(r"\b(\d+)\.(\d+)\b", lambda m: f"{spell(int(m[1]))} point {' '.join(DIGIT_WORDS[int(c)] for c in m[2])}", text)
    return re.sub(r"\d+", lambda m: spell(int(m[0])), text)


def numbers_spelled(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else spell_numbers(t))

    return run(text)
