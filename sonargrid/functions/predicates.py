"""Row filters of data set preparation, ids and paths, and a small language of constraints."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_between(duration: Column, low: float = 0, high: float | None = None) -> Column:
    """low <= duration <= high; rows without one (text) pass."""
    inside = duration >= low
    return F.coalesce(inside & (duration <= high) if high is not None else inside, F.lit(True))


def tokens_between(n: Column, low: float = 0, high: float | None = None) -> Column:
    return (n >= low) & (n <= high) if high is not None else n >= low


def ratio_between(a: Column, b: Column, low: float = 0, high: float | None = None) -> Column:
    """a / b within bounds; b of 0 fails."""
    r = a / F.nullif(b, F.lit(0))
    inside = r >= low
    return F.coalesce(inside & (r <= high) if high is not None else inside, F.lit(False))


def equal_or_missing(c: Column, keep) -> Column:
    return c.isNull() | (c == keep)


def at_most_or_missing(c: Column, most) -> Column:
    return F.coalesce(c <= most, F.lit(True))


def at_least_or_missing(c: Column, least) -> Column:
    return F.coalesce(c >= least, F.lit(True))


def evidence(parts: list[tuple[Column, float]], every: bool = True) -> Column:
    """Columns at or above their thresholds, all or any of them; thresholds of 0 or less are off, and without any all rows pass."""
    on = [c >= t for c, t in parts if t > 0]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), on) if on else F.lit(True)


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def resolved(path: Column, folder: str) -> Column:
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def chunk_id(base: Column, index: Column, offset: Column, duration: Column) -> Column:
    ms = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%s_chunk%04d_%09d_%09d", base, index.cast("int"), ms(offset), ms(F.coalesce(offset, F.lit(0.0)) + F.coalesce(duration, F.lit(0.0))))


def session_of(chunk: Column) -> Column:
    return F.regexp_replace(chunk, r"_chunk\d+.*$", "")


def timed_id(base: Column, offset: Column, duration: Column, decimals: int = 3) -> Column:
    """base_startms_endms; the base alone without offset or duration."""
    ms = lambda c: F.bround(c * 10**decimals).cast("long").cast("string")
    return F.when(offset.isNull() | duration.isNull(), base).otherwise(F.concat_ws("_", base, ms(offset), ms(offset + duration)))


def to_ticks(x: Column, decimals: int = 3) -> Column:
    return F.bround(x * 10**decimals).cast("long")


def from_ticks(x: Column, decimals: int = 3) -> Column:
    return F.round(x / 10**decimals, decimals)


def item_key(item: Column) -> Column:
    """Last part of a path without _dupN."""
    return F.regexp_replace(F.regexp_extract(item, r"([^/]*)$", 1), r"_dup\d+$", "")


#: Patterns of a chosen letter, in order; the first that matches counts.
ANSWERS = [r"(?i)answer\s*(?:is|:)\s*\(?([A-D])\b", r"(?i)option\s*\(?([A-D])\b", r"^\s*\(?([A-D])[).:\s]", r"^\s*([A-D])\s*$", r"\(([A-D])\)", r"\b([A-D])\b"]


def answer_letter(response: Column) -> Column:
    found = [F.nullif(F.regexp_extract(response, p, 1), F.lit("")) for p in ANSWERS]
    return F.upper(F.coalesce(*found))


def audio_tokens(duration: Column, token_duration: float) -> Column:
    return F.ceil(duration / token_duration)


TOKEN = re.compile(r"\s*(?:(\()|(\))|(==|!=)|\.([A-Za-z_]\w*)|(and|or|xor|not)\b|'([^']*)'|\"([^\"]*)\"|([^\s()=!]+))")


def constraint(text: str) -> Column:
    """A Column from text such as `.lang == en and not (.source != .origin)`.

    .name is a column, other words are literals; comparisons == and !=; not, then and, then xor, then or; parentheses.
    """
    items, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the constraint at {text[at:]!r}")
        at = m.end()
        kind = m.lastindex
        items.append((("(", ")", "cmp", "col", "word", "lit", "lit", "lit")[kind - 1], m[kind]))
    items.append(("end", ""))
    pos = 0

    def peek(kind: str, value: str | None = None) -> bool:
        return items[pos][0] == kind and (value is None or items[pos][1] == value)

    def advance() -> str:
        nonlocal pos
        pos += 1
        return items[pos - 1][1]

    def operand() -> Column:
        if peek("col"):
            return F.col(advance())
        if peek("lit"):
            return F.lit(advance())
        raise ValueError(f"a property or value is expected in {text!r}")

    def primary() -> Column:
        if peek("word", "not"):
            advance()
            return ~primary()
        if peek("("):
            advance()
            out = level(0)
            if not peek(")"):
                raise ValueError(f"a parenthesis isn't closed in {text!r}")
            advance()
            return out
        left = operand()
        if not peek("cmp"):
            return left.cast("boolean")
        same = advance() == "=="
        right = operand()
        equal = left.cast("string").eqNullSafe(right.cast("string"))
        return equal if same else ~equal

    def level(n: int) -> Column:
        names = ("or", "xor", "and")
        if n == len(names):
            return primary()
        out = level(n + 1)
        while peek("word", names[n]):
            advance()
            right = level(n + 1)
            out = out | right if n == 0 else out != right if n == 1 else out & right
        return out

    result = level(0)
    if not peek("end"):
        raise ValueError(f"unread rest in {text!r}")
    return result
