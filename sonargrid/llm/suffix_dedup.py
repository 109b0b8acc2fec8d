"""Removal of long repeated passages with a run-length index.

A passage of SPAN bytes that repeats must be met in one task with its earlier occurrence, without moving the corpus there:

1. Anchors. In every string of SPAN bytes the GRAM-byte gram of least hash is an anchor, so equal strings have the same anchor at the
   same place. About one byte in 40 is one. Anchors shuffle by hash as packed arrays; those that occur once go. Of anchors that repeat within a batch
   one is shuffled, the others are known to repeat.
2. Contexts. The strings that have one anchor are those that start within a few bytes: together they are its context, about 140 bytes. Hashes of the
   contexts of anchors that repeat (128 bits) shuffle by anchor. Equal contexts of an anchor are reduced to their first occurrence, within each task before the
   shuffle and then over all; the others are removed whole. Where an anchor has several contexts, the bytes of each are fetched from its document, once.
3. Index. A task sorts the suffixes of its contexts, forms the Burrows-Wheeler transform and its runs, and takes the match length of
   each run's first suffix with the suffix before it. These samples at run ends are all that is measured: streaming over the text, every other
   match length follows from the last sample (it falls by one a byte). Suffixes joined by matches of SPAN bytes or more are one string; all but its
   first occurrence are marked.
4. The marks go back to their documents, where covered bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_batches, bytes_of, slices, table

SPAN, GRAM = 100, 20
CHUNK = 1 << 19
#: Bytes of contexts that one index holds, unless a single anchor has more.
INDEX_BYTES = 900_000
PART_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
DOC = np.dtype([("doc", "<i8"), ("hash", "<i4")])
ANCHORS = {"keys": np.dtype("<u8"), "at": np.dtype("<u4"), "lead": np.dtype("u1"), "more": np.dtype("u1")}
HASHES = {"keys": np.dtype("<u8"), "digest": np.dtype("<u8"), "second": np.dtype("<u8"), "at": np.dtype("<u4"), "size": np.dtype("<u2")}
SPANS = {"keys": np.dtype("<u8"), "at": np.dtype("<u4"), "stop": np.dtype("<u4")}
TEXTS = {"keys": np.dtype("<u8"), "at": np.dtype("<u4"), "size": np.dtype("<u2"), "bytes": np.dtype("u1")}


def packed(columns: dict) -> str:
    return "part int, kind int, docs binary, doc binary, " + ", ".join(f"{c} binary" for c in columns)


class Roll:
    """Rolling hashes of all windows of bytes in an array, in wrapping 64-bit arithmetic."""

    def __init__(self, size: int):
        self.size = size
        self.letter = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
        self.up = np.full(size, BASE, np.uint64)
        self.up[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        self.down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.up[: len(data)], out=out[1:])
        return out

    def other(self, seed: int) -> Roll:
        """The same powers for other letters."""
        out = copy(self)
        out.letter = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
        return out

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        s = self.sums(data)
        return scramble((s[width:] - s[:-width]) * self.down[: len(s) - width])

    def spans(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s = self.sums(data)
        return scramble((s[stop] - s[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(BASE))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


ROLLS: dict[int, Roll] = {}


def roll(size: int) -> Roll:
    """A table of powers for arrays of that size, kept by the worker in steps of two."""
    size = 1 << max(16, int(size).bit_length())
    if size not in ROLLS:
        ROLLS.clear()
        ROLLS[size] = Roll(size)
    return ROLLS[size]


def anchors(data: np.ndarray, offs: np.ndarray, span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in data, hash of the gram, first and last start of the strings that have it) of all anchors. Strings never cross documents; memory is bounded by chunk."""
    width = span - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    ends = offs[1:]
    r = roll(chunk + span)
    for a in range(0, len(data), chunk):
        piece = data[a : a + chunk + span - 1]
        if len(piece) < span:
            break
        h = r.windows(piece, gram)
        n = len(piece) - span + 1
        fit = np.zeros(n + 1, np.int64)  # strings that stay in their document
        low, high = np.maximum(offs[:-1] - a, 0), np.minimum(ends - span + 1 - a, n)
        some = (low < high) & (low < n)
        np.add.at(fit, low[some], 1)
        np.add.at(fit, high[some], -1)
        starts = np.flatnonzero(np.cumsum(fit[:-1]) > 0)
        if not len(starts):
            continue
        step, least = 1, (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[:n], least[width - step : width - step + n])
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(head[1:], len(at)) - 1
        found.append((at[head] + a, h[at[head]], starts[head] + a, starts[last] + a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, keys, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # an anchor may end one chunk and begin the next
    return at[head], keys[head], first[head], last[np.append(head[1:], len(at)) - 1]


def distances(size: np.ndarray) -> np.ndarray:
    """For texts of these sizes, each followed by a separator: bytes from each place up to the next separator."""
    ends = np.cumsum(size + 1) - 1
    return np.repeat(ends, size + 1) - np.arange(int((size + 1).sum()))


def suffix_order(codes: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix array, packed first symbols, bits a symbol) of texts up to depth long. codes: symbols from 1, 0 for separators, which are distinct, in order of place.

    Prefix doubling. Up to 2^20 suffixes a key and its place fit one integer, which sorts much faster than an index.
    """
    n = len(codes)
    bits = max(1, int(codes.max(initial=0)).bit_length())
    width = 63 // bits
    padded = np.concatenate([codes, np.zeros(width + 1, np.int64)])
    packed_symbols = np.zeros(n, np.int64)
    for i in range(width):
        packed_symbols = (packed_symbols << bits) | np.where(left < i, 0, padded[i : i + n])  # what follows a separator doesn't count
    place = max(1, (n - 1).bit_length())
    small = 3 * place <= 63
    if small:
        width_sorted = max(1, (63 - place) // bits)
        key = packed_symbols >> (bits * (width - width_sorted))
    else:
        width_sorted, key = width, packed_symbols
    places = np.arange(n)
    while True:
        if small:
            both = np.sort((key << place) | places)
            order = both & ((1 << place) - 1)
            sorted_key = both >> place
        else:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
        closed = left < width_sorted
        new = np.ones(n, bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | closed[order[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if width_sorted > depth or new.all():
            return order, packed_symbols, bits
        following = np.zeros(n, np.int64)
        following[: n - width_sorted] = rank[width_sorted:]
        following[closed] = 0
        key = (rank << place) | following
        width_sorted *= 2


class RunLengthIndex:
    """Suffix order, Burrows-Wheeler runs and the match lengths at their ends, of a few texts in order of occurrence."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        """data: all texts in a row; size: of each."""
        n = int(size.sum()) + len(size)
        self.left = distances(size)
        codes = np.zeros(n, np.int64)
        used = np.flatnonzero(np.bincount(data, minlength=256))
        dense = np.zeros(256, np.int64)
        dense[used] = np.arange(1, len(used) + 1)
        codes[self.left > 0] = dense[data]
        self.suffixes, symbols, self.bits = suffix_order(codes, self.left, int(size.max()) if len(size) else 0)
        before = codes[self.suffixes - 1]
        self.run_head = np.ones(n, bool)
        self.run_head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.runs = int(self.run_head.sum())
        heads = np.flatnonzero(self.run_head)
        heads = heads[heads > 0]
        self.sampled = self.suffixes[heads]
        self.samples = self.common(symbols, self.sampled, self.suffixes[heads - 1])

    def common(self, symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), np.int64)
        todo = np.arange(len(a))
        width, at = 63 // self.bits, 0
        while len(todo):
            differ = symbols[a[todo] + at] ^ symbols[b[todo] + at]
            same = differ == 0
            x = differ[~same]
            top = np.frexp(x.astype(np.float64))[1].astype(np.int64)  # bit length, one too many where rounding reached the next power
            top -= (np.int64(1) << np.minimum(top - 1, 62)) > x
            out[todo[~same]] = at + (width * self.bits - top) // self.bits
            todo, at = todo[same], at + width
            out[todo] = at
            todo = todo[most[todo] > at]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of its match with the suffix before it in suffix order, streamed from the samples."""
        n = len(self.left)
        reach = np.zeros(n, np.int64)
        reach[self.sampled] = self.samples + self.sampled
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)

    def repeats(self, occurrence: np.ndarray, span: int) -> np.ndarray:
        """Places whose first span bytes also occur at a smaller occurrence number. Equal numbers are one occurrence."""
        match = self.matching_statistics()[self.suffixes]
        starts = np.flatnonzero(match < span)
        sizes = np.diff(np.append(starts, len(match)))
        number = occurrence[self.suffixes]
        if not len(starts):
            return np.zeros(0, np.int64)
        first = np.repeat(np.minimum.reduceat(number, starts), sizes)
        return self.suffixes[(number > first) & np.repeat(sizes > 1, sizes)]


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size] of all spans, in a row."""
    total = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - total, size)]


def digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each span of data; starts ascend."""
    out, second = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + CHUNK, "left")))
        low, high = start[at], int((start[at:to] + size[at:to]).max())
        r = roll(max(high - low, CHUNK + SPAN))
        span = data[low:high], start[at:to] - low, start[at:to] - low + size[at:to]
        out[at:to], second[at:to] = r.spans(*span), r.other(21).spans(*span)
        at = to
    return out, second


def distinct(keys: np.ndarray, digest: np.ndarray, second: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts that repeat an earlier one of their anchor whole, first occurrences, by anchor). number: occurrence number; rows that repeat one are no copies."""
    order = np.lexsort((number, second, digest, keys))
    fresh = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (keys, digest, second):
        same &= x[order][1:] == x[order][:-1]
    fresh[1:] = ~same
    owner = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    return order[~fresh & (number[owner] != number[order])], order[fresh]


def compare(keys: np.ndarray, digest: np.ndarray, second: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts that repeat an earlier one whole, first occurrences of the contexts of anchors that have several)."""
    copies, firsts = distinct(keys, digest, second, number)
    head = np.flatnonzero(np.append(True, keys[firsts][1:] != keys[firsts][:-1])) if len(firsts) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(firsts)))
    return copies, firsts[np.repeat(count > 1, count)]


def repeated_strings(keys: np.ndarray, number: np.ndarray, data: np.ndarray, size: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, place in it) of the strings that occur at a smaller number. number: occurrence number of each context's first byte, documents far apart."""
    start = np.cumsum(size) - size
    kept = np.lexsort((number, keys))
    cuts = np.append(np.flatnonzero(np.append(True, keys[kept][1:] != keys[kept][:-1])), len(kept)) if len(kept) else np.zeros(1, np.int64)
    weight = np.append(0, np.cumsum(size[kept] + 1))
    out, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(weight[cuts], weight[cuts[at]] + INDEX_BYTES, "right")) - 1)
        these = kept[cuts[at] : cuts[to]]
        at = to
        index = RunLengthIndex(gather(data, start[these], size[these]), size[these])
        context = np.repeat(np.arange(len(these)), size[these] + 1)
        inside = np.arange(len(context)) - np.repeat(np.cumsum(size[these] + 1) - size[these] - 1, size[these] + 1)
        hits = index.repeats(number[these][context] + inside, span)
        out.append((these[context[hits]], inside[hits]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document joined."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    base = doc * (1 << 40)
    reach = np.maximum.accumulate(base + stop)
    new = np.append(True, (base + start)[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(doc)) - 1
    return doc[heads], start[heads], reach[last] - base[heads]


class Parts:
    """Packed rows joined: documents get numbers in order of (doc, hash), doc has the number of each entry, of its columns."""

    def __init__(self, rows: pa.Table, columns: dict[str, np.dtype]):
        tables = [np.frombuffer(x, DOC) for x in rows["docs"].to_pylist()]
        stacked = np.concatenate([np.zeros(0, DOC), *tables])
        self.docs, number = np.unique(stacked, return_inverse=True)
        number = number.reshape(-1)
        first = np.cumsum([0, *map(len, tables)])
        self.doc = np.concatenate([np.zeros(0, np.int64), *(number[np.frombuffer(x, np.uint32).astype(np.int64) + f] for x, f in zip(rows["doc"].to_pylist(), first, strict=False))])
        self.of = {c: np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in columns.items()}
        for c in ("at", "lead", "more", "size", "stop"):
            if c in self.of:
                self.of[c] = self.of[c].astype(np.int64)


def deal(part: np.ndarray, docs: np.ndarray, doc: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, np.dtype], kind: int = 0, spans: tuple | None = None) -> pa.RecordBatch:
    """One row per part: the documents it refers to and its slices of the columns, packed. spans: (data, start, size) for the column bytes."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
    out: dict[str, list] = {c: [] for c in ("part", "kind", "docs", "doc", *kinds)}
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        these = order[a:b]
        used, local = np.unique(doc[these], return_inverse=True)
        out["part"].append(int(part[these[0]]))
        out["kind"].append(kind)
        out["docs"].append(docs[used].tobytes())
        out["doc"].append(local.astype(np.uint32).tobytes())
        for c, as_kind in kinds.items():
            out[c].append(gather(spans[0], spans[1][these], spans[2][these]).tobytes() if c == "bytes" else columns[c][these].astype(as_kind).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c in ("part", "kind") else pa.binary()) for c, x in out.items()], list(out))


MIX = 0x9E3779B1


def part_of(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each of these DOC entries, as doc_part() computes it: rows without an id are dealt by text."""
    doc = docs["doc"]
    return (doc ^ (doc >> 15) ^ (doc >> 32) ^ (docs["hash"].astype(np.int64) * MIX)) % parts


def doc_part(parts: int) -> Column:
    doc, mixed = F.col("doc"), F.col("hash").cast("long") * F.lit(MIX)
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 15)).bitwiseXOR(F.shiftright(doc, 32)).bitwiseXOR(mixed), F.lit(parts)).cast("int")


def doc_table(rows) -> np.ndarray:
    out = np.zeros(rows.num_rows, DOC)
    for c in ("doc", "hash"):
        out[c] = rows.column(c).to_numpy(**({"zero_copy_only": False} if isinstance(rows, pa.RecordBatch) else {}))
    return out


#: Kinds of anchors: single in their batch, one of several in their batch, known to repeat.
SINGLE, SEVERAL, KNOWN = 0, 1, 2


def find_anchors(parts: int, span: int, gram: int):
    """Texts to anchors: by key one of each in the batch, and by document all that repeat in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            data, offs = bytes_of(batch.column("text"))
            at, keys, first, last = anchors(data, offs, span, gram)
            doc = np.searchsorted(offs, at, "right") - 1
            of = {"keys": keys, "at": at - offs[doc], "lead": at - first, "more": last - first}
            docs = doc_table(batch)
            _, one, times = np.unique(keys, return_index=True, return_counts=True)
            often = np.ones(len(keys), bool)
            often[one[times == 1]] = False
            for kind, rows in ((SINGLE, one[times == 1]), (SEVERAL, one[times > 1]), (KNOWN, np.flatnonzero(often))):
                part = part_of(docs[doc[rows]], parts) if kind == KNOWN else (keys[rows] % np.uint64(parts)).astype(np.int64)
                yield deal(part, docs, doc[rows], {c: x[rows] for c, x in of.items()}, ANCHORS, kind)

    return run


def keep_repeated(parts: int):
    """Anchors of one key part, single in their batch, that other batches have too; those known to repeat, of the documents' part of that number, go on."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        p = Parts(rows.filter(pa.array(kind != KNOWN)), ANCHORS)
        keys, single = p.of["keys"], np.repeat(kind[kind != KNOWN] == SINGLE, [len(x) // 8 for x in rows.filter(pa.array(kind != KNOWN))["keys"].to_pylist()])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        often = np.zeros(len(keys), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        often &= single
        doc = p.doc[often]
        found = deal(part_of(p.docs[doc], parts), p.docs, doc, {c: x[often] for c, x in p.of.items()}, ANCHORS)
        return pa.concat_tables([pa.Table.from_batches([found]), rows.filter(pa.array(kind == KNOWN)).cast(found.schema)])

    return run


def located(docs: pa.Table, parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, offsets, row of each document of parts, document of each row or -1) for documents of one part."""
    data, offs = bytes_of(docs["text"])
    mine = doc_table(docs)
    number = np.searchsorted(parts.docs, mine) if len(parts.docs) else np.zeros(len(mine), np.int64)
    known = (number < len(parts.docs)) & (parts.docs[np.minimum(number, len(parts.docs) - 1)] == mine) if len(parts.docs) else np.zeros(len(mine), bool)
    number = np.where(known, number, -1)
    row = np.zeros(len(parts.docs), np.int64)
    row[number[known]] = np.flatnonzero(known)
    return data, offs, row, number


MARK, FETCH, CONTEXT = 0, 1, 2


def hash_contexts(parts: int, span: int):
    """Anchors of documents to hashes of their contexts, of equal ones within the part the first (rows of kind CONTEXT), and the spans of the others (kind MARK; second holds their stops)."""

    def run(key, docs: pa.Table, rows: pa.Table) -> pa.Table:
        p = Parts(rows, ANCHORS)
        data, offs, row, _ = located(docs, p)
        at = p.of["at"] - p.of["lead"]
        size = p.of["more"] + span
        start = offs[row[p.doc]] + at
        order = np.argsort(start)
        digest, second = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        digest[order], second[order] = digests(data, start[order], size[order])
        keys = p.of["keys"]
        copies, firsts = distinct(keys, digest, second, p.doc * (1 << 40) + at)
        of = {"keys": keys, "digest": digest, "second": second, "at": at, "size": size}
        sent = deal((keys[firsts] % np.uint64(parts)).astype(np.int64), p.docs, p.doc[firsts], {c: x[firsts] for c, x in of.items()}, HASHES, CONTEXT)
        doc, begin, stop = merged(p.doc[copies], at[copies], at[copies] + size[copies])
        none = np.zeros(len(doc), np.int64)
        marks = deal(part_of(p.docs[doc], parts), p.docs, doc, {"keys": none, "digest": none, "second": stop, "at": begin, "size": none}, HASHES, MARK)
        return pa.Table.from_batches([sent, marks])

    return run


def compare_contexts(parts: int):
    """Rows of kind MARK: spans that repeat an earlier context. Of kind FETCH: contexts whose bytes are needed."""

    def run(rows: pa.Table) -> pa.Table:
        marked = pa.compute.equal(rows["kind"], MARK)
        p = Parts(rows.filter(pa.compute.invert(marked)), HASHES)
        at, size = p.of["at"], p.of["size"]
        copies, wanted = compare(p.of["keys"], p.of["digest"], p.of["second"], p.doc * (1 << 40) + at)
        doc, start, stop = merged(p.doc[copies], at[copies], at[copies] + size[copies])
        marks = deal(part_of(p.docs[doc], parts), p.docs, doc, {"keys": np.zeros(len(doc), np.uint64), "at": start, "stop": stop}, SPANS, MARK)
        doc = p.doc[wanted]
        fetch = deal(part_of(p.docs[doc], parts), p.docs, doc, {"keys": p.of["keys"][wanted], "at": at[wanted], "stop": at[wanted] + size[wanted]}, SPANS, FETCH)
        q = Parts(rows.filter(marked), HASHES)  # marks of this part's documents, from before the shuffle
        local = deal(part_of(q.docs[q.doc], parts), q.docs, q.doc, {"keys": q.of["keys"], "at": q.of["at"], "stop": q.of["second"].astype(np.int64)}, SPANS, MARK)
        return pa.Table.from_batches([marks, fetch, local])

    return run


def fetch_contexts(parts: int):
    def run(key, docs: pa.Table, rows: pa.Table) -> pa.Table:
        p = Parts(rows, SPANS)
        data, offs, row, _ = located(docs, p)
        at, keys = p.of["at"], p.of["keys"]
        size = p.of["stop"] - at
        return pa.Table.from_batches([deal((keys % np.uint64(parts)).astype(np.int64), p.docs, p.doc, {"keys": keys, "at": at, "size": size}, TEXTS, spans=(data, offs[row[p.doc]] + at, size))])

    return run


def index_contexts(parts: int, span: int):
    def run(rows: pa.Table) -> pa.Table:
        p = Parts(rows, TEXTS)
        at = p.of["at"]
        context, inside = repeated_strings(p.of["keys"], p.doc * (1 << 40) + at, p.of["bytes"], p.of["size"], span)
        start = at[context] + inside
        doc, start, stop = merged(p.doc[context], start, start + span)
        return pa.Table.from_batches([deal(part_of(p.docs[doc], parts), p.docs, doc, {"keys": np.zeros(len(doc), np.uint64), "at": start, "stop": stop}, SPANS, MARK)])

    return run


def without(data: np.ndarray, offs: np.ndarray, owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes kept, removed bytes and maximal removed runs of each text); the spans start : stop of the texts owner go."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offs[owner] + start, 1)
    np.add.at(change, offs[owner] + stop, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    head[first] = gone[first]  # runs end with their text
    sums, heads = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(head))
    return data[~gone], np.diff(sums[offs]), np.diff(heads[offs])


def remove_marks(schema: pa.Schema):
    def run(key, docs: pa.Table, rows: pa.Table) -> pa.Table:
        p = Parts(rows, SPANS)
        data, offs, _, number = located(docs, p)
        order = np.argsort(p.doc, kind="stable")
        first, last = (np.searchsorted(p.doc[order], number, side) for side in ("left", "right"))  # rows that repeat a document share its marks
        out, a = [], 0
        while a < docs.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE_BYTES, "right")) - 1)
            n_marks = (last - first)[a:b]
            owner = np.repeat(np.arange(b - a), n_marks)
            mark = order[np.arange(len(owner)) - np.repeat(np.cumsum(n_marks) - n_marks - first[a:b], n_marks)]
            edges = offs[a : b + 1] - offs[a]
            kept, removed, runs = without(data[offs[a] : offs[b]], edges, owner, p.of["at"][mark], p.of["stop"][mark])
            size = np.diff(edges)
            at = np.append(0, np.cumsum(size - removed))
            text = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())])
            out.append(pa.RecordBatch.from_arrays([docs["id"].slice(a, b - a).combine_chunks().cast(schema.field("doc_id").type), pa.array(size), pa.array(removed), pa.array(runs), text.cast(pa.binary())], schema=schema))
            a = b
        return pa.Table.from_batches(out, schema)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each document's bytes without those covered by a span-byte string that starts earlier.

    Earlier: in a smaller doc_id (null before all), or before it in the same document. Rows that repeat both id and text count as one document
    and all get its result; different texts of one id are ordered by hash. Null text is empty. Texts shorter than span stay whole. Matches are judged on
    the input and never cross documents. Other columns are not read; an empty table gives an empty result. doc_id is a whole number; span is 8 to 300.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    gram = min(GRAM, max(1, span // 4))
    kind = docs.schema[doc_id].dataType
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).alias("id"), ids.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.hash("text")).withColumn("part", doc_part(parts))
    by_part = rows.groupBy("part")
    found = rows.select("doc", "hash", "text").mapInArrow(find_anchors(parts, span, gram), packed(ANCHORS))
    repeated = found.groupBy("part").applyInArrow(keep_repeated(parts), packed(ANCHORS))
    hashed = by_part.cogroup(repeated.groupBy("part")).applyInArrow(hash_contexts(parts, span), packed(HASHES))
    judged = hashed.groupBy("part").applyInArrow(compare_contexts(parts), packed(SPANS))
    texts = by_part.cogroup(judged.where(f"kind = {FETCH}").groupBy("part")).applyInArrow(fetch_contexts(parts), packed(TEXTS))
    marks = judged.where(f"kind = {MARK}").unionByName(texts.groupBy("part").applyInArrow(index_contexts(parts, span), packed(SPANS)))
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    arrow = pa.schema([("doc_id", pa.int64() if isinstance(kind, T.LongType) else pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return by_part.cogroup(marks.groupBy("part")).applyInArrow(remove_marks(arrow), out)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
