"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct 5-word shingles. XOR of the shingles' hashes over blocks of the hash range is a parity sketch: one shingle
more or less changes one block, so the number of differing blocks is at most the size of the symmetric difference. Two sets of a and b
shingles that link differ in at most (a + b) / 9; with more blocks than that, one block at least agrees. Sizes fall into bands that
grow by a quarter, a document takes part in its own band and the next, and each band has its number of blocks (pigeonhole join: documents
meet in the task of a block's XOR). A few blocks more than needed make up for empty blocks, which are not emitted; a document with too many
empty ones emits further sketches with other hashes, the last with its empty blocks.

Documents with equal sets are one class. Classes that meet are candidates with the least class of the block; candidates are thinned by the Hamming
distance of bit sketches of about 2 bits a shingle, a lower bound too, and verified on the 64-bit hashes of all shingles, made anew from the texts, which
are moved compressed. Other pairs of a block are tested only if its classes are not in one component yet, so a group of copies costs links in
proportion to its size, and no link between different components is missed. The members of a large block are dealt to chunks of about CHUNK, and
each two chunks are compared in a group of their own, so no task holds a whole block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_batches, bytes_of, cut, drop_cut, give_back, id_filter, join_groups, maybe_in, slices, table
from .suffix_dedup import BASE, roll, scramble

WORDS = 5
#: Documents link when PERCENT * union <= 100 * intersection.
PERCENT = 80
#: The smallest set that links with a set other than itself: 4 shingles within 5.
LEAST = 4
SCHEMES = 4
TEXT_BYTES = 4 << 20
WORD_BYTES = 1 << 18
PART_BYTES = 32 << 20
#: Members of a block that are compared in one group, about.
CHUNK = 512
#: Bytes to which the sketches of a block's members are folded by XOR (which never raises a distance): members of many blocks move one for each.
FOLDED = 128
#: Members of a block whose pairs are all tested at once.
FEW = 8
#: Pairs that share one copy of their first text.
FAN = 256
FOUND = "kind int, a long, b long, n long, data binary"
DOC, EDGE, BUCKET = 0, 1, 2

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODEC = pa.Codec("zstd")
ODD = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def band_limits(top: int) -> np.ndarray:
    """First size of each band, up to beyond top. LEAST is a band of its own; smaller sizes link with nothing but themselves."""
    out = [LEAST, 5]
    while out[-1] <= top:
        out.append(5 * out[-1] // 4 + 1)
    return np.array([*out, 5 * out[-1] // 4 + 1, 2 * out[-1]], np.int64)


def word_hashes(data: np.ndarray, offs: np.ndarray, letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 offsets by text) of words, lower-cased unless letters maps bytes otherwise."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start, stop = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # so many words at a time that the table of powers stays small
        to = max(at + 1, int(np.searchsorted(stop, start[at] + WORD_BYTES, "right")))
        low = start[at]
        out[at:to] = roll(max(stop[to - 1] - low, WORD_BYTES)).spans(letters[data[low : stop[to - 1]]], start[at:to] - low, stop[at:to] - low)
        at = to
    return out, np.searchsorted(start, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text, n + 1 offsets)."""
    w, at = word_hashes(data, offs)
    counts = np.diff(at)
    n = len(w)
    code = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        code += w[j : n - words + 1 + j] * ODD[j]
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[: len(code)] == doc[words - 1 :] if n >= words else np.zeros(0, bool)
    code, owner = scramble(code[whole]), doc[: len(code)][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        rank = np.arange(n) - at[doc]
        sums = np.zeros(len(counts), np.uint64)
        few = counts[doc] < words
        np.add.at(sums, doc[few], w[few] * ODD[rank[few]])
        extra = scramble(sums[short] + counts[short].astype(np.uint64) * np.uint64(BASE))
        code, owner = np.concatenate([code, extra]), np.concatenate([owner, short])
        by = np.argsort(owner, kind="stable")
        code, owner = code[by], owner[by]
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        code[a:b].sort()
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(counts) + 1))


def classes(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; empty sets are 0."""
    sizes = np.diff(offs)
    some = np.flatnonzero(sizes > 0)
    out = np.zeros(len(sizes), np.int64)
    if len(some):
        mixed = scramble(code ^ np.uint64(0x5851F42D4C957F2D))
        out[some] = scramble(np.add.reduceat(mixed, offs[some]) + sizes[some].astype(np.uint64) * np.uint64(BASE)).astype(np.int64)
    return out


def take(code: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offs)[rows]
    edge = np.append(0, np.cumsum(size))
    return code[np.arange(edge[-1]) + np.repeat(offs[rows] - edge[:-1], size)], edge


def bits_of(code: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A parity sketch of each set, of a power of two bits, about twice its size: each shingle flips a bit."""
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        width = 1 << max(6, (2 * (b - a) - 1).bit_length())
        odd = np.bincount((code[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def block_keys(code: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all blocks that the sets with these rows emit; equal keys make candidates. Sizes are LEAST at least."""
    size = np.diff(offs)
    limits = band_limits(int(size.max())) if len(size) else band_limits(5)
    band = np.searchsorted(limits, size, "right") - 1
    keys, rows = [], []
    for guest in (0, 1):
        k = band + guest
        top = limits[k + 1] - 1
        blocks = 2 * top // 9 + 2 + top // 64
        partner = np.minimum(top, 5 * size // 4)
        spare = blocks - (size + partner) // 9  # fewer empty blocks than that are safe
        possible = size > LEAST if not guest else 5 * size // 4 >= limits[k]  # two sets of LEAST link only if they are equal
        todo = np.flatnonzero(possible)
        for scheme in range(SCHEMES):
            if not len(todo):
                break
            part, edge = (code, offs) if len(todo) == len(size) else take(code, offs, todo)
            owner = np.repeat(np.arange(len(todo)), np.diff(edge))
            if scheme:
                part = scramble(part + np.uint64(scheme * BASE & (1 << 64) - 1))
                part = part[np.lexsort((part, owner))]
            block = ((part >> np.uint64(32)) * blocks[todo][owner].astype(np.uint64)) >> np.uint64(32)
            head = np.ones(len(part), bool)
            head[1:] = (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(head)
            parity = np.bitwise_xor.reduceat(scramble(part + np.uint64(77)), at)
            tag = (k[todo].astype(np.uint64) * np.uint64(SCHEMES) + np.uint64(scheme)) * np.uint64(0xA24BAED4963EE407)
            keys.append(scramble(parity + scramble(tag[owner[at]] + block[at] * np.uint64(0x9FB21C651E98DF25))))
            rows.append(todo[owner[at]])
            empty = blocks[todo] - np.bincount(owner[at], minlength=len(todo))
            if scheme == SCHEMES - 1:
                for i in np.flatnonzero(empty >= spare[todo]).tolist():
                    gaps = np.setdiff1d(np.arange(blocks[todo[i]], dtype=np.uint64), block[at][owner[at] == i])
                    keys.append(scramble(scramble(tag[i] + gaps * np.uint64(0x9FB21C651E98DF25))))
                    rows.append(np.full(len(gaps), todo[i]))
            todo = todo[empty >= spare[todo]]
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def rows_batch(kind: int, a, b, n, data) -> pa.RecordBatch:
    m = len(a)
    columns = [pa.array(np.full(m, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def sketch_map(parts: int):
    """Texts to packed rows by part: block keys (4 bytes each; the part tells the rest) by class, and the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            data, offs = bytes_of(batch.column("text"))
            code, edge = shingle_sets(data, offs)
            ids = classes(code, edge)
            size = np.diff(edge)
            _, first = np.unique(ids, return_index=True)
            once = np.zeros(len(ids), bool)
            once[first] = True
            sketch = np.full(len(ids), None, object)
            large = np.flatnonzero(once & (size >= LEAST))
            part_code, part_edge = take(code, edge, large)
            sketch[large] = bits_of(part_code, part_edge)
            docs = rows_batch(DOC, batch.column("doc_id"), ids, size, list(sketch))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as w:
                w.write_batch(docs)
            home = int(np.uint64(ids[0] & ((1 << 62) - 1)) % np.uint64(parts)) if len(ids) else 0
            out: dict[str, list] = {"part": [home], "ids": [b""], "counts": [b""], "keys": [sink.getvalue().to_pybytes()]}
            keys, rows = block_keys(part_code, part_edge)
            part = (keys >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.lexsort((rows, part))
            keys, rows, part = keys[order], rows[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            low = keys.astype(np.uint32)
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                mine = rows[cuts[p] : cuts[p + 1]]
                head = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                size = np.diff(np.append(head, len(mine)))
                times = -(-size // 255)  # entries of a class: a count is one byte
                counts = np.full(int(times.sum()), 255, np.uint8)
                counts[np.cumsum(times) - 1] = size - 255 * (times - 1)
                out["part"].append(p)
                out["ids"].append(np.repeat(ids[large[mine[head]]], times).tobytes())
                out["counts"].append(counts.tobytes())
                out["keys"].append(low[cuts[p] : cuts[p + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("ids", "counts", "keys"))], list(out))

    return run


def meet(rows: pa.Table) -> pa.Table:
    """Packed rows of one part to documents, candidate edges (least class of a block, other class, blocks shared here) and blocks of three classes or more."""
    out, ids, keys = [], [], []
    for i, c, k in zip(rows["ids"].to_pylist(), rows["counts"].to_pylist(), rows["keys"].to_pylist(), strict=True):
        if not i:
            out += pa.ipc.open_stream(k).read_all().to_batches()
            continue
        keys.append(np.frombuffer(k, np.uint32))
        ids.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint8)))
    if ids:
        key, node = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        key, node = key[order], node[order]
        twice = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        key, node = key[twice], node[twice]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        first = np.repeat(node[head], size)
        other = np.ones(len(key), bool)
        other[head] = False
        pairs, support = np.unique(np.stack([first[other], node[other]], 1), axis=0, return_counts=True) if other.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        out.append(rows_batch(EDGE, pairs[:, 0], pairs[:, 1], support, [None] * len(pairs)))
        lists = {node[a : a + s].tobytes() for a, s in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True)}
        out.append(rows_batch(BUCKET, [None] * len(lists), [None] * len(lists), [len(x) // 8 for x in lists], list(lists)))
    schema = rows_batch(DOC, [], [], [], []).schema
    return pa.Table.from_batches(out, schema) if out else schema.empty_table()


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (class_id, first_id, rows, n, sketch) plus short, the sketch folded."""
    for batch in batches:
        short = [x and np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, min(len(x), FOLDED)), 0).tobytes() for x in batch.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(short, pa.binary())], [*batch.schema.names, "short"])


def hamming(x: bytes, y: bytes) -> int:
    """Distance of two sketches at the width of the narrower; the wider is folded by XOR."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, width), 0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m) and hamming(x, y) <= (n + m) // 9


def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with sizes and bit sketches to those that may link."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
        kept = pa.array([may_link(*r) for r in rows], pa.bool_())
        yield batch.select(["a", "b", "n"]).filter(kept)


def cross_pairs(whole: bool):
    """Two chunks of a block (low, high, members with chunk, component, size, sketch) to the pairs of different components that may link.

    Not whole: of more than FEW members each only names the closest one of another component, so a group costs pairs in proportion to its size;
    whole: what is still apart is tested against all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for low, high, members in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "members")), strict=True):
                chunk, node, component, n = (np.array([m[c] for m in members], np.int64) for c in ("chunk", "node", "component", "n"))
                width = min(len(m["sketch"]) for m in members)
                sketch = np.stack([np.bitwise_xor.reduce(np.frombuffer(m["sketch"], np.uint64).reshape(-1, width // 8), 0) for m in members])
                every = whole or len(node) <= FEW
                for i in range(len(node)):
                    other = component != component[i]
                    other &= (5 * n >= 4 * n[i]) & (5 * n[i] >= 4 * n)
                    if low != high:
                        other &= chunk != chunk[i]
                    if every:
                        other[i:] = False
                    j = np.flatnonzero(other)
                    if len(j):
                        far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1)
                        near = far <= (n[j] + n[i]) // 9
                        j = j[near] if every else j[near][np.argsort(far[near], kind="stable")[:1]]
                        found.update((min(int(x), int(node[i])), max(int(x), int(node[i]))) for x in node[j])
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def tiles(member: DataFrame, whole: bool, chunk: int) -> DataFrame:
    """(block, low, high, chunk, node, component, more) of members (block, node, component) of blocks with several components.

    A component of more than chunk members in the block has chunks of its own, by hash of the node; the others share chunks by hash of the
    component. Two chunks meet as (low, high) unless both are of one component; not whole: each chunk of small components meets itself and one chunk
    of each large component, and large components meet with one chunk each, which joins most of what belongs together. more: the block may have
    pairs that are not tested.
    """
    per = member.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") > chunk
    block = per.groupBy("block").agg(
        F.count(F.lit(1)).alias("kinds"),
        F.sum("n").alias("size"),
        F.ceil(F.sum(F.when(large, 0).otherwise(F.col("n"))) / chunk).cast("int").alias("small"),
        F.sort_array(F.collect_list(F.when(large, F.struct("component", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))))).alias("large"),
    )
    kind = "struct<component: bigint, sub: int, parts: int>"
    of_small = F.expr(f"transform(filter(sequence(0, small), i -> i < small), i -> cast(struct(null, i, small) as {kind}))")
    of_large = F.expr(f"flatten(transform(large, x -> transform(sequence(0, x.parts - 1), i -> cast(struct(x.component, i, x.parts) as {kind}))))")
    block = block.where("kinds > 1").select("block", "size", "small", F.concat(of_small, of_large).alias("chunks"))
    dealt = join_groups(member, block, "block", "size", member.count())
    home = F.expr("get(filter(chunks, x -> x.component = component), 0).parts")
    dealt = dealt.withColumn("parts", home).withColumn("sub", F.pmod(F.when(F.col("parts").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node")), F.coalesce("parts", "small")).cast("int"))
    dealt = dealt.withColumn("chunk", F.expr("array_position(transform(chunks, x -> x.sub = sub and x.component <=> if(parts is null, null, component)), true) - 1").cast("int"))
    if whole:
        meets = "x.component is null or parts is null or x.component <> component"
    else:
        meets = "case when parts is null and x.component is null then x.sub = sub when parts is null then x.sub = pmod(sub, x.parts) when x.component is null then pmod(x.sub, parts) = sub else x.sub = 0 and sub = 0 and x.component <> component end"
    partner = F.expr(f"filter(transform(chunks, (x, i) -> if({meets}, i, -1)), i -> i >= 0)")
    dealt = dealt.withColumn("more", F.col("size") > min(FEW, chunk)).withColumn("partner", F.explode(partner))
    return dealt.select("block", F.least("chunk", "partner").alias("low"), F.greatest("chunk", "partner").alias("high"), "chunk", "node", "component", "more")


def packed_text(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + CODEC.compress(text, asbytes=True)


def raw_size(x: bytes) -> int:
    return int.from_bytes(x[:8], "little")


def common(texts: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that the texts a and b have in common, shingles of either set) for each pair."""
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    code, edge = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offs)
    _, dense = np.unique(code, return_inverse=True)
    sides, n = [], len(a)
    for rows in (a, b):
        mine, cuts = take(dense.reshape(-1).astype(np.uint64), edge, rows)
        sides.append((np.repeat(np.arange(n, dtype=np.uint64), np.diff(cuts)) << np.uint64(32)) | mine)
    merged = np.sort(np.concatenate(sides))
    both = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
    size = np.diff(edge)
    return both, size[a] + size[b] - both


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, packed) in order of a and salt, the row of a itself (b null) first, to the pairs (a, b) that link. Only so much text is unpacked at once."""
    head: bytes | None = None
    for batch in batches:
        pairs: list[tuple[int, int, bytes, bytes]] = []
        out: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            known: dict[bytes, int] = {}
            for *_, x, y in pairs:
                known.setdefault(x, len(known))
                known.setdefault(y, len(known))
            texts = [CODEC.decompress(x[8:], raw_size(x), asbytes=True) if raw_size(x) else b"" for x in known]
            both, either = common(texts, np.array([known[p[2]] for p in pairs]), np.array([known[p[3]] for p in pairs]))
            out.extend(p[:2] for p, linked in zip(pairs, (100 * both >= PERCENT * either).tolist(), strict=True) if linked)
            pairs.clear()

        for a, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed")), strict=True):
            if b is None:
                head = x
                continue
            if pairs and size + raw_size(x) > TEXT_BYTES:
                flush()
                size = 0
            pairs.append((a, b, head, x))
            size += raw_size(x)
        if pairs:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        give_back()


def class_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (class, packed text)."""
    for batch in slices(batches, "text", TEXT_BYTES):
        data, offs = bytes_of(batch.column("text"))
        ids = classes(*shingle_sets(data, offs))
        packed = [packed_text(data[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(packed, pa.binary())], ["node", "packed"])


def fetch_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed) of the classes whose first documents are wanted (doc_id). A bounded filter picks the texts; its false hits are harmless."""
    filtered = id_filter(wanted, "doc_id", "wanted")
    hit = maybe_in(docs, filtered, "doc_id", "hit").where("hit")
    out = cut(hit.select("text").mapInArrow(class_texts, "node long, packed binary"), "texts")
    drop_cut(filtered)
    return out


def link(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Each text moves to the groups of pairs that need it: a class that is first in very many pairs has a group for each FAN of them.

    Rows that repeat a class (a false hit of the filter) are compared twice, which does no harm.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("salts"))
    first = counts.select(F.col("a").alias("node"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    other = pairs.join(counts, "a").select(F.col("b").alias("node"), "a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    rows = texts.join(first.unionByName(other), "node").select("a", "salt", "b", "packed")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of docs.

    component_id is the smallest doc_id reachable by links, the row's own included; class_id names the set of shingles (equal for equal sets). Texts
    without words (null and empty ones too) have 0 shingles and are a component each. Under 5 words the sequence is the only shingle. Repeated
    rows are linked as equal sets are. doc_id must be a whole number; a null one is not comparable and stands for itself. Other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    blocks = rows.mapInArrow(sketch_map(parts), "part int, ids binary, counts binary, keys binary")
    found = cut(blocks.groupBy("part").applyInArrow(meet, FOUND), "met")
    listed = found.where(f"kind = {DOC}").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("class_id"), F.col("data").alias("sketch"))
    groups = listed.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    groups = cut(groups.mapInArrow(folded, "class_id long, first_id long, rows long, n long, sketch binary, short binary"), "classes")

    def described(pairs: DataFrame) -> DataFrame:
        a = groups.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = groups.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return pairs.join(b, "b").join(a, "a")

    edges = found.where(f"kind = {EDGE}").groupBy("a", "b").agg(F.sum("n").alias("n"))
    edges = cut(described(edges).select("a", "b", "n", "na", "nb", "sa", "sb").mapInArrow(thin, "a long, b long, n long"), "candidates")

    def texts_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
        return fetch_texts(rows, nodes.join(groups, "class_id").select(F.col("first_id").alias("doc_id")))

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        a, b = (label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def joined(links: DataFrame | None, label: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links and their components; what they replace is deleted."""
        new = cut(more if links is None else links.unionByName(more), "links")
        found = components(new)
        for old in (links, label):
            if old is not None:
                drop_cut(old)
        return new, found

    # the candidate that shares most blocks with a class, then the other candidates of different components
    texts = texts_of(edges)
    best = edges.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")
    links, label = joined(None, None, link(best, texts))
    rest = cut(apart(edges.select("a", "b").join(best, ["a", "b"], "left_anti"), label), "rest")
    if rest.limit(1).count():
        links, label = joined(links, label, link(rest, texts))
    for old in (texts, rest, edges):
        drop_cut(old)
    # all other pairs within blocks, of different components
    block = found.where(f"kind = {BUCKET}").select(F.xxhash64("data").alias("block"), "data").dropDuplicates(["block"])
    member = cut(block.mapInArrow(members, "block long, node long"), "members")
    whole, linked = False, links.count()
    while True:
        labelled = cut(member.join(label, "node", "left").select("block", "node", F.coalesce("component", "node").alias("component")), "labelled")
        dealt = cut(tiles(labelled, whole, chunk), "tiles")
        described_members = dealt.join(groups.select(F.col("class_id").alias("node"), "n", F.col("short").alias("sketch")), "node")
        compared = described_members.groupBy("block", "low", "high").agg(F.collect_list(F.struct("chunk", "node", "component", "n", "sketch")).alias("members"))
        late = cut(compared.mapInArrow(cross_pairs(whole), "a long, b long").distinct(), "crossed")
        tested, before = late.count(), linked
        if tested:
            texts = texts_of(late)
            links, label = joined(links, label, link(late, texts))
            linked = links.count()
            drop_cut(texts)
        more = cut(member.join(dealt.where("more").select("block").distinct(), "block", "left_semi"), "members")
        for old in (labelled, dealt, late, member):
            drop_cut(old)
        member = more
        if whole or not member.limit(1).count():
            break
        # where most closest pairs link, as in a group of copies, they are named again: each such turn halves the components; then what is still apart is tested whole
        whole = 2 * (linked - before) < tested
    drop_cut(member)
    first = groups.select("class_id", "first_id")
    by_doc = links.join(first.withColumnsRenamed({"class_id": "a", "first_id": "fa"}), "a").join(first.withColumnsRenamed({"class_id": "b", "first_id": "fb"}), "b")
    drop_cut(label)
    label = components(by_doc.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    drop_cut(links)
    verdict = groups.join(label, groups["first_id"] == label["node"], "left").select("class_id", "rows", F.coalesce("component", "first_id").alias("component_id"))
    some = join_groups(listed.where("n_shingles > 0").drop("sketch"), verdict, "class_id", "rows", listed.count())
    none = listed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class_id")
    return some.select("doc_id", "n_shingles", "component_id", "class_id").unionByName(none)


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (packed classes) to one row per member."""
    for batch in batches:
        data, offs = bytes_of(batch.column("data"))
        size = np.diff(offs) // 8
        yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.frombuffer(data.tobytes(), np.int64))], ["block", "node"])


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
