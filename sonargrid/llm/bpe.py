"""Byte-level BPE over Arrow text columns, from a tokenizer file whose path is a parameter.

Texts are cut before each space that something other than white space follows, where this vocabulary's pre-tokens always begin; each distinct
segment of a batch is encoded once and its ids are gathered for all its occurrences. Strings of the file's added tokens get their ids, as they do
in the tokenizers library with its default settings.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import bytes_of

# Fixed value: the pre-token pattern of byte-level BPE with 50,257 ids.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: white space of any script.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Segments begin at these spaces, and at the text's start.
SEAM = re.compile(f" (?=[^{WHITE}])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_ranks(path: str | None = None) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes and ids, added tokens and ids) from a tokenizers JSON file of byte-level BPE. Added tokens with white space in them or around them aren't supported."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            letters[chr(256 + extra)] = b
            extra += 1
    added = {}
    for t in spec.get("added_tokens", []):
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(f"[{WHITE}]", t["content"]):
            raise ValueError(f"added token {t['content']!r} reaches beyond a segment")
        added[t["content"]] = t["id"]
    return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}, added


class Bpe:
    def __init__(self, ranks: dict[bytes, int], added: dict[str, int]):
        import tiktoken

        self.core = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        widths = {**{i: len(token) for token, i in ranks.items()}, **{i: len(token.encode()) for token, i in added.items()}}
        self.width = np.zeros(max(widths) + 1, np.int64)
        self.width[list(widths)] = list(widths.values())

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all").astype(np.uint32) if text else np.zeros(0, np.uint32)

    def segments(self, segments: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that begin at seams, in a row, and where each one's ids begin. sizes: bytes of each."""
        flat = self.encode("".join(segments))
        ends = np.cumsum(sizes)
        reach = np.cumsum(self.width[flat])
        at = np.searchsorted(reach, ends)
        return flat, np.concatenate([[0], at + 1]) if len(segments) else np.zeros(1, np.int64)

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, n + 1 offsets). Null is empty; the id end, if given, closes each text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        data, offs = bytes_of(texts)
        begins = np.sort(np.concatenate([offs[:-1], seams(data, offs)]), kind="stable")
        begins = begins[np.diff(begins, prepend=-1) > 0]
        begins = begins[begins < offs[-1]]  # empty texts have no segment
        cuts = np.append(begins, offs[-1])
        pieces = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        use = np.asarray(coded.indices).astype(np.int64)
        full = np.flatnonzero(np.diff(offs) > 0)
        first = np.searchsorted(begins, offs[full])  # the first segment of a text need not begin at a seam
        heads = pieces.take(pa.array(first)).to_pylist()
        used = np.zeros(len(coded.dictionary), bool)
        used[np.delete(use, first)] = True
        kept = np.flatnonzero(used)
        distinct = coded.dictionary.take(pa.array(kept))
        ids, starts = self.segments(distinct.to_pylist(), np.asarray(pc.binary_length(distinct)).astype(np.int64))
        head_ids = [self.encode(h) for h in heads]
        close = np.array([] if end is None else [end], np.uint32)
        pool = np.concatenate([ids, *head_ids, close]).astype(np.uint32)
        lengths = np.concatenate([np.diff(starts), [len(h) for h in head_ids], [len(close)]]).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        place = np.zeros(len(used), np.int64)
        place[kept] = np.arange(len(kept))
        item = place[use]
        item[first] = len(kept) + np.arange(len(full))
        of_text = np.searchsorted(begins, offs)  # segments before each text
        item = np.insert(item, of_text[1:], len(kept) + len(full))
        sizes = lengths[item]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = pool[np.arange(total[-1]) + np.repeat(begin[item] - total[:-1], sizes)]
        return out, total[of_text + np.arange(n + 1)]


def seams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where SEAM matches in UTF-8 texts: places of the spaces that a character other than white space of the same text follows."""
    at = np.flatnonzero(data == 0x20)
    stop = offs[np.searchsorted(offs, at, "right")]
    at = at[at + 1 < stop]
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c = (wide[at + k] for k in (1, 2, 3))
    white = (a == 0x20) | ((a >= 0x09) & (a <= 0x0D)) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    white |= (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return at[~white]


LOADED: dict[str, Bpe] = {}


def loaded(path: str, ranks) -> Bpe:
    """The encoder of a broadcast vocabulary, made once per worker process."""
    if path not in LOADED:
        LOADED[path] = Bpe(*ranks.value)
    return LOADED[path]
