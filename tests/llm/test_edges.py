"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odd import clashing
from sonargrid.llm import bpe, components, exact_dedup, html_extract, language_id, media, mixing, ngram_join, packing, quotes, suffix_dedup, token_counts


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(odd_docs, no_docs):
    out = exact_dedup.exact_dedup(clashing(odd_docs, "kept", "Word", "bits1")).collect()
    assert len(out) == odd_docs.count() and {r["kept"] for r in out} == {"mine"}
    groups = {}
    for r in out:
        groups.setdefault(lower(r["text"]), []).append(r)
    for text, g in groups.items():
        ids = [r["doc_id"] for r in g if r["doc_id"] is not None]
        for r in g:
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["group_size"] == len(g) and r["keep_id"] == max(ids, default=None)
            assert r["kept_"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_folded_filter_loses_nothing(spark):
    df = spark.createDataFrame([(i, f"text {i % 300}") for i in range(600)], "doc_id long, text string")
    for words in (1, 4, 1 << 20):
        assert exact_dedup.exact_dedup(df, max_words=words).where("kept").count() == 300


def test_mixing(spark, odd_docs, no_docs):
    out = mixing.mix(clashing(odd_docs, "size", "copies", "salt"), seed=3)
    found = out.toPandas()
    assert len(found) == odd_docs.count() and found["copies_"].between(0, 3).all() and (found["size"] == "mine").all()
    assert sorted(map(str, out.select("doc_id", "copies_").collect())) == sorted(map(str, mixing.mix(clashing(odd_docs, "size", "copies", "salt").repartition(7), seed=3).select("doc_id", "copies_").collect()))
    assert mixing.mix(no_docs).count() == 0
    assert mixing.emit(out, "copies_").count() == found["copies_"].sum()


def test_mix_of_rows_that_repeat_an_id(spark):
    """Null ids are dealt as others are, and rows that differ in another column only get the same copies in every order."""
    rows = [(None if i % 3 else i // 100, f"text {i % 7} of some words", "a" if i % 2 else "b", i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    one, two = ({r["other"]: r["copies"] for r in mixing.mix(d).collect()} for d in (df, df.repartition(7).orderBy(F.rand(3))))
    assert one == two and len(one) == 900
    sums = {}
    for r in mixing.mix(df).collect():
        sums[r["source"]] = sums.get(r["source"], 0) + r["copies"] * r["size"]
    assert all(abs(sums[r["source"]] - r["target"]) < 10 for r in mixing.mix(df).collect())


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randint(1, 12))}
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "src string, n_docs long, source_size long")
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    full, left = set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in full]
        rest = left - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    got = {r["src"]: r["target"] for r in mixing.targets(df, "src").collect()}
    assert got == pytest.approx(target)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 10)), f"s{i % 4}") for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in out.groupby("source"):
        assert (g["copies"] * g["size"]).sum() == pytest.approx(g["target"].iloc[0], abs=2 * int(g["size"].max()))


def test_media(spark, odd_docs, no_docs):
    out = media.read_media(spark, media.write_media(odd_docs)).toPandas()
    assert Counter(out["doc_id"].fillna("null")) == Counter("null" if r["doc_id"] is None else str(r["doc_id"]) for r in odd_docs.collect())
    assert sorted(out["n_bytes"]) == sorted(len((r["text"] or "").encode()) for r in odd_docs.collect())
    assert media.read_media(spark, media.write_media(no_docs)).count() == 0


def test_member_is_retried_by_its_offset(tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(3):
            z.writestr(f"id/{i}", bytes([i]) * 100)
    info, calls = media.directory(str(path))[1], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return open(path, "rb")

    assert media.read_member(flaky, info, wait=0) == bytes([1]) * 100 and len(calls) == 3
    with pytest.raises(OSError):
        media.read_member(lambda: (_ for _ in ()).throw(OSError("gone")), info, tries=2, wait=0)
    payload = media.payload_of(b"x" * 65)
    assert len(payload) == 128 and media.unwav(media.wav(payload, 65)) == (payload, 65) and len(media.payload_of(b"")) == 64


def test_ranges_cover_all_shards_once():
    shards = [("a", 25), ("b", 3), ("c", 0), ("d", 4), ("e", 100)]
    for size, most in ((10, 1000), (10, 5), (1, 3), (1000, 9)):
        plan = media.plan_ranges(shards, size, most)
        flat = [r for part in plan for r in part]
        assert [(p, x) for p, a, b in flat for x in range(a, b)] == [(p, x) for p, n in shards for x in range(n)] and len(plan) <= max(2 * most, 132 // size * 2 + 2)
    tries = []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")
        return "here"

    assert media.retried(fails, wait=0) == "here" and len(tries) == 3


def test_near_duplicates(odd_docs, no_docs):
    out = {r["doc_id"]: r for r in ngram_join.near_duplicates(clashing(odd_docs, "n", "component_id")).collect()}
    assert out[3]["n_shingles"] == out[4]["n_shingles"] == out[9]["n_shingles"] == 0
    assert out[7]["n_shingles"] == 1 and out[8]["component_id"] == 7
    assert {out[i]["component_id"] for i in (1, 2, 10, 14)} == {1} and out[6]["component_id"] == 5 and out[3]["component_id"] == 3
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(4)
    tried = 0
    for _ in range(3000):
        n = int(rng.choice([5, 6, 8, 10, 13, 20, 40, 90]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(int(0.8 * n), n + 1)], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) >= 5 and 100 * both >= 80 * (len(a) + len(b) - both):
            tried += 1
            x, y = np.sort(ngram_join.scramble(a)), np.sort(ngram_join.scramble(b))
            offs = np.array([0, len(x), len(x) + len(y)])
            keys, row = ngram_join.block_keys(np.concatenate([x, y]), offs)
            assert len(np.intersect1d(keys[row == 0], keys[row == 1]))
            assert ngram_join.may_link(len(x), len(y), *ngram_join.bits_of(np.concatenate([x, y]), offs))
    assert tried > 1000


def test_small_sets_against_brute_force(spark):
    base = "one two three four five six seven eight"
    rng = random.Random(6)
    texts = [base, base + " nine", "zero " + base, base + " nine ten", "a b c d e f g", "a b c d e f g h"]
    for _ in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 12))]
        texts += [" ".join(words), " ".join(["x", *words]), " ".join([*words, "y"])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    expected = list(range(len(texts)))
    for _ in texts:  # least number reachable by links
        for i, a in enumerate(sets):
            expected[i] = min(expected[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b))
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert expected[1] == expected[2] == expected[0] == 0 and expected[5] == 5 and out == dict(enumerate(expected))
    for _ in range(300):
        a = rng.sample(range(1 << 62), 5)
        code = np.concatenate([np.sort(ngram_join.scramble(np.array(x, np.uint64))) for x in (a, a[:4])])
        keys, row = ngram_join.block_keys(code, np.array([0, 5, 9]))
        assert len(np.intersect1d(keys[row == 0], keys[row == 1]))


@pytest.mark.parametrize("chunk", [3, 512])
def test_blocks_of_many_members_against_brute_force(spark, chunk):
    """Groups of near copies and of texts that share passages only, dealt to small chunks; short texts of few words."""
    from test_tables import near_components

    rng = random.Random(chunk)
    words = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words[:3]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    shared = [f"s{i}" for i in range(14)]
    for i in range(80):  # a passage in common, links along chains of tails only
        texts.append(" ".join([*shared, *(f"t{j}" for j in range(i // 2, i // 2 + 6))]))
    for g in range(4):
        body = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            mine = list(body)
            for at in rng.sample(range(len(mine)), rng.randint(0, 2)):
                mine[at] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(mine))
    rng.shuffle(texts)
    expected = {i: c for i, (_, c) in near_components(list(range(len(texts))), texts).items()}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(rows, chunk=chunk).collect()} == expected


def test_chunks_meet_once_or_are_left_for_later(spark):
    """Every pair of different components of a block meets when all is tested, and no two of one large component do."""
    members = [(1, n, 0 if n < 20 else 100 + n // 9 if n < 47 else n) for n in range(60)] + [(2, n, n) for n in range(5)]
    member = spark.createDataFrame(members, "block long, node long, component long")
    met = {}
    for whole in (False, True):
        groups = defaultdict(list)
        for r in ngram_join.tiles(member, whole, 6).collect():
            groups[r["block"], r["low"], r["high"]].append((r["chunk"], r["node"], r["component"]))
        assert max(map(len, groups.values())) < 40
        met[whole] = {(b, x[1], y[1]) for (b, low, high), g in groups.items() for x in g for y in g if x[2] != y[2] and (low == high or x[0] != y[0])}
    assert met[True] == {(b, x, y) for b, x, cx in members for c, y, cy in members if b == c and cx != cy} and met[False] < met[True]


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    expected = {n: root(n) for n in list(parent)}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    for limit in (10**6, 0):
        monkeypatch.setattr(components, "LOCAL_LINKS", limit)
        got = {r["node"]: r["component"] for r in components.components(df).collect()}
        assert {n: c for n, c in expected.items() if n in got} == got and all(expected[n] == n for n in expected if n not in got)


def test_language(spark, odd_docs, no_docs):
    model = language_id.Ppm({"en": [b"the cat and the dog"] * 5, "fr": [b"le chat et le chien"] * 5})
    out = {r["doc_id"]: r for r in language_id.predict(clashing(odd_docs, "score"), model).collect()}
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[15]["lang_pred"] == "und" and out[1]["lang_pred"] == "en" and out[1]["score"] == "mine" and out[3]["score_"] == 0
    nothing = language_id.Ppm({})
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, nothing).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0 and language_id.learn(no_docs).langs == []


def slow_bits(model, samples, lang, text, order):
    """Code length by the definition: escape method C, longest context that has been seen."""
    counts = [Counter() for _ in range(order + 1)]
    for t in samples[lang]:
        for k in range(order + 1):
            counts[k].update(t[i : i + k + 1] for i in range(len(t) - k))
    contexts = set()
    for name in samples:
        for t in samples[name]:
            contexts |= {t[i : i + k] for k in range(1, order + 1) for i in range(len(t) - k)}

    def p(context, byte):
        if context is None:
            return 1 / 256
        shorter = p(context[1:] if context else None, byte)
        after = {g[-1:]: n for g, n in counts[len(context)].items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return shorter
        return after[byte] / (total + len(after)) if byte in after else len(after) / (total + len(after)) * shorter

    bits = 0.0
    for i in range(len(text)):
        context = text[max(0, i - order) : i]
        while context and context not in contexts:
            context = context[1:]
        bits -= np.log2(p(context, text[i : i + 1]))
    return bits


def test_code_lengths():
    samples = {"a": [b"abracadabra", b"banana band"], "b": [b"bubble babble", b"cab"]}
    model = language_id.Ppm(samples, order=2)
    texts = [b"banana", b"", b"zab cab", b"abracadabra banana bubble " * 3]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for lane, cells in ((4, 1 << 20), (1024, 1 << 20), (4, 0), (1024, 0)):
        got = model.bits(data, offs, lane, cells)
        for i, t in enumerate(texts):
            for j, lang in enumerate(model.langs):
                assert got[i, j] == pytest.approx(slow_bits(model, samples, lang, t, 2), rel=1e-4, abs=1e-3)


def test_languages_do_not_depend_on_each_other():
    """Every context is kept, however many languages there are, and a language's code lengths are its own."""
    rng = random.Random(14)
    samples = {f"l{i:02}": ["".join(rng.choice("abcdefghij klmnop"[i % 7 : i % 7 + 9]) for _ in range(400)).encode() for _ in range(4)] for i in range(19)}
    texts = [x[0][:150] + b"\xff" for x in samples.values()]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    all_bits = language_id.Ppm(samples).bits(data, offs)
    for i in (0, 7, 8, 18):
        name = sorted(samples)[i]
        alone = language_id.Ppm({name: samples[name]})
        assert np.allclose(alone.bits(data, offs)[:, 0], all_bits[:, i]) and np.allclose(alone.bits(data, offs, cells=0)[:, 0], all_bits[:, i])
        assert sum(len(a.escape) for a in alone.automata) == 1 + sum(len({t[j : j + k] for t in samples[name] for j in range(len(t) - k)}) for k in range(1, 5))


def brute_removal(texts, span):
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if t[i : i + span] in seen:
                gone[i : i + span] = True
            seen.add(t[i : i + span])
        out.append(gone)
    return out


@pytest.mark.parametrize("span", [8, 20])
def test_passages(spark, span):
    rng = random.Random(span)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["", "a" * 500, "ab" * 200]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, span=span).collect()}
    for i, gone in enumerate(brute_removal([t.encode() for t in texts], span)):
        data = np.frombuffer(texts[i].encode(), np.uint8)
        assert bytes(out[i]["kept"]) == data[~gone].tobytes() and out[i]["n_removed"] == gone.sum() and out[i]["n_spans"] == (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()


def test_passages_of_odd_rows(odd_docs, no_docs):
    out = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["n_bytes"] == by[4][0]["n_removed"] == 0 and by[14][0]["n_removed"] == by[14][0]["n_bytes"] and by[1][0]["n_removed"] == 0
    assert len(by[10]) == 2 and by[10][0]["n_removed"] == by[10][1]["n_removed"] == len("The quick brown fox jumps over the lazy dog and runs through the wide green field until night falls over the quiet valley below") and len(by[None]) == 1
    assert by[12][0]["n_removed"] == 598 and suffix_dedup.remove_repeats(no_docs).count() == 0


def test_run_length_index():
    rng = np.random.default_rng(3)
    for _ in range(100):
        texts = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 40)).astype(np.uint8) for _ in range(rng.integers(1, 8))]
        index = suffix_dedup.RunLengthIndex(np.concatenate(texts), np.array([len(t) for t in texts]))
        codes = [c for j, t in enumerate(texts) for c in [*((1, int(x)) for x in t), (0, j)]]
        order = sorted(range(len(codes)), key=lambda i: codes[i : i + 60])
        assert order == index.suffixes.tolist()
        match = index.matching_statistics()
        for a, b in zip(order[1:], order[:-1], strict=True):
            n = 0
            while max(a, b) + n < len(codes) and codes[a + n] == codes[b + n]:
                n += 1
            assert match[a] == n


def test_packing(spark, odd_docs, no_docs):
    out = packing.packed_digests(odd_docs).toPandas()
    assert (out[out.piece == 0].groupby(out["doc_id"].fillna(-1)).size().sum()) == odd_docs.count() and out.length.between(1, 1024).all()
    assert packing.packed_digests(no_docs).count() == 0
    pieces = packing.token_pieces(odd_docs)
    whole = packing.sequences(packing.pack(pieces, odd_docs.count()))
    assert sum(len(r["ids"]) for r in whole.collect()) == 4 * pieces.agg({"length": "sum"}).first()[0]


def test_best_fit_against_a_scan():
    rng = np.random.default_rng(6)
    for _ in range(30):
        sizes = rng.integers(1, 65, rng.integers(0, 120))
        bins, offsets = packing.best_fit_decreasing(sizes, 64)
        rest: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in rest if r >= s]
            if fits:
                rest[rest.index(min(fits))] -= s
            else:
                rest.append(64 - s)
        assert len(set(bins.tolist())) == len(rest)
        assert sorted(64 - np.bincount(bins, sizes, len(rest)).astype(int)) == sorted(rest) if len(sizes) else not rest
        for b in set(bins.tolist()):
            used = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
            assert [o for o, _ in used] == np.cumsum([0, *(n for _, n in used)])[:-1].tolist()


TEXTS = ["", " ", "  two  spaces", "tail ", "a\n b", "a \n b", "tab\t x", "nbsp  y 　z", "<|endoftext|> plain", "émile's 12 don't  ", "a<|endoftext|>", " <|endoftext|> <|endoftext|><|endoft", "x  y \x85 z\x1c b \u2003c  \u3000 d", "\n\n x\n\n", "日本語 テキスト 🙂🙂 end", " lead", "a" * 3000]


def test_ids_equal_the_tokenizers_library():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice(["word", " ", "\n", "'s", "9", ".", "é", "\t", "  ", "\xa0", "\u2003", "<|endoftext|>", "x y"]) for _ in range(40)) for _ in range(3000)]
    ids, offs = bpe.Bpe(*bpe.load_ranks()).column(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t


def test_edits_against_a_new_count():
    coder, rng = bpe.Bpe(*bpe.load_ranks()), random.Random(9)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta's", "x1", "é", "end.\n", "12,3"]) for _ in range(30)) for _ in range(60)]
    texts += ["".join(rng.choice(["alpha", " ", "  ", "\n", " \xa0", "<|endoftext|>", "é"]) for _ in range(40)) for _ in range(60)]
    counts, edges = token_counts.leaves(pa.array(texts), coder)
    trees = [token_counts.TokenTree(t, token_counts.cut_segments(t), counts[a:b]) for t, a, b in zip(texts, edges, edges[1:], strict=False)]
    for i, text in enumerate(texts):
        tree = trees[i]
        assert tree.total == len(coder.encode(text))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 6) // 2 * 2))
        edits = [(a, b, rng.choice(["", " ", "new", " two words ", "\n"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        expected, at = "", 0
        for a, b, new in edits:
            expected += text[at:a] + new
            at = b
        expected += text[at:]
        assert tree.edit(edits, coder) == expected
        assert tree.total == len(coder.encode(expected)), (text, edits)


def test_token_counts(odd_docs, no_docs):
    out = {r["doc_id"]: r for r in token_counts.counts_after_edits(clashing(odd_docs, "n_tokens")).collect()}
    assert out[3]["n_tokens"] == out[4]["n_tokens"] == 0 and len(out) == 15 and token_counts.counts_after_edits(no_docs).count() == 0


PAGES = "page_id long, url string, html string, text string"


def test_edits_reencode_what_they_touch(spark):
    """Texts with two spaces in a row have a tree as others do, and stored leaves stand for a new encoding."""
    words = " ".join(f"two  spaces {i}" for i in range(500))
    rows = spark.createDataFrame([(1, f"{words} then mail ab@example.org {words}"), (2, None), (3, "plain"), (4, "9" * 50_000 + " a@b.org" * 2000)], "doc_id long, text string")
    plain = {r["doc_id"]: r for r in token_counts.counts_after_edits(rows).collect()}
    assert plain[1]["n_segments"] > 2000 and plain[1]["n_reencoded"] <= 3 and plain[1]["n_edits"] == 1 and plain[2]["n_segments"] == 1
    stored = token_counts.segment_counts(clashing(rows, "segment_counts"))
    assert {r["doc_id"]: r for r in token_counts.counts_after_edits(stored, counts="segment_counts_").collect()} == plain
    numbers = " ".join(f"10.0.{i % 256}.{i % 100}" for i in range(30_000))
    assert len(token_counts.mask_edits(numbers)) == 30_000


def test_html(spark):
    menu = "<ul class='menu'><li>Home</li></ul>"
    notice = "This site was moved to a new place on the first of May last year, see there."
    pages = [
        (1, "http://h/a", f"<body>{menu}<article><h1>One &amp; two</h1><p>First<br>line <b>bold</b>\n text<p>Unclosed<div class='comments'>No</div></article><footer>F</footer>", "mine"),
        (2, "http://h/b", None, "mine"), (3, None, "", "mine"), (4, "odd", "plain &lt;text&gt; only &am", "mine"), (5, "http://h/c", "<main>Deep<script>x<p>y</p></script><!-- c <p> --> kept</main> out", "mine"),
        (6, "http://g/1", f"<div>{notice}</div><div>First body here.</div>", "mine"), (7, "http://g/2", f"<div>{notice}</div><div>Second body here.</div>", "mine"),
        (8, "http://h/d", "<nav>never closed <article><p>Text a < b</p><p hidden>no</p><aside>x</aside></article", "mine"), (8, "http://h/d", "<nav>never closed <article><p>Text a < b</p><p hidden>no</p><aside>x</aside></article", "mine"),
    ]
    df = spark.createDataFrame(pages, PAGES)
    out = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: "One & two\nFirst line bold text\nUnclosed", 2: "", 3: "", 4: "plain <text> only &am", 5: "Deep kept", 6: "First body here.", 7: "Second body here.", 8: "Text a < b"}
    assert html_extract.extract(df).count() == 9 and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p>Body.</p></article><article class='comment'><p>First!</p></article>", "Body."),
        ("<article><p>Body.</p><section class='user-comments'><article><p>First!</p></article></section><p>End.</p></article>", "Body.\nEnd."),
        ("<article>Body.</article><section id=user-comments><article><p>First!</p></article></section>", "Body."),
        ("<div class='ad'>Buy<article><p>Body.</p></article>", "Body."),
        ("<article><p class='share-price'>Price.</p><section id='related-work'><p>Work.</p></section><p class='notice-of-motion'>Motion.</p></article>", "Price.\nWork.\nMotion."),
        ("<article><p>Body.</p><div class='share-buttons'>Tweet</div><p class='cookie-notice'>Cookies</p><ul class='relatedPosts'><li>More</li></ul><div role='search'>Find</div></article>", "Body."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><form>Name <button>Send</button></form></article>", "Let x=1 be."),
        ("<main><header><h1>Title</h1></header><p>Body.</p><aside>Side</aside></main><footer>Foot</footer>", "Title\nBody."),
    ],
)
def test_what_belongs_to_an_article(html, text):
    assert "\n".join(t for kind, t in html_extract.blocks(html) if kind == html_extract.MAIN_TEXT) == text


def test_suffix_cover_against_grams():
    rng = random.Random(5)
    pages = [[(html_extract.OTHER_TEXT, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for _ in range(rng.randint(0, 3))] for _ in range(8)]
    grams = {}
    for i, page in enumerate(pages):
        for _, text in page:
            w = text.split(" ")
            for a in range(len(w) - 3):
                grams.setdefault(tuple(w[a : a + 4]), set()).add(i)
    for page, found in zip(pages, html_extract.covered(pages, 4), strict=True):
        for (_, text), cover in zip(page, found, strict=True):
            w = text.split(" ")
            expected = np.zeros(len(w), bool)
            for a in range(len(w) - 3):
                if len(grams[tuple(w[a : a + 4])]) > 1:
                    expected[a : a + 4] = True
            assert cover.tolist() == expected.tolist()


def test_quotes(spark):
    schema = "conv_id long, turn long, role string, text string, depth string"
    rows = [
        (1, 0, "u", "Hello there my friend\nHow are you doing today?", "mine"), (1, 1, "a", "> How are you doing today?\nI am fine thanks a lot", "mine"),
        (1, 2, "u", "On Monday, X wrote:\n>> How are you doing today?\n> I am  FINE thanks a lot\nGood to hear that", "mine"), (1, 3, "u", "> Hello there my friend\nbye", "mine"),
        (2, 0, "u", None, "mine"), (2, 1, "a", "> never said this before\nok", "mine"), (2, 1, "a", "> never said this before\nok", "mine"), (None, 0, "u", "> x", "mine"), (3, None, "u", "no turn here at all", "mine"),
    ]
    out = [tuple(r) for r in quotes.link_quotes(spark.createDataFrame(rows, schema)).collect()]
    assert len(out) == len(rows)
    got = {(r[0], r[1]): r[3:] for r in out}
    assert got[1, 1] == (0, 1, [0, 1], 1, 1, "I am fine thanks a lot")
    assert got[1, 2] == (1, 2, [0, 1, 2], 2, 2, "Good to hear that")
    assert got[1, 3][:2] == (0, 1) and got[2, 1] == (None, 0, [1], 1, 0, "ok") and got[2, 0][5] == ""
    assert quotes.link_quotes(spark.createDataFrame([], schema)).count() == 0
    deep = [(1, 0, "u", "message number 0 here", "m")] + [(1, i, "u", f"> message number {i - 1} here\nmessage number {i} here", "m") for i in range(1, 12)]
    assert {r["turn"]: r["depth"] for r in quotes.link_quotes(spark.createDataFrame(deep, schema)).collect()} == {i: i for i in range(12)}


def test_short_quotes(spark):
    texts = ["Sure.", "> Sure.\nWhy?", "> Why?\nYes, ok", "> Yes, ok\n好的", "> 好的\nSure.", "> sure.\nbye", "> bye\n> never said", ">\nSure.", "> Sure.\nend"]
    rows = [(1, i, "u", t) for i, t in enumerate(texts)] + [(2, 0, "u", "> Sure.\nSure.")]
    out = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[1, i]["reply_to"] for i in range(9)] == [None, 0, 1, 2, 3, 4, 5, None, 7] and out[2, 0]["reply_to"] is None
    assert out[1, 4]["depth"] == 4 and out[1, 7]["n_quotes"] == 0 and out[2, 0]["n_quotes"] == 1


def test_quoting_threads_against_brute_force(spark):
    """Generated conversations whose replies quote whole messages, lines, re-wrapped sentences or nothing; turns are large and negative numbers."""
    rng = random.Random(12)
    said, rows, expected = {}, [], {}
    for conv in range(12):
        turns = sorted(rng.sample(range(-(10**13), 10**13), 25))
        for k, turn in enumerate(turns):
            lines = [f"conv {conv} turn {k} line {i} says {rng.randint(0, 10**9)} and more words. Then {rng.randint(0, 10**9)} came after it." for i in range(rng.randint(1, 3))]
            up = rng.choice(turns[:k]) if k and rng.random() < 0.8 else None
            quote = []
            if up is not None:
                theirs, kind = said[conv, up], rng.randint(0, 3)
                if kind == 0:
                    quote = ["> " + x for x in theirs]
                elif kind == 1:
                    quote = [">" + theirs[-1].upper()]
                elif kind == 2:
                    words = " ".join(theirs).split()
                    quote = ["> " + " ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
                else:  # the later half of a line, wrapped anew, and a quote of a quote
                    words = re.split(r"(?<=[.]) ", theirs[0])[1].split()
                    quote = [">> said before", "> " + " ".join(words[:3]), "> " + " ".join(words[3:])]
            said[conv, turn] = lines
            expected[conv, turn] = up
            rows.append((conv, turn, "u", "\n".join([*quote, *lines])))
    rng.shuffle(rows)
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == expected
    assert all(r["text"] == "\n".join(said[k]) for k, r in got.items())

    def path(k):
        return [*(path((k[0], expected[k])) if expected[k] is not None else []), k[1]]

    assert all(r["reply_path"] == path(k) and r["depth"] == len(path(k)) - 1 for k, r in got.items())
    built = defaultdict(list)
    for r in sorted(quotes.threads(out, 4).collect(), key=lambda r: (r["conv_id"], r["thread"], r["part"])):
        assert len(r["messages"]) <= 4
        built[r["conv_id"], r["thread"]] += [m["turn"] for m in r["messages"]]
    whole = defaultdict(list)
    for k in sorted(expected, key=lambda k: (k[0], path(k))):
        whole[k[0], path(k)[0]].append(k[1])
    assert built == whole


def test_a_line_that_all_quote(spark):
    """2,000 turns quote and say one line: each replies to the turn before, without pairs."""
    rows = [(1, i, "u", ("> Same line.\n" if i else "") + "Same line.") for i in range(2000)]
    links = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("turn", "reply_to").collect()
    assert all(r["reply_to"] == (r["turn"] - 1 if r["turn"] else None) for r in links)


def test_pages_of_a_large_host_against_a_suffix_array(spark):
    rng = random.Random(12)
    word = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    notices = [word(rng.randint(7, 14)) for _ in range(30)]
    parts = [[word(rng.randint(1, 12)) for _ in range(rng.randint(0, 4))] for _ in range(700)]
    for i, notice in enumerate(notices):
        for p in rng.sample(range(700), 2 if i else 1):
            parts[p].insert(rng.randint(0, len(parts[p])), word(2) + " " + notice + " " + word(1))
    html = ["".join(f"<{'nav' if (i + j) % 9 == 0 else 'p'}>{t}</{'nav' if (i + j) % 9 == 0 else 'p'}>" for j, t in enumerate(p)) for i, p in enumerate(parts)]
    html += ["<article>" + notices[0] + "</article>", "<p>" + notices[1] + "</p>"]
    rows = [(i, "http://big/" + str(i), h, "") for i, h in enumerate(html)] + [(900, "http://small/", f"<p>{notices[2]}</p>", ""), (901, "http://small/x", "<p>" + "a b c d e f g h i " * 2 + "</p>", ""), (901, "http://small/x", "<p>" + "a b c d e f g h i " * 2 + "</p>", "")]
    pages = [html_extract.blocks(h) for h in html]
    expected, cut_pages = {}, 0
    for i, (page, cover) in enumerate(zip(pages, html_extract.covered(pages), strict=True)):
        main = any(k == html_extract.MAIN_TEXT for k, _ in page)
        texts = [t if main else " ".join(w for w, g in zip(t.split(" "), c.tolist(), strict=True) if not g) for (k, t), c in zip(page, cover, strict=True) if k == (html_extract.MAIN_TEXT if main else html_extract.OTHER_TEXT)]
        expected[i] = "\n".join(t for t in texts if t)
        cut_pages += any(c.any() for c in cover)
    expected |= {900: notices[2], 901: ("a b c d e f g h i " * 2).strip()}
    out = html_extract.extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect()
    assert len(out) == len(rows) and cut_pages > 30 and {r["page_id"]: r["text"] for r in out} == expected


def test_suffix_array_of_pieces_by_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        pieces = [" ".join([str(rng.randint(1, 2)), *(rng.choice("ab") for _ in range(rng.randint(0, 12)))]) for _ in range(rng.randint(1, 9))]
        least = np.array([rng.randint(0, 3) for _ in pieces])
        most = least + np.array([rng.choice((0, 0, 1)) for _ in pieces])
        pages = {}
        for p, a, b in zip(pieces, least.tolist(), most.tolist(), strict=True):
            site, *words = p.split(" ")
            for i in range(len(words) - 2):
                pages.setdefault((site, *words[i : i + 3]), set()).update((a, b))
        expected = [[i for i in range(len(w) - 2) if len(pages[(site, *w[i : i + 3])]) > 1] for site, *w in (p.split(" ") for p in pieces)]
        assert html_extract.repeated(pieces, least, most, 3) == expected


def test_equal_hashes_do_not_make_strings_equal():
    texts = [f"7 {'x ' * 7}{w}" for w in "abc"] + ["8 " + "x " * 7 + "a"]
    found = html_extract.index_pieces(pa.table({"lowest": [5] * 4, "piece": texts, "least": [1, 2, 3, 4], "most": [1, 2, 9, 4], "asks": [1] * 4}))
    assert found.to_pylist() == [{"piece": texts[2], "asks": 1, "hits": [0]}]


def test_training_sample_skips_what_does_not_fit(spark):
    rows = [(i, f"text number {i} " * 4, "en") for i in range(40)] + [(100 + i, "long words " * 300, "en") for i in range(10)] + [(200, "only one " * 900, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.training_sample(docs, 300, 3000)
    assert len(out["en"]) == 40 and sum(map(len, out["en"])) <= 3000 and len(out["fr"]) == 1
    assert {t.decode() for t in out["en"]} == {r[1] for r in rows[:40]}
    assert {k: len(v) for k, v in language_id.training_sample(docs).items()} == {"en": 50, "fr": 1}


def test_pipeline_stages_on_odd_tables(spark, odd_docs, no_docs):
    """Every stage takes an empty table and one with nulls, repeated rows and more columns, and keeps the columns of documents."""
    import corpus_pipeline

    for docs in (no_docs, odd_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            n = out.count()
            assert n == 0 if docs is no_docs else n > 0, name


def test_media_and_packing_ignore_other_columns(spark, odd_docs):
    names = ("media", "n_bytes", "path", "size", "members", "piece", "start", "length", "turn", "group", "sequence_id", "ids")
    plain, clashed = ([tuple(r) for r in packing.packed_digests(d).select("doc_id", "piece", "start", "length", "ids_crc32").collect()] for d in (odd_docs, clashing(odd_docs, *names)))
    assert sorted(map(str, plain)) == sorted(map(str, clashed))
    assert media.read_media(spark, media.write_media(clashing(odd_docs, *names))).count() == odd_docs.count()


def test_very_long_texts(spark):
    """One text of some megabytes beside short ones, through the operators on texts."""
    long = " ".join(f"w{i % 5003} don't  x{i % 17}" for i in range(200_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "short text", "en", "b"), (4, long, "en", "b")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(df).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r["size"] for r in mixing.mix(df).where("doc_id = 1").collect()} == {600_000}
    assert {r["doc_id"] for r in language_id.predict(df.select("doc_id", "text"), language_id.Ppm({"en": [b"the cat"], "fr": [b"le chat"]})).collect()} == {1, 2, 3, 4}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.counts_after_edits(df).collect()}
    packed = {r["doc_id"]: r["n"] for r in packing.packed_digests(df).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == {k: n + 1 for k, n in counts.items()}
