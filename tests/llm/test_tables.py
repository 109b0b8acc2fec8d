"""Operators with SQL against DuckDB, and the others against brute force, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

from helpers import rows
from sonargrid.llm import language_id, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, tables, name):
    folder, con = tables
    assert rows(registry.QUERIES[name](spark, folder)) == rows(con.execute(registry.ORACLES[name]).df())


@pytest.fixture(scope="module")
def docs(tables):
    return tables[1].execute("SELECT doc_id, text, lang FROM documents ORDER BY 1").fetchall()


def result(spark, tables, name):
    return registry.QUERIES[name](spark, tables[0]).toPandas()


def test_media_round_trip(spark, tables, docs):
    out = result(spark, tables, "op3_media_columns").set_index("doc_id")
    assert len(out) == len(docs)
    for i, text, _ in docs:
        data = (text or "").encode()
        payload = data + bytes(64 * max(1, -(-len(data) // 64)) - len(data))
        r = out.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def near_components(ids, texts):
    sets, at, parent = [shingles(t) for t in texts], defaultdict(list), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in at[x])
        for x in s:
            at[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[i]), ids[root(i)]) for i, d in enumerate(ids)}


def test_near_duplicates(spark, tables, docs):
    expected = near_components([d[0] for d in docs], [d[1] for d in docs])
    out = result(spark, tables, "op5_ngram_jaccard")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == expected


def test_language_held_out(spark, tables, docs):
    out = result(spark, tables, "op6_language_id").set_index("doc_id")
    assert len(out) == len(docs) and all(out.loc[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in docs)
    right = [out.loc[i].lang_pred == lang for i, _, lang in docs if out.loc[i].held_out]
    assert np.mean(right) > 0.97 and out.score.between(0, 1).all()


def test_passages(spark, tables, docs):
    out, seen = result(spark, tables, "op8_suffix_dedup").set_index("doc_id"), set()
    for i, text, _ in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 99):
            if (w := data[a : a + 100]) in seen:
                gone[a : a + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()
        assert tuple(out.loc[i]) == (len(data), int(gone.sum()), runs, kept)


def test_packing(spark, tables, docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    out = result(spark, tables, "op9_best_fit_packing")
    pieces = {(r.doc_id, r.piece): r for r in out.itertuples()}
    count = 0
    for i, text, _ in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = -(-len(ids) // 1024)
        head = len(ids) - 1024 * (n - 1)
        for p in range(n):
            start, length = (0, head) if p == 0 else (head + (p - 1) * 1024, 1024)
            r = pieces[i, p]
            assert (r.start, r.length, r.ids_crc32) == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
            count += 1
    assert count == len(out)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) * 1.03 + 1


def test_pages(spark, tables):
    out = result(spark, tables, "op10_html_extract").set_index("page_id")
    for i, html in tables[1].execute("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", re.sub(r"<[a-z/][^>]*\Z", "", article))]
        assert out.loc[i].text == "\n".join(p for p in parts if p)


def test_token_counts(spark, tables, docs):
    from sonargrid.llm.bpe import Bpe, load_ranks
    from sonargrid.llm.token_counts import counts_after_edits

    bpe = Bpe(*load_ranks())
    out = counts_after_edits(spark.read.parquet(f"{tables[0]}/documents.parquet")).toPandas().set_index("doc_id")
    for i, text, _ in docs:
        r = out.loc[i]
        assert (r.n_tokens, r.n_tokens_after) == (len(bpe.encode(text or "")), len(bpe.encode(r.text_after)))
    assert (out.n_edits > 0).any()


def test_quotes_run(spark, tables):
    out = result(spark, tables, "op2_quote_linking")
    assert len(out) == tables[1].execute("SELECT count(*) FROM conversations").fetchone()[0]


def test_pipeline(spark, tables, docs):
    import corpus_pipeline

    langs = language_id.learn(spark.read.parquet(f"{tables[0]}/documents.parquet")).langs
    assert langs == ["de", "en", "es", "fr"]
    steps, df = [], spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, tables[0]).cache()
        steps.append([r.doc_id for r in df.select("doc_id").collect()])
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {i: t for i, t, _ in docs}
    assert set(steps[0]) == {i for i, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    groups = defaultdict(list)
    for i in steps[0]:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text[i])].append(i)
    assert set(steps[1]) == {max(g) for g in groups.values()}
    ids = sorted(steps[1])
    assert set(steps[2]) == {i for i, (_, c) in near_components(ids, [text[i] for i in ids]).items() if c == i}
    assert set(steps[3]) <= set(steps[2]) and max(Counter(steps[3]).values()) <= 3
    packed = corpus_pipeline.run(spark, tables[0]).toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == Counter(steps[3])
