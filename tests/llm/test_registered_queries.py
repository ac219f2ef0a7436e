"""Every registered query over whole tables: against its SQL, or against a plain version on one machine."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from lexispark.llm import secret_scan
from lexispark.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows


def table(data, name, *columns):
    import pyarrow.parquet as pq

    return [tuple(r.values()) for r in pq.read_table(Path(data) / f"{name}.parquet", columns=list(columns)).to_pylist()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    out = QUERIES[name](spark, data)
    ran = con.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(out.columns) == sorted(names)
    assert rows(out.columns, out.collect()) == rows(names, ran.fetchall())


def test_language_id(spark, data):
    out = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, data).collect()}
    docs = table(data, "documents", "doc_id", "text", "lang")
    assert out.keys() == {i for i, *_ in docs} and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in docs)
    held = [(out[i].lang_pred, lang) for i, text, lang in docs if out[i].held_out and lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(out[i].lang_pred == "und" for i, text, _ in docs if not any(map(str.isalpha, text or "")))


def plain_article(page):
    """What stands in the article element of the generated pages, block by block."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", re.sub(r"<br>", " ", m[1])) if m else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_html_extraction(spark, data):
    out = {r.page_id: r for r in QUERIES["op2_html_extraction"](spark, data).collect()}
    pages = table(data, "pages", "page_id", "url", "html")
    assert len(out) == len(pages)
    for i, url, page in pages:
        assert out[i].url == url and out[i].n_chars == len(out[i].text)
        assert out[i].text == plain_article(page)


def test_quality_classifier_held_out(spark):
    data = "/root/testdata/sf0.01"
    if not Path(data).exists():
        pytest.skip("no test data here")
    out = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, data).collect()}
    docs = table(data, "documents", "doc_id")
    assert out.keys() == {i for (i,) in docs} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    held = [(y, out[i]) for i, y in table(data, "labels", "doc_id", "quality") if y is not None and i in out and out[i].held_out]
    good, bad = ([r.score for y, r in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9  # the area under the curve
    assert np.mean([r.predicted for y, r in held if y == 1]) > 0.9


@pytest.fixture(scope="module")
def encoded(data):
    """doc_id -> its ids by the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: library.encode(text or "", add_special_tokens=False).ids for i, text in table(data, "documents", "doc_id", "text")}


def test_curve_packing(spark, data, encoded):
    by_doc, filled = defaultdict(list), defaultdict(list)
    for p in QUERIES["op5_curve_packing"](spark, data).collect():
        by_doc[p.doc_id].append(p)
        filled[p.sequence_id].append(p)
    assert by_doc.keys() == encoded.keys()
    for i, pieces in by_doc.items():
        ids, at = np.array([*encoded[i], 2], "<u4"), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in filled.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert at <= 4096
    assert padding <= 0.01 * sum(len(x) + 1 for x in encoded.values())


def test_token_store(spark, data, encoded):
    got, start = sorted(map(tuple, QUERIES["op9_token_store"](spark, data).collect())), 0
    assert len(got) == len(encoded)
    for doc_id, begin, n, crc in got:
        ids = np.array([*encoded[doc_id], 1], "<u4")
        assert (begin, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n


def test_secret_scan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    forest = secret_scan.train(words=secret_scan.frequent_words(docs))
    got = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, data).collect()}
    assert len(got) == docs.count()
    for doc_id, text in table(data, "documents", "doc_id", "text"):
        found = secret_scan.judged(text or "", forest)
        clean = secret_scan.redact(text or "", [c for c, p in found if p >= 0.5])
        assert (got[doc_id].n_candidates, got[doc_id].clean_sha256) == (len(found), hashlib.sha256(clean.encode()).hexdigest())


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {i: t for i, t in table(data, "documents", "doc_id", "text")}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, data)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes, name
        kept.append({r.doc_id: r for r in docs.collect()})
        assert all(r.n_chars == len(r.text) for r in kept[-1].values() if r.text is not None)
    assert all({*b} <= {*a} for a, b in zip(kept, kept[1:]))
    want = {r.doc_id for r in QUERIES["op3_quality_classifier"](spark, data).collect() if r.predicted}
    assert {*kept[0]} == want and all(r.text == texts[i] for i, r in kept[0].items())
    # Near copies by five words: what stays isn't similar to anything else that stays, and what goes is.
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(max(1, len(w) - 4)) if w}
    sets = {i: shingles(r.text) for i, r in kept[0].items()}
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    stay = [i for i in kept[1] if sets[i]]
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(stay) for b in stay[:k])
    for i in {*kept[0]} - {*kept[1]}:
        assert any(near(sets[i], sets[j]) for j in kept[0] if j != i)
    hits = {r.doc_id: r.n_hit for r in QUERIES["op7_decontamination"](spark, data).collect()}
    for i, r in kept[2].items():
        assert hits[i] or r.text == kept[1][i].text
    packed = {r.doc_id for r in corpus_pipeline.run(spark, data).collect()}
    assert packed == {*kept[3]} == {*kept[2]}
