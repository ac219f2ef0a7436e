"""SentencePiece encoding, fill-in-the-middle and ranked search: against the library, a plain reading and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import fill_in_middle, lexical_search, piece_encoding
from lexispark.llm.queries import QUERIES
from tests.llm.conftest import ODD, documents
from tests.llm.test_registered_queries import table

MORE = ["  a  b ", "▁x ▁▁", "\n\n\ty", "😀😀 é́ ﻿", "<0x41><s></s><unk>", "a" * 3000, " " * 500, "ab" * 900, "日本語テキスト" * 40, "ﬁ①", "<|x|>", "a b\r\n"]


@pytest.fixture(scope="module")
def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def test_pieces_equal_the_library(model_path, library):
    m, r = piece_encoding.PieceModel(model_path), random.Random(3)
    texts = MORE + ["".join(r.choice("abcdefgh thes▁ \n.é日😀") for _ in range(r.randint(0, 80))) for _ in range(3000)]
    for text in texts:
        want = library.encode(text, add_eos=True)
        got = m.encode(text)
        assert got.tolist() == want, text
        assert m.decode(got) == library.decode(want), text
    for _ in range(3000):  # ids that no text has, broken bytes too
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31_999)]) for _ in range(r.randint(0, 12))]
        assert m.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_backtracking_gives_up_pieces(model_path):
    """Words cut at no place, encoded as a whole and by the cuts, are the same; some need a shorter piece than the longest."""
    m, r = piece_encoding.PieceModel(model_path), random.Random(5)
    fell_back = 0
    for _ in range(2000):
        word = "▁" + "".join(r.choice("etaoinsrhl") for _ in range(r.randint(1, 14)))
        assert tuple(m.pieces(word)) == m.merged(word)
        fell_back += m.pieces(word)[0] != max((p for p in m.ids if word.startswith(p)), key=len) if _ < 40 else 0
    assert fell_back


def test_models_that_normalise_are_refused():
    import public_tokenizers

    with pytest.raises(Exception):  # noqa: B017  no model of this library
        piece_encoding.PieceModel(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_odd_rows(spark, model_path, library):
    rows = [*ODD, *((100 + k, t, "xx") for k, t in enumerate(MORE))]
    docs = documents(spark, rows).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1))
    out = piece_encoding.decoded(piece_encoding.encoded(docs, model_path), model_path)
    assert sorted(out.columns) == sorted(docs.columns)
    got = sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in out.collect())
    want = [(str(i), tuple(library.encode(t or "", add_eos=True)), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert got == sorted(want)
    both = piece_encoding.encoded(docs, model_path, decoded="decoded")
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in both.collect()) == got
    assert piece_encoding.encoded(documents(spark, []), model_path).count() == 0


def test_encoding_query(spark, data, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_piece_encoding"](spark, data).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = table(data, "documents", "doc_id", "text")
    assert len(docs) == len(got)
    for i, text in docs:
        ids = library.encode(text or "", add_eos=True)
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def plain_fim(key, text, pattern):
    text = text or ""
    u = re.findall(pattern, text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("classes", "pattern"), [(fill_in_middle.LETTERS, r"[A-Za-z]+|[^A-Za-z]"), (fill_in_middle.CHARACTERS, r"(?s)."), (("a-z", "0-9 "), r"[a-z]+|[0-9 ]+|[^a-z0-9 ]")])
def test_fill_in_middle(spark, classes, pattern):
    texts = [*MORE, "two words", "has <P> in it", "<M>", "ends in <", ">", "<P", "line\nline\r\n", "😀", "a😀b", "😀😀a", "ée"]
    rows = [*ODD, *((k, t, "xx") for k in range(1000, 1020) for t in texts)]
    docs = documents(spark, rows).withColumn("n", F.lit("mine")).withColumn("_units", F.lit(1))
    s = fill_in_middle.Settings(classes=classes)
    out = fill_in_middle.transform(docs, s)
    assert out.columns == [*(c for c in docs.columns if c != "n"), "n", "form", "prefix", "middle", "suffix", "output"]
    got = out.select("*", fill_in_middle.restored(F.col("output"), F.col("form"), s).alias("again")).collect()
    size = lambda x: None if x is None else len(x)
    assert sorted(map(str, ((r.doc_id, r.n, r.form, size(r.prefix), size(r.middle), r.output) for r in got))) == sorted(map(str, ((i, *plain_fim(i, t, pattern)) for i, t, _ in rows)))
    assert all(r.again == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(documents(spark, [])).count() == 0


def brute_rank(docs, items, top=20):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    bags = [(i, Counter(split(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b in bags:
            m = 100 - 25 + 25 * b.total() * n // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, q in terms.items() if b[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize("settings", [lexical_search.Settings(), lexical_search.Settings(documents=7, postings=60, terms_per_block=9, longest=3, price=0.2, top=4)])
def test_search(spark, settings):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "größe", "日本"]
    some = lambda n: " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(i, t) for i, t, _ in ODD] + [(k, some(r.randint(0, 40))) for k in range(200)] + [(k, "w0 w1 w2") for k in range(300, 330)] + [(None, "w0 w1 w2")] * 3
    items = [(k, some(r.randint(0, 12))) for k in range(12)] + [(3, "w0 w0 more"), (None, "w1 É"), (50, None), (51, "nothing! here?"), (52, "WORD one")]
    got = lexical_search.rank(documents(spark, [(i, t, None) for i, t in docs]).repartition(5), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)), settings)
    assert sorted(str(tuple(x)) for x in got.collect()) == brute_rank(docs, items, settings.top)
    empty = documents(spark, [])
    some_items = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.rank(empty, some_items, settings).count() == 0
    assert lexical_search.rank(documents(spark, ODD), some_items.limit(0), settings).count() == 0


def test_blocks_cost_least():
    """The blocks' cost is that of the best of all ways to cut the list, and runs under the bounds are passed over."""
    r = np.random.default_rng(1)
    sizes = [9, 1, 7, 0, 8]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    impacts = r.integers(1, 100, starts[-1])
    begins = lexical_search.blocks_of(impacts, starts, 4, 0.3)
    toll = 0.3 * impacts.max()

    def cost(values, cuts):
        edges = [0, *cuts, len(values)]
        parts = [values[a:b] for a, b in zip(edges, edges[1:])]
        return sum(len(p) * max(p) + toll for p in parts) if all(0 < len(p) <= 4 for p in parts) else math.inf

    for k, n in enumerate(sizes):
        values = impacts[starts[k] : starts[k + 1]].tolist()
        if not n:
            continue
        ways = [[j + 1 for j in range(n - 1) if m >> j & 1] for m in range(1 << (n - 1))]
        got = [j for j in range(1, n) if begins[starts[k] + j]]
        assert begins[starts[k]] and cost(values, got) == pytest.approx(min(cost(values, w) for w in ways))


def test_search_skips(spark):
    """With bounds, far fewer documents are scored than hold a term."""
    r = random.Random(9)
    docs = [" ".join(["common"] * 3 + [f"x{r.randint(0, 400)}" for _ in range(20)] + (["rare"] * 2 if k % 500 == 0 else [])) for k in range(4000)]
    numbers = {b"common": 0, b"rare": 1}
    built = lexical_search.segments(documents(spark, [(k, t, None) for k, t in enumerate(docs)]).coalesce(1), numbers, lexical_search.Settings())
    corpus = lexical_search.statistics(built)
    segment = lexical_search.Segment(built.first().asDict(), corpus, lexical_search.Settings())
    scored = []
    whole = segment._score
    segment._score = lambda lists, found, best, top: (scored.append(len(found)), whole(lists, found, best, top))
    best = []
    segment.search([(0, corpus.weight(0)), (1, corpus.weight(1))], best, 8)
    assert len(best) == 8 and sum(scored) < 1500
