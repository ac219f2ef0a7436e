from __future__ import annotations

import time
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispark.llm import curve_packing, token_store
from lexispark.llm.tokens import PieceEncoder, encoder
from tests.llm.conftest import ODD, documents


def ids_of(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n,.'!abcÉéßİΣ0½×·<|>")), max_size=40))
def test_pieces_equal_the_library(text):
    import public_tokenizers

    e = encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.encode(text.encode()) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.dtype).tobytes()


def test_generations_keep_the_result(tokenizer):
    small = PieceEncoder(tokenizer, limit=3)
    text = "alpha beta gamma delta, alpha beta epsilon. alpha zeta beta" * 3
    assert small.encode(text.encode()) == encoder(tokenizer).encode(text.encode()) and len(small) <= 4


@lru_cache
def _small(path):
    return PieceEncoder(path, limit=3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t,.'!abcÉéßİΣȺ0½×·<|>")), max_size=40)), max_size=6), st.sampled_from([1, 7, 1000]))
def test_many_texts_equal_single_ones(texts, block):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    e, small = encoder(path), _small(path)
    texts = [x if x is None else x.encode() for x in [*texts, "a<|endoftext|>b it's", " ", "two words, 12 and marks!?"]]
    want = [e.encode(x) for x in texts]
    assert e.encode_all(texts, block) == want == small.encode_all(texts, block) and len(small.known) <= 6
    assert small.encode_all(texts[::-1], block) == want[::-1]


def test_bytes_that_are_no_text(tokenizer):
    odd = [b"\xff\xfe a b", b"a \xc3 \xa9 b", b"\xc3", b"", b"\x1c\x1d a\x85b"]
    e = encoder(tokenizer)
    assert e.encode_all(odd) == [e.encode(x) for x in odd] == e.encode_all(odd, 1)


def test_many_texts_cost_less(tokenizer):
    """Unknown pieces are encoded once, and known ones aren't looked up one by one."""
    r = np.random.default_rng(1)
    words = ["".join(map(chr, r.integers(97, 123, 8))) for _ in range(20_000)]
    texts = [", ".join(words[k] for k in r.integers(0, len(words), 500)).encode() for _ in range(1000)]
    single, all_at_once = PieceEncoder(tokenizer), PieceEncoder(tokenizer)
    calls = []
    all_at_once.unknown = lambda piece: calls.append(piece) or PieceEncoder.unknown(all_at_once, piece)
    assert all_at_once.encode_all(texts) == [single.encode(x) for x in texts]
    assert len(calls) == len(set(calls)) == len(all_at_once.known) == len(single)

    def cpu(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    assert min(cpu(lambda: all_at_once.encode_all(texts)) for _ in range(3)) < 0.7 * min(cpu(lambda: [single.encode(x) for x in texts]) for _ in range(3))


@pytest.mark.parametrize("how", [token_store.Chunking(), token_store.Chunking(bits=3, least=4, most=100)])
def test_cuts_of_many_streams(how):
    r = np.random.default_rng(2)
    streams = [r.integers(0, 1 << 16, n).astype(np.uint16) for n in (1, 3000, 40, 31, 2, 9000, 64, 65, 500)]
    streams += [streams[1], np.full(5000, 7, np.uint16), streams[1]]
    stops = np.cumsum([len(x) for x in streams]).tolist()
    got = token_store.all_cuts(np.concatenate(streams), stops, how)
    assert [[x - stop + len(ids) for x in ends] for ends, stop, ids in zip(got, stops, streams, strict=True)] == [token_store.cuts(x, how) for x in streams]


def test_store_round_trip(spark, tokenizer, tmp_path):
    rows = [*ODD, *((100 + k, f"shared passage of words number {k % 3} " * 200, "en") for k in range(9))]
    path = f"file://{tmp_path}/store"
    token_store.write(documents(spark, rows), path, tokenizer, end_id=1)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read(spark, path, tokenizer).collect())
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ids_of(tokenizer, r[1], 1).size)):
        ids = ids_of(tokenizer, text, 1)
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("place").distinct().count()


def test_store_notices_damage(spark, tokenizer, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(documents(spark, ODD), path, tokenizer, end_id=1)
    recipes = spark.read.parquet(f"{path}/recipes").where("doc_id is null or doc_id != 5")
    recipes.write.partitionBy("kind").parquet(f"{path}/less")
    (tmp_path / "store/recipes").rename(tmp_path / "store/old")
    (tmp_path / "store/less").rename(tmp_path / "store/recipes")
    with pytest.raises(Exception, match="root"):
        token_store.read(spark, path, tokenizer).collect()


def test_crc_shift():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.bytes(int(r.integers(0, 99))), r.bytes(int(r.integers(0, 9999)))
        moved = token_store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=3000))
def test_cuts(ids):
    how = token_store.Chunking(bits=4, least=8, most=64)
    ends = token_store.cuts(np.array(ids, np.uint16), how)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and (len(ids) == 0 or (sizes > 0).all()) and sizes.max(initial=0) <= how.most


def test_packing(spark, tokenizer):
    rows = [*ODD, *((200 + k, "same text again " * 40, "en") for k in range(40))]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    pieces = curve_packing.pack(documents(spark, rows), tokenizer, end_id=2, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text, _ in rows:
        parts = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in parts) == ids_of(tokenizer, text, 2).tobytes() and all(p.doc_tokens == sum(x.length for x in parts) for p in parts)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or at & (at - 1) == 0
    assert curve_packing.pack(documents(spark, []), tokenizer, end_id=2).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = curve_packing.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
