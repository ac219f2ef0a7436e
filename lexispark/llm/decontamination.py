"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items' words form one automaton (several, if the items
exceed ``words_per_automaton``: each is of bounded size and is sent to the
executors in turn; a long item is cut into pieces that overlap by a window less
a word, so that every window lies whole in one).  Every document's words stream
through it; the longest matching length at each word tells which item windows
end there.  Documents are never shuffled.

Defined results: a null or empty text has no words and is clean; an item
without words gives no window; an item shorter than the window is one window;
rows of one item_id are one item with the windows of all its texts; an item
with a null id hits words but isn't counted or listed among the items;
repeated rows each get the same answer; an empty benchmark leaves every
document clean; other columns play no part.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import WORD_PATTERN_BYTES, bounded_batches, forget, fresh, give_back, written

#: Lower-cases A-Z and turns every byte outside words into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c in WORD_PATTERN_BYTES else 32 for c in range(256))


#: Stands for a null item id, beside all ids of 64 bits.
UNNAMED = -(1 << 64)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """All substrings of the items' word sequences; states carry what may end in them."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends: list[set[int]] = [set()]
        shorts: list[tuple[int, list[int]]] = []
        for item, body in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in body]
            last = 0
            for s in symbols:
                last = self._extend(last, s, ends)
                ends[last].add(item)
            if symbols and len(symbols) < window:
                shorts.append((item, symbols))
        order = sorted(range(1, len(self.steps)), key=self.length.__getitem__, reverse=True)
        for v in order:  # the items in which a state's words occur
            if self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
        self.items: list[tuple[int, ...]] = [tuple(sorted(x)) if n >= window else () for x, n in zip(ends, self.length, strict=True)]
        # For each state, whole items shorter than the window that end with it: (length, items), its own and its suffixes'.
        own: dict[int, dict[int, list[int]]] = {}
        for item, symbols in shorts:
            v = 0
            for s in symbols:
                v = self.steps[v][s]
            own.setdefault(v, {}).setdefault(len(symbols), []).append(item)
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.steps)
        for v in reversed(order):
            self.short[v] = (*(self.short[self.link[v]] if self.link[v] > 0 else ()), *((n, tuple(x)) for n, x in own.get(v, {}).items()))

    def _extend(self, last: int, symbol: int, ends: list[set[int]]) -> int:
        def copied(p: int, q: int) -> int:
            """q, or a copy of it that stands for the strings up to p's length and one."""
            if self.length[p] + 1 == self.length[q]:
                return q
            self.steps.append(dict(self.steps[q]))
            self.link.append(self.link[q])
            self.length.append(self.length[p] + 1)
            ends.append(set())
            self.link[q] = clone = len(self.steps) - 1
            while p >= 0 and self.steps[p].get(symbol) == q:
                self.steps[p][symbol] = clone
                p = self.link[p]
            return clone

        if symbol in self.steps[last]:
            return copied(last, self.steps[last][symbol])
        new = len(self.steps)
        self.steps.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and symbol not in self.steps[p]:
            self.steps[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = copied(p, self.steps[p][symbol])
        return new

    def scan(self, body: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [start, end) that occurring windows cover, merged and ascending, and their items."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        steps, link, length, window, short = self.steps, self.link, self.length, self.window, self.short
        v = n = 0
        for at, s in enumerate(map(self.vocabulary.get, body)):
            if s is None:
                v = n = 0
                continue
            step = steps[v].get(s)
            if step is None:
                while step is None and v > 0:
                    v = link[v]
                    n = length[v]
                    step = steps[v].get(s)
                if step is None:
                    v = n = 0
                    continue
            v = step
            n += 1
            if n >= window:
                top = v
                while length[link[top]] >= window:
                    top = link[top]
                found.update(self.items[top])
                start = at + 1 - window
            elif short[v]:
                start = at + 1
            else:
                continue
            if short[v]:
                for size, items in short[v]:
                    if size <= n:
                        found.update(items)
                        start = min(start, at + 1 - size)
            if start <= at:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, found


@dataclass(frozen=True)
class Settings:
    window: int = 10
    words_per_automaton: int = 200_000


def pieces_of(body: list[bytes], window: int, most: int) -> Iterator[list[bytes]]:
    """The words in pieces of at most so many; every window of them lies whole in a piece, and only a short text gives a piece shorter than a window."""
    step = most - window + 1
    for at in range(0, max(1, len(body) - window + 1), step):
        yield body[at : at + most]


def automata(benchmark: DataFrame, settings: Settings, *, text: str = "text", key: str = "item_id") -> Iterator[SuffixAutomaton]:
    """One automaton for each share of the items' pieces of bounded size."""
    most = max(2 * settings.window, settings.words_per_automaton // 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, body in zip(batch.column("item"), batch.column("text").to_pylist(), strict=True):
                pieces = [b" ".join(x) for x in pieces_of(words(body), settings.window, most)]
                for at in range(0, len(pieces), 16):
                    some = pieces[at : at + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(some), pa.int64()), pa.array(some, pa.binary())], ["item", "text"])

    items = benchmark.select(F.col(key).cast("long").alias("item"), F.col(text).cast("binary").alias("text")).where("text is not null")
    items = written(items.mapInArrow(cut, "item long, text binary"), "benchmark-pieces")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # a word takes two bytes with its space at least
    shares = max(1, -(-size // (2 * settings.words_per_automaton)))
    for k in range(shares):
        some = items if shares == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shares)) == k)
        yield SuffixAutomaton([(UNNAMED if r.item is None else r.item, words(bytes(r.text))) for r in some.orderBy("item").toLocalIterator()], settings.window)


def sha_of_items(items: Iterable[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


FOUND = "n_words long, spans array<int>, items array<long>"


def nothing_found() -> Column:
    return F.lit(None).cast(f"struct<{FOUND.replace(' ', ':', 1).replace(', spans ', ',spans:').replace(', items ', ',items:')}>")


def merge(flat: list[int]) -> list[int]:
    """Spans (start, end, start, ...) in ascending order, touching ones made one."""
    out: list[int] = []
    for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def scan_with(shipped: Broadcast) -> Callable:
    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        look = shipped.value
        n, spans, items = [], [], []
        for body, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
            got = words(body)
            where, found = look.scan(got)
            n.append(len(got))
            flat = [x for span in where for x in span]
            spans.append(merge(old["spans"] + flat) if old else flat)
            items.append(sorted((found.union(old["items"]) if old else found) - {UNNAMED}))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], ["n_words", "spans", "items"])

    return scan


def clean_with(shipped: Broadcast, max_coverage: float) -> Callable:
    """Texts without the spans of the shipped automaton and those found before, and whether they stay."""

    @F.arrow_udf("text string, keep boolean")
    def cleaned(texts: pa.Array, before: pa.Array) -> pa.Array:
        look, bodies, keep = shipped.value, [], []
        for body, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
            got = words(body)
            spans, _ = look.scan(got)
            if old:
                flat = merge(old["spans"] + [x for span in spans for x in span])
                spans = list(zip(flat[::2], flat[1::2], strict=True))
            keep.append(sum(b - a for a, b in spans) <= max_coverage * len(got))
            bodies.append(cut_spans(body, spans).decode("utf-8", "replace") if body is not None and keep[-1] else None)
        give_back()
        return pa.StructArray.from_arrays([pa.array(bodies, pa.string()), pa.array(keep, pa.bool_())], ["text", "keep"])

    # Else Spark would look at every text twice, once to filter and once for what it returns.
    return cleaned.asNondeterministic()


def all_but_last(rows: DataFrame, benchmark: DataFrame, settings: Settings, found: str, body: Column) -> tuple[DataFrame, Broadcast]:
    """rows with what all automata but the last found, and the last automaton."""
    before = shipped = None
    for automaton in automata(benchmark, settings):
        if shipped is not None:
            rows = written(rows.withColumn(found, scan_with(shipped)(body, found)), "decontamination")
            shipped.unpersist()
            if before is not None:
                forget(before)
            before = rows
        shipped = rows.sparkSession.sparkContext.broadcast(automaton)  # of bounded size
    return rows, shipped


def findings(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, spans (start, end, start, ... of hit words, merged) and items of every row of docs.

    Each automaton after the first reads what the one before left in a written
    table, so that no executor holds two of them; there are at most two such tables
    at a time.
    """
    bounded_batches(docs)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), nothing_found().alias("found"))
    rows, shipped = all_but_last(rows, benchmark, settings, "found", F.col("text"))
    return rows.withColumn("found", scan_with(shipped)("text", "found")).select("doc_id", "found.*")


def judge(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The contract's row for each document: counts, items digest, contaminated."""

    @F.arrow_udf("string")
    def digest(items: pa.Array) -> pa.Array:
        return pa.array([sha_of_items(x) for x in items.to_pylist()], pa.string())

    hits = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    out = findings(docs, benchmark, settings).withColumn("n_hit", hits)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word spans and what stands between their words."""
    if not spans:
        return text
    plain = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : starts[start]])
        at = int(ends[end - 1])
    out.append(text[at:])
    return b" ".join(x.strip() for x in out if x.strip()) if len(out) > 1 else out[0]


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), *, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs without contaminated spans: spans that windows cover are cut out, and
    documents of which they cover more than max_coverage of the words are dropped.

    With several automata, all look at the texts as they came, one after another as
    in findings(); the last one's step cuts and judges by the spans of them all.
    """
    bounded_batches(docs)
    found, column = fresh(docs, "found", "clean_text")
    body = F.col(text).cast("binary")
    rows, shipped = all_but_last(docs.withColumn(found, nothing_found()), benchmark, settings, found, body)
    out = rows.withColumn(column, clean_with(shipped, max_coverage)(body, found)).where(F.col(f"{column}.keep"))
    return out.select(*(F.col(f"{column}.text").alias(c) if c == text else F.col(c) for c in docs.columns))
