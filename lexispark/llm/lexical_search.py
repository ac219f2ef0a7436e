"""Ranked lexical search over variable blocks of postings (block-max WAND).

1. Every task turns its own documents into segments of bounded size: postings of
   the terms that items ask for, document lengths, and counts.  Documents are
   never shuffled; a segment is one row of a written table.
2. The segments' counts, added up, give the corpus' statistics: documents, words,
   documents of each asked term.
3. Every task goes through its segments.  A term's postings are cut into blocks
   by dynamic programming, so that the blocks' greatest impacts exceed the
   postings' own by as little as possible, at a fixed price a block.  For an
   item, the places where a block of one of its terms begins or ends divide the
   segment into runs; a run's bound is the sum of the blocks' bounds in it (of a
   list with wide gaps, only where it has a posting: the pivot's test).  Runs
   are looked at from the highest bound on, and the documents in them are scored;
   the first run whose bound is under the least score of the item's best list
   ends the item's search in the segment.  The lists go on from segment to
   segment within a task.
4. The tasks' best of each item are ranked together.

Nothing is left out by it: a document that isn't scored has a bound under the
scores of as many documents as are asked for.

Items go in blocks of bounded size, one pass over the documents for each; what
is broadcast is a block's items and their terms' weights.

Defined results: null texts have no terms; an item without terms, or without a
document of a positive score, has no rows; repeated rows of documents are ranked
each; equal scores go by doc_id, a null one last; rows of one item_id are one
item with the terms of all its texts; a null item_id is an item, too; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, give_back, slices, written
from lexispark.llm.decontamination import words

SEGMENT = "doc_ids array<long>, lengths binary, terms binary, starts binary, places binary, counts binary, n_docs long, n_words long"

#: A list of fewer postings than a document in so many has wide gaps.
GAP = 8


@dataclass(frozen=True)
class Settings:
    top: int = 20
    #: Bounds of a segment, and of the terms of a block of items.
    documents: int = 8192
    postings: int = 2_000_000
    terms_per_block: int = 200_000
    #: Longest block of postings, and its price in parts of the greatest impact.
    longest: int = 64
    price: float = 1.5


def item_blocks(items: DataFrame, settings: Settings, *, text: str = "text", key: str = "item_id") -> Iterator[dict[int | None, Counter]]:
    """item -> how often it has each term, in blocks of so many terms at most (but for an item that alone has more)."""
    block: dict[int | None, Counter] = {}
    size = 0
    last = object()
    rows = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("text")).where("text is not null").orderBy("item")
    for r in rows.toLocalIterator():
        got = Counter(words(bytes(r.text)))
        if not got:
            continue
        if size and size + len(got) > settings.terms_per_block and r.item != last:
            yield block
            block, size = {}, 0
        block.setdefault(r.item, Counter()).update(got)
        size += len(got)
        last = r.item
    if block:
        yield block


def segments(docs: DataFrame, vocabulary: Mapping[bytes, int], settings: Settings, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """SEGMENT rows: for each asked term, in order, the places of documents that hold it and how often they do."""
    shipped = docs.sparkSession.sparkContext.broadcast(dict(vocabulary))  # of bounded size

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value.get
        ids: list[int | None] = []
        lengths, terms, places, counts = array("q"), array("i"), array("i"), array("q")

        def closed() -> pa.RecordBatch:
            nonlocal ids, lengths, terms, places, counts
            t, p, c = (np.frombuffer(x, k) for x, k in ((terms, np.int32), (places, np.int32), (counts, np.int64)))
            order = np.argsort(t, kind="stable")  # places are ascending already
            found, starts = np.unique(t[order], return_index=True)
            n = np.frombuffer(lengths, np.int64)
            blobs = [x.tobytes() for x in (n, found.astype(np.int32), np.append(starts, len(t)).astype(np.int64), p[order], c[order])]
            row = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
            ids, lengths, terms, places, counts = [], array("q"), array("i"), array("i"), array("q")
            return pa.RecordBatch.from_arrays(row, ["doc_ids", "lengths", "terms", "starts", "places", "counts", "n_docs", "n_words"])

        for batch in slices(batches):
            for doc, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = words(body)
                tf = Counter(map(known, got))
                tf.pop(None, None)
                terms.extend(tf.keys())
                counts.extend(tf.values())
                places.extend([len(ids)] * len(tf))
                ids.append(doc)
                lengths.append(len(got))
                if len(ids) >= settings.documents or len(terms) >= settings.postings:
                    yield closed()
        if ids:
            yield closed()
        give_back()

    bounded_batches(docs)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(index, SEGMENT)


@dataclass(frozen=True)
class Statistics:
    documents: int
    words: int
    holding: Mapping[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding.get(term, 0) + 1)))

    def measure(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * lengths * self.documents) // max(1, self.words)


def statistics(built: DataFrame) -> Statistics:
    """Added up over all segments: a row each for the corpus, and one a term of a block."""
    n = built.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(starts, np.int64)))], ["term", "n"])

    counted = built.select("terms", "starts").mapInArrow(held, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return Statistics(n.docs, n.words, {r.term: r.n for r in counted.collect()})  # terms of one block of items


def blocks_of(impacts: np.ndarray, starts: np.ndarray, longest: int, price: float) -> np.ndarray:
    """Whether a block begins at each posting, for all lists at once.

    cost(i) is the least, over the last block's length, of cost before it, and
    its length times its greatest impact, and the price.  (What the postings
    themselves add up to is the same whatever the blocks.)  Lists go in step,
    from their ends on, the longest first.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begins = np.zeros(len(impacts), bool)
    begins[starts[:-1][sizes > 0]] = True
    toll = price * (float(impacts.max()) if len(impacts) else 0.0)
    lengths = np.arange(1, longest + 1, dtype=np.float64)
    count = len(sizes)
    # Row k of the windows: the last ``longest`` impacts and costs of list order[k], the newest first.
    recent, costs = np.zeros((count, longest)), np.full((count, longest), np.inf)
    costs[:, 0] = 0.0
    taken = [np.zeros(0, np.int32)] * int(sizes.max() if count else 0)
    for step in range(len(taken)):
        active = int(np.searchsorted(-sizes[order], -step, side="left"))
        rows = order[:active]
        recent[:active, 1:] = recent[:active, :-1].copy()
        recent[:active, 0] = impacts[starts[rows] + step]
        total = costs[:active] + lengths * np.maximum.accumulate(recent[:active], axis=1) + toll
        best = total.argmin(axis=1)
        taken[step] = (best + 1).astype(np.int32)
        costs[:active, 1:] = costs[:active, :-1].copy()
        costs[:active, 0] = total[np.arange(active), best]
    for k, row in enumerate(order.tolist()):
        at = int(sizes[row])
        while at > 0:
            at -= int(taken[at - 1][k])
            begins[starts[row] + at] = True
    return begins


class Segment:
    """A segment's postings with their impacts, in blocks."""

    def __init__(self, row: Mapping, corpus: Statistics, settings: Settings):
        self.ids = row["doc_ids"]
        self.size = len(self.ids)
        lengths, self.starts, counts = (np.frombuffer(row[c], np.int64) for c in ("lengths", "starts", "counts"))
        terms, self.places = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["places"], np.int32)
        self.at = dict(zip(terms.tolist(), range(len(terms)), strict=True))
        measures = corpus.measure(lengths)
        self.impacts = (1_000_000_000 * counts) // (1000 * counts + 12 * measures[self.places])
        begins = np.flatnonzero(blocks_of(self.impacts, self.starts, settings.longest, settings.price))
        #: First posting of each block, and behind the last; a list's blocks follow each other.
        self.block_starts = np.append(begins, len(self.impacts))
        self.bounds = np.maximum.reduceat(self.impacts, begins) if len(begins) else np.zeros(0, np.int64)
        self.list_blocks = np.searchsorted(begins, self.starts)

    def search(self, asked: list[tuple[int, int]], best: list, top: int) -> None:
        """Put the segment's documents that belong to an item's best into its heap.

        asked: (term, weight with repeats).  The heap holds (score, order of the
        id, id), the least first.
        """
        lists = [(self.at[t], w) for t, w in asked if w > 0 and t in self.at]
        if not lists:
            return
        # A block's bound counts from its first to its last posting; where a list has wide gaps, at its postings alone.
        steps = np.zeros(self.size + 1, np.int64)
        for k, w in lists:
            a, b = self.list_blocks[k], self.list_blocks[k + 1]
            first, last = self.block_starts[a:b], self.block_starts[a + 1 : b + 1] - 1
            bounds = self.bounds[a:b] * w
            if GAP * (self.starts[k + 1] - self.starts[k]) < self.size:
                bounds = np.repeat(bounds, last - first + 1)
                first = last = np.arange(self.starts[k], self.starts[k + 1])
            np.add.at(steps, self.places[first], bounds)
            np.subtract.at(steps, self.places[last] + 1, bounds)
        edges = np.flatnonzero(steps[:-1])
        if not len(edges):
            return
        runs = np.cumsum(steps[edges])
        sizes = np.diff(np.append(edges, self.size))
        order = np.argsort(-runs, kind="stable")
        at = 0
        while at < len(order):
            least = best[0][0] if len(best) == top else 1
            if runs[order[at]] < least:
                return
            # As many runs as hold some hundred documents go together.
            upto = at + 1 + int(np.searchsorted(np.cumsum(sizes[order[at + 1 :]]), 256))
            some = order[at:upto]
            some = some[runs[some] >= least]
            live = np.zeros(self.size, bool)
            for a, n in zip(edges[some].tolist(), sizes[some].tolist(), strict=True):
                live[a : a + n] = True
            self._score(lists, np.flatnonzero(live), best, top)
            at = upto

    def _score(self, lists: list[tuple[int, int]], docs: np.ndarray, best: list, top: int) -> None:
        scores = np.zeros(len(docs), np.int64)
        for k, w in lists:
            a, b = self.starts[k], self.starts[k + 1]
            places = self.places[a:b]
            where = np.searchsorted(places, docs)
            where[where == b - a] = 0
            met = places[where] == docs
            scores[met] += w * self.impacts[a:b][where[met]]
        least = max(1, best[0][0]) if len(best) == top else 1
        for k in np.flatnonzero(scores >= least).tolist():
            doc = self.ids[docs[k]]
            entry = (int(scores[k]), *((0, 0) if doc is None else (1, -doc)))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def best_of(built: DataFrame, asked: Mapping[int | None, list[tuple[int, int]]], corpus: Statistics, settings: Settings) -> DataFrame:
    """(item_id, doc_id, score): for each task, its segments' best documents of each item of a block."""
    shipped = built.sparkSession.sparkContext.broadcast((list(asked.items()), corpus))  # of bounded size

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, totals = shipped.value
        heaps: list[list] = [[] for _ in items]
        for batch in slices(batches, 1):
            segment = Segment(batch.to_pylist()[0], totals, settings)
            for heap, (_, terms) in zip(heaps, items, strict=True):
                segment.search(terms, heap, settings.top)
        rows = [(item, None if not known else -negated, score) for heap, (item, _) in zip(heaps, items, strict=True) for score, known, negated in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], ["item_id", "doc_id", "score"])

    return built.drop("n_docs", "n_words").mapInArrow(search, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    found: DataFrame | None = None
    for block in item_blocks(items, settings):
        numbers: dict[bytes, int] = {}
        numbered = {item: [(numbers.setdefault(t, len(numbers)), n) for t, n in sorted(terms.items())] for item, terms in block.items()}
        built = written(segments(docs, numbers, settings), "segments")
        corpus = statistics(built)
        asked = {item: [(t, n * corpus.weight(t)) for t, n in terms] for item, terms in numbered.items()}
        got = best_of(built, asked, corpus, settings)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= settings.top).select("item_id", "rank", "doc_id", "score")

