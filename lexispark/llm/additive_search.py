"""Approximate nearest neighbours by additive quantisation.

A vector is stored as the sum of one full-dimensional codeword from each of
several codebooks.  Codebooks are fitted on residuals, stage by stage, over a
bounded sample; every vector is encoded by a beam search over them and keeps
its codes, the norm of their sum and the norm of what they leave.

Coded vectors lie in runs along the order of their codes, so a run's vectors
share their first codewords where the data have clusters.  Neighbouring runs
make a block of bounded bytes, and queries are packed in groups.  One job lets
every group meet every block: a task holds a block and the groups stream past,
so vectors are read once and queries once a block, however many there are of
either.  A run whose ball (centre and radius of the codes' sums, and the largest
residual norm) can't reach a query's bar is passed over; else lookup tables give
the codes' scores, and vectors whose score and residual norm together can reach
the bar are reranked with exact inner products.  A query's bar rises by the best
few that a block holds.

Bars come from a first pass over a part of the vectors (about the square root
of their number, in units of a task's share): the k-th nearest of any part is
a lower bound.  The second pass goes over all vectors, so that the result is
exact however many of them lie close together.  Vectors are shuffled once;
what a pass puts out is a few rows a query and task, not the codes.

Equal vectors are indexed once, under the digest of their values, so a vector
that a third of all rows share takes one place among the candidates; its rows
with the smallest ids come back in at the end.

Defined results: vectors that are null, zero, hold a null or non-finite
component or aren't of the table's most common dimension take no part, nor do
rows with a null id; rows repeated with id and vector count once; ties go to
the smaller id; fewer candidates than asked for are all returned; an empty
table gives an empty result; other columns play no part.  A score is the sum of
the products of components in their order, in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, forget, written


@dataclass(frozen=True)
class Settings:
    codebooks: int = 32
    codewords: int = 128
    sample_rows: int = 8000
    beam: int = 4
    rounds: int = 6
    #: Queries that go to a block together, queries and vectors that are scored at a time.
    query_group: int = 2048
    query_block: int = 256
    run: int = 1024
    #: Bytes of the coded vectors that a task holds.
    block_bytes: int = 64 << 20
    #: The first pass looks at the square root of this times half the number of vectors.
    share: int = 16_384


@dataclass(frozen=True)
class Quantiser:
    """books: (codebooks, codewords, dimension)."""

    books: np.ndarray
    beam: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows of x: at every codebook the beam's best sums so far go on."""
        n, d = x.shape
        out = np.zeros((n, len(self.books)), np.uint8)
        for at in range(0, n, 512):
            part = x[at : at + 512].astype(np.float32)
            m = len(part)
            rest, codes, cost = part[:, None, :], np.zeros((m, 1, 0), np.uint8), (part**2).sum(axis=1)[:, None]
            for book in self.books:
                book = book.astype(np.float32)
                # |rest - c|^2 for every sum in the beam and every codeword
                grown = cost[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(m, rest.shape[1], -1) + (book**2).sum(axis=1)
                flat = grown.reshape(m, -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                came, code, row = best // len(book), best % len(book), np.arange(m)[:, None]
                rest = rest[row, came] - book[code]
                codes = np.concatenate((codes[row, came], code[:, :, None].astype(np.uint8)), axis=2)
                cost = flat[row, best]
            out[at : at + m] = codes[np.arange(m), cost.argmin(axis=1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, k]] for k, book in enumerate(self.books))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(codebooks, codewords, queries) inner products, in single precision where that can hold them."""
        out = self.books @ queries.T
        return out.astype(np.float32) if 1e-20 < np.abs(out).max(initial=0) < 1e20 else out

    def scores(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(vectors, queries) inner products of queries with the codes' sums, from their tables."""
        out = tables[0][codes[:, 0]]
        for k in range(1, len(tables)):
            out += tables[k][codes[:, k]]
        return out

    @property
    def rounding(self) -> float:
        """How far scores() may be off for a query of length one: single precision over the largest codewords."""
        return float(np.sqrt((self.books**2).sum(axis=2)).max(axis=1).sum()) * (len(self.books) + 2) * 2.0**-24


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def fit(sample: np.ndarray, s: Settings) -> Quantiser:
    """Codebooks one after another, each on what the ones before leave of the sample."""
    rng = np.random.default_rng(9)
    rest, books = sample.astype(np.float64), []
    for _ in range(s.codebooks):
        book = k_means(rest, s.codewords, s.rounds, rng)
        rest = rest - book[((book**2).sum(axis=1) - 2 * rest @ book.T).argmin(axis=1)]
        books.append(book)
    return Quantiser(np.array(books), s.beam)


def digest(vector: bytes) -> bytes:
    return hashlib.blake2b(vector, digest_size=16).digest()


def vectors_of(table: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """(vec_id, digest, vector as doubles) of the rows that take part, and their dimension."""
    ok = table.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = ok.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(good)
    sizes = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = sizes.d if sizes else 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, max(1, dimension)) + 0.0
            data = [x.tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(map(digest, data), pa.binary()), pa.array(data, pa.binary())], ["vec_id", "digest", "vector"])

    out = ok.where(F.size("v") == dimension).mapInArrow(packed, "vec_id long, digest binary, vector binary")
    return written(out, "vectors"), dimension


def first_members(vectors: DataFrame, most: int) -> DataFrame:
    """(digest, vec_id): every class's smallest ids, thinned out in salted shares before they meet."""
    rows = vectors.select("digest", "vec_id").distinct()
    for shares in (64, 8, 1):
        w = Window.partitionBy("digest", F.pmod(F.xxhash64("vec_id"), F.lit(shares))).orderBy("vec_id")
        rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")
    return rows


def stacked(batch: pa.RecordBatch, column: str, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<f8").reshape(-1, dimension)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and y, summed from the first component on."""
    out = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        out += a * b
    return out


class Best:
    """A block's best rows of each query of a group: exact scores of classes, at most ``most`` a query."""

    def __init__(self, bar: np.ndarray, most: int):
        self.floor, self.most, self.waiting = bar.copy(), most, 0
        self.held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, "V16"))]

    def add(self, query: np.ndarray, score: np.ndarray, first: np.ndarray, name: np.ndarray) -> None:
        keep = ~(score < self.floor[query])
        self.held.append((query[keep], score[keep], first[keep], name[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > 100_000:
            self.thin()

    def thin(self) -> None:
        q, score, first, name = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((first, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, last = order[place < self.most], order[place == self.most - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.held, self.waiting = [(q[order], score[order], first[order], name[order])], 0


class Run:
    """Some coded vectors that lie beside each other, and the ball they lie in."""

    def __init__(self, row: dict, books: Quantiser, d: int):
        self.x, self.first, self.name = np.frombuffer(row["vector"], "<f8").reshape(-1, d), np.frombuffer(row["first"], "<i8"), np.frombuffer(row["digest"], "V16")
        self.codes = np.frombuffer(row["code"], np.uint8).reshape(len(self.x), -1)
        norms = np.frombuffer(row["norm"], "<f4").reshape(-1, 2).astype(float) * (1 + 1e-6)
        # Norms a little up, for their own rounding and for that of the sums.
        self.missing, self.norm = norms[:, 1] + 1e-9 * norms.sum(axis=1), norms.sum(axis=1)
        near = books.decode(self.codes)
        self.centre = near.mean(axis=0)
        self.radius = float(np.sqrt(((near - self.centre) ** 2).sum(axis=1)).max() + self.missing.max()) * (1 + 1e-9)


def rerank(run: Run, books: Quantiser, asked: np.ndarray, lengths: np.ndarray, tables: list[np.ndarray], block: int, best: Best) -> None:
    """Adds to best what of a run may reach the queries' bars, with exact scores."""
    # What isn't a number can't be ruled out: hence "not less".
    reach = ~(asked @ run.centre + lengths * run.radius < best.floor) & ~(lengths * run.norm.max() < best.floor)
    slack = 1e-9 * run.norm
    for at, table in zip(range(0, len(asked), block), tables, strict=True):
        q = np.flatnonzero(reach[at : at + block]) + at
        if not len(q):
            continue
        if len(q) < block // 4:
            table = table[:, :, q - at]
        else:
            q = np.arange(at, min(at + block, len(asked)))

        def exact(j: np.ndarray, i: np.ndarray, q: np.ndarray = q) -> None:
            for b in range(0, len(i), 16_384):
                who, what = q[i[b : b + 16_384]], j[b : b + 16_384]
                best.add(who, in_order(run.x[what], asked[who]), run.first[what], run.name[what])

        likely = books.scores(table, run.codes) + lengths[q] * (run.missing[:, None] + books.rounding)
        new = np.flatnonzero(np.isneginf(best.floor[q]))
        if len(new) and len(run.x) > best.most:  # bars to begin with
            j, i = np.argpartition(-likely[:, new], best.most, axis=0)[: best.most].ravel(), np.tile(new, best.most)
            exact(j, i)
            likely[j, i] = -np.inf
            best.thin()
        may = ~(likely < best.floor[q])
        rows = np.flatnonzero(may.any(axis=1))
        # Products first as a whole, up to their rounding, then in order for what is left.
        may = may[rows] & ~(run.x[rows] @ asked[q].T + lengths[q] * slack[rows, None] < best.floor[q])
        j, i = may.nonzero()
        exact(rows[j], i)


RUN = ("digest", "vector", "first", "code", "norm")
RUNS = "part long, place int, " + ", ".join(f"{c} binary" for c in RUN)


def runs_of(codes: DataFrame, number: int, d: int, s: Settings) -> tuple[DataFrame, int]:
    """Coded vectors along the order of their codes, a run in one row; and in how many blocks tasks can hold them."""
    row_bytes = 8 * d + s.codebooks + 32
    blocks = max(-(-number * row_bytes // s.block_bytes), min(codes.sparkSession.sparkContext.defaultParallelism, -(-number // s.run)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, s.run):
                part = batch.slice(low, s.run)
                data = [part.column(c).to_numpy().astype("<i8").tobytes() if c == "first" else b"".join(part.column(c).to_pylist()) for c in RUN]
                yield pa.RecordBatch.from_arrays([pa.array([partition], pa.int64()), pa.array([place], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["part", "place", *RUN])
                place += 1

    runs = codes.select(*RUN).repartitionByRange(blocks, "code", "digest").sortWithinPartitions("code", "digest").mapInArrow(packed, RUNS)
    return written(runs, "runs"), blocks


def groups_of(queries: DataFrame, s: Settings) -> DataFrame:
    """(ids, asked, bars): queries packed in groups; a query without a bar has none to reach."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, s.query_group):
                part = batch.slice(low, s.query_group)
                bars = np.array([-np.inf if x is None else x for x in part.column("bar").to_pylist()], "<f8")
                data = part.column("query_id").to_numpy().astype("<i8").tobytes(), b"".join(part.column("vector").to_pylist()), bars.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["ids", "asked", "bars"])

    return queries.repartition(-(-queries.count() // (4 * s.query_group)) or 1).mapInArrow(packed, "ids binary, asked binary, bars binary")


def reaching(runs: DataFrame, blocks: int, queries: DataFrame, shipped: Broadcast, d: int, k: int, s: Settings) -> DataFrame:
    """(query_id, digest, first, score): exact scores of all that may be among a query's k nearest.

    queries hold a bar each, the score of k rows or null.  A block gives the
    best 2k + 1 classes of a query (by score and smallest id: a few of them may
    hold no other row than the query's own).
    """
    most = 2 * k + 1
    # Neighbouring parts make a block, so that there are no more blocks, and no more rows from them, however the runs were dealt.
    parts = (runs.agg(F.max("part")).first()[0] or 0) + 1
    runs = runs.withColumn("block", F.floor(F.col("part") * blocks / parts))
    groups = groups_of(queries, s).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # A block's runs come before all groups.
    met = runs.unionByName(groups, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", F.asc_nulls_last("part"), "place")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, block, held = shipped.value, None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["block"] != block:
                    block, held = row["block"], []
                if row["place"] is not None:
                    held.append(Run(row, books, d))
                    continue
                ids, asked, best = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["asked"], "<f8").reshape(-1, d), Best(np.frombuffer(row["bars"], "<f8"), most)
                lengths, tables = np.sqrt((asked**2).sum(axis=1)) * (1 + 1e-9), [books.tables(asked[b : b + s.query_block]) for b in range(0, len(asked), s.query_block)]
                for run in held:
                    rerank(run, books, asked, lengths, tables, s.query_block, best)
                best.thin()
                q, score, first, name = best.held[0]
                for b in range(0, len(q), 10_000):
                    to = slice(b, b + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[to]]), pa.array([bytes(v) for v in name[to]], pa.binary()), pa.array(first[to]), pa.array(score[to])], ["query_id", "digest", "first", "score"])

    return written(met.mapInArrow(scored, "query_id long, digest binary, first long, score double"), "reaching")


def search(table: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings(), *, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (over vec_id) holds."""
    s = settings
    bounded_batches(table)
    vectors, d = vectors_of(table, key, column)
    distinct = written(vectors.groupBy("digest", "vector").agg(F.min("vec_id").alias("first")), "distinct-vectors")
    total = distinct.count()
    if not total:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    u = F.shiftrightunsigned(F.xxhash64("digest"), 11) / F.lit(float(1 << 53))
    sample = distinct.where(u < min(1.0, s.sample_rows / total)).orderBy(u, "digest").limit(2 * s.sample_rows).select("vector").collect()
    words = min(s.codewords, max(1, len(sample) // 4))
    quantiser = fit(np.frombuffer(b"".join(bytes(r.vector) for r in sample), "<f8").reshape(-1, d) if sample else np.zeros((1, d)), Settings(**{**s.__dict__, "codewords": words}))
    shipped = table.sparkSession.sparkContext.broadcast(quantiser)  # codebooks * codewords vectors

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch, "vector", d)
                codes = shipped.value.encode(x)
                near = shipped.value.decode(codes)
                norms = np.stack((np.sqrt((near**2).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))), axis=1).astype("<f4")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("digest", "vector", "first")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([x.tobytes() for x in norms], pa.binary())], ["digest", "vector", "first", "code", "norm"])

    codes = written(distinct.select("digest", "vector", "first").mapInArrow(encoded, "digest binary, vector binary, first long, code binary, norm binary"), "codes")
    queries = written(vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct(), "queries")
    members = written(first_members(vectors, k + 1), "members")
    forget(vectors, distinct)

    def ranked(scores: DataFrame) -> DataFrame:
        """The k best rows of each query among scored classes."""
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "digest")
        few = scores.withColumn("k", F.row_number().over(by)).where(F.col("k") <= 2 * k + 1).drop("k", "first")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return few.join(members, "digest").where("vec_id != query_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    part = max(s.sample_rows, round((total * s.share / 2) ** 0.5))
    if part < total:
        some, blocks = runs_of(codes.where(u < part / total), part, d, s)
        found = ranked(reaching(some, blocks, queries.withColumn("bar", F.lit(None).cast("double")), shipped, d, k, s))
        bars = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        queries = written(queries.join(bars, "query_id", "left"), "bars")
        forget(some)
    else:
        queries = queries.withColumn("bar", F.lit(None).cast("double"))
    runs, blocks = runs_of(codes, total, d, s)
    forget(codes)
    return ranked(reaching(runs, blocks, queries, shipped, d, k, s)).select("query_id", "rank", "vec_id", "score")
