"""Token-id output: a content-addressed store of id streams.

A gear rolling hash cuts every document's ids (with the end id) into chunks;
equal chunks are kept once, under their digest.  The store is a folder of

    chunks/kind=chunk     digest, data (little-endian ids), n
    recipes/kind=recipe   documents in ascending doc_id order: doc_id, n_tokens,
                          chunk digests and lengths, place, Merkle leaf's inputs
    recipes/kind=root     one Merkle root for each run of recipes

Nothing is gathered in one task or on the driver but one root and two sums for
each range partition.  Texts are tokenised once and their ids shuffled once;
each task sends an equal chunk once, so hot copies shrink before the shuffle.
Reading verifies digests, roots and lengths, and raises where they don't hold.

Defined results: a null or empty text is the end id alone; repeated rows, also
under one doc_id, are stored and returned each; null ids come first; an empty
table gives an empty store; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, drop
from lexispark.llm.tokens import encoder

DIGEST = 20
REACH = 32  # ids in a rolling hash
CRC_POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Chunking:
    """Cuts fall where the rolling hash's top ``bits`` bits are zero, within the two limits."""

    bits: int = 8
    least: int = 64
    most: int = 2048


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def rolling(ids: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 ids up to each place: the sum of mixed ids, each shifted by its distance."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        for reach in (1, 2, 4, 8, 16):
            h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
    return h


def cuts(ids: np.ndarray, how: Chunking) -> list[int]:
    """Ends of the chunks, ascending, the last being the stream's end."""
    return next(all_cuts(ids, [len(ids)], how))


def all_cuts(ids: np.ndarray, stops: list[int], how: Chunking) -> Iterator[list[int]]:
    """cuts() of streams one behind another, counted from the first one's start; stops are the streams' ends."""
    hashes = rolling(ids)
    if how.least < REACH:  # else no cut is looked for where a hash holds ids of the stream before
        for start, stop in zip(stops, stops[1:], strict=False):
            hashes[start : min(start + REACH, stop)] = rolling(ids[start : min(start + REACH, stop)])
    wanted = (np.flatnonzero(hashes >> np.uint32(32 - how.bits) == 0) + 1).tolist()
    start = k = 0
    for stop in stops:
        ends: list[int] = []
        while stop - start > how.least:
            k = bisect_left(wanted, start + how.least, k)
            end = wanted[k] if k < len(wanted) else stop
            start = min(end, start + how.most, stop)
            ends.append(start)
        if start < stop or not ends:
            ends.append(stop)
        start = stop
        yield ends


class Merkle:
    """Root of a binary hash tree over leaves that arrive one by one; memory grows with its height."""

    def __init__(self) -> None:
        self.heights: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.heights and self.heights[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.heights.pop()[1] + node[1]).digest())
        self.heights.append(node)

    def root(self) -> bytes:
        node = b""
        for _, other in reversed(self.heights):
            node = hashlib.sha256(b"\1" + other + node).digest() if node else other
        return node


def leaf(doc_id: int | None, n: int, digests: bytes, lengths: bytes) -> bytes:
    return f"{doc_id} {n} ".encode() + digests + lengths


def crc_shift(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What crc32 values contribute when ``after`` further bytes follow: crcs times x**(8 after)."""

    def times(factor: int, b: np.ndarray) -> np.ndarray:
        out = np.zeros_like(b)
        for k in range(31, -1, -1):
            if factor >> k & 1:
                out ^= b
            b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
        return out

    out, power = crcs.astype(np.uint32), 1 << 30
    for _ in range(3):
        power = int(times(power, np.array([power], np.uint32))[0])
    after = after.astype(np.int64)
    while after.any():
        odd = (after & 1).astype(bool)
        out[odd] = times(power, out[odd])
        power = int(times(power, np.array([power], np.uint32))[0])
        after >>= 1
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, how: Chunking = Chunking(), *, text: str = "text", key: str = "doc_id") -> None:
    """Encode docs and write their store at path."""
    spark = docs.sparkSession
    bounded_batches(docs)
    staged = "kind string, place binary, doc_id long, n int, data binary, lengths binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sent, here, count = encoder(tokenizer), set(), TaskContext.get().partitionId(), 0
        end, size = np.array([end_id], tokens.dtype).tobytes(), tokens.dtype.itemsize
        for batch in batches:
            rows: list[tuple] = []
            bodies = [body + end for body in tokens.encode_all(batch.column("text").to_pylist())]
            data, stops = b"".join(bodies), [*accumulate(len(x) // size for x in bodies)]
            start = 0
            for doc_id, stop, ends in zip(batch.column("key").to_pylist(), stops, all_cuts(np.frombuffer(data, tokens.dtype), stops, how), strict=True):
                n, digests, lengths = stop - start, [], []
                for stop in ends:
                    piece = data[start * size : stop * size]
                    digests.append(d := digest(piece))
                    lengths.append(stop - start)
                    if d not in sent:
                        sent.add(d)
                        rows.append(("chunk", d, None, stop - start, piece, None))
                    start = stop
                count += 1  # dealt by place, so that null and repeated ids don't meet
                rows.append(("recipe", digest(f"{here} {count}".encode()), doc_id, n, b"".join(digests), np.array(lengths, "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["kind", "place", "doc_id", "n", "data", "lengths"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for kind, place in zip(batch.column("kind").to_pylist(), batch.column("place").to_pylist(), strict=True):
                keep.append(kind != "chunk" or place != last)
                last = place if kind == "chunk" else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(encode, staged)
    rows = rows.repartition("place").sortWithinPartitions("kind", "place").mapInArrow(once, staged)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")

    recipe = "kind string, part int, ordinal long, start long, doc_id long, n int, digests binary, lengths binary"

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        names = ["kind", "part", "ordinal", "start", "doc_id", "n", "digests", "lengths"]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            n = np.array(batch.column("n").to_pylist(), np.int64)
            for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "data", "lengths")), strict=True):
                tree.add(leaf(*x))
            starts, size = start + np.cumsum(n) - n, batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(["recipe"] * size), pa.array([part] * size, pa.int32()), pa.array(range(ordinal, ordinal + size), pa.int64()), pa.array(starts, pa.int64()), *(batch.column(c) for c in ("doc_id", "n", "data", "lengths"))],
                names,
            )
            ordinal, start = ordinal + size, start + int(n.sum())
        if ordinal:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(("root", part, ordinal, start, None, 0, tree.root(), None), types, strict=True)], names)

    found = spark.read.schema(staged).parquet(f"{path}/chunks").where("kind = 'recipe'").select("doc_id", "n", "data", "lengths")
    found = found.repartitionByRange("doc_id", "n", "data").sortWithinPartitions("doc_id", "n", "data").mapInArrow(order, recipe)
    found.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    drop(spark, f"{path}/chunks/kind=recipe")


def read(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """One verified row a stored document: doc_id, start, n_tokens, ids_crc32."""
    dtype = encoder(tokenizer).dtype.str
    recipes = spark.read.schema("kind string, part int, ordinal long, start long, doc_id long, n int, digests binary, lengths binary").parquet(f"{path}/recipes")
    roots = sorted((r.part, r.start, bytes(r.digests)) for r in recipes.where("kind = 'root'").select("part", "start", "digests").collect())  # one a range partition
    before, total = {}, 0
    for part, size, _ in roots:
        before[part] = total
        total += size
    wanted = {part: root for part, _, root in roots}

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column("place").to_pylist(), batch.column("data").to_pylist()
            crcs = []
            for k, body in zip(keys, data, strict=True):
                if digest(body) != k:
                    raise ValueError(f"chunk {k.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(body, dtype).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([len(x) // np.dtype(dtype).itemsize for x in data], pa.int64()), pa.array(crcs, pa.int64())], ["digest", "found", "crc"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Merkle] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for part, ordinal, start, doc_id, n, digests, lengths in zip(*(batch.column(c).to_pylist() for c in ("part", "ordinal", "start", "doc_id", "n", "digests", "lengths")), strict=True):
                trees.setdefault(part, Merkle()).add(leaf(doc_id, n, digests, lengths))
                sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
                for k, (size, rest) in enumerate(zip(sizes.tolist(), (4 * (sizes.sum() - sizes.cumsum())).tolist(), strict=True)):
                    for column, x in zip(out, (digests[k * DIGEST : (k + 1) * DIGEST], (part << 40) | ordinal, before[part] + start, doc_id, n, size, rest), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], ["digest", "at", "start", "doc_id", "n", "size", "rest"])
        for part, tree in trees.items():
            if tree.root() != wanted.get(part):
                raise ValueError(f"the recipes of part {part} don't match their root")

    @F.arrow_udf("long")
    def shifted(crc: pa.Array, rest: pa.Array) -> pa.Array:
        return pa.array(crc_shift(crc.to_numpy(), rest.to_numpy()).astype(np.int64))

    chunks = spark.read.schema("kind string, place binary, data binary").parquet(f"{path}/chunks").where("kind = 'chunk'").select("place", "data").mapInArrow(checked, "digest binary, found long, crc long")
    refs = recipes.where("kind = 'recipe'").drop("kind").repartition("part").sortWithinPartitions("part", "ordinal").mapInArrow(parts, "digest binary, at long, start long, doc_id long, n long, size long, rest long")
    joined = refs.join(chunks, "digest").withColumn("crc", shifted("crc", "rest"))
    out = joined.groupBy("at", "start", "doc_id", "n").agg(F.expr("bit_xor(crc)").alias("crc"), F.sum("found").alias("got"))
    whole = F.when(F.col("got") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("chunks are missing")))
    return out.select("doc_id", "start", whole.cast("long").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
