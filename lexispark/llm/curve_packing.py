"""Packing along a space-filling curve.

A document's hashed bag of tokens is projected to a few dimensions by a fixed
random matrix and placed on a Hilbert curve.  Documents are range-sorted by
(curve key, doc_id), and each range is packed in that order: full sequences,
cut freely, and at its end sequences of powers of two, so nothing is padded.
A hot group of copies has one curve key; doc_id in the sort key splits it.

Texts are tokenised once, into a written table, and shuffled once.

Defined results: a null or empty text is the end id alone; repeated rows, also
under one doc_id, are packed each; an empty table packs into nothing; other
columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, give_back, written
from lexispark.llm.tokens import encoder


@dataclass(frozen=True)
class Curve:
    """Sizes of the hashed vector and of the curve's grid: dimensions * bits stay under 63."""

    features: int = 256
    dimensions: int = 4
    bits: int = 12
    seed: int = 5

    def projection(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.features, self.dimensions)) / np.sqrt(self.dimensions)


def document_vector(ids: np.ndarray, curve: Curve) -> np.ndarray:
    """Damped, centred counts of hashed tokens, of length one (zero for no tokens)."""
    with np.errstate(over="ignore"):
        slots = (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (curve.features.bit_length() - 1))
    v = np.sqrt(np.bincount(slots, minlength=curve.features))
    v -= v.mean()
    size = np.sqrt(v @ v)
    return v / size if size else v


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid coordinates (rows, dimensions), each under 2**bits.

    Coordinates are turned into the curve's transposed form from the highest
    bit down (reflect or swap against the first axis), Gray-decoded, and their
    bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= np.where(on, 0, swap)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> level) & 1)
    return out


def curve_keys(vectors: np.ndarray, curve: Curve) -> np.ndarray:
    grid = np.floor((np.tanh(vectors @ curve.projection()) + 1) / 2 * (1 << curve.bits))
    return hilbert_keys(np.clip(grid, 0, (1 << curve.bits) - 1), curve.bits)


def tail_sizes(length: int) -> list[int]:
    """The powers of two that sum to length, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, size: int = 4096, curve: Curve = Curve(), text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a piece of a document in a sequence; with_ids adds its ids (binary, little-endian)."""
    bounded_batches(docs)
    staged = "doc_id long, place long, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        end = np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            data = [tokens.encode(body) + end for body in batch.column("text").to_pylist()]
            vectors = np.array([document_vector(np.frombuffer(x, tokens.dtype), curve) for x in data]).reshape(len(data), curve.features)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(curve_keys(vectors, curve), pa.int64()), pa.array(data, pa.binary())], ["doc_id", "place", "ids"])
            give_back()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        part, number = TaskContext.get().partitionId() << 36, 0
        types = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*pieces, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns[: 8 if with_ids else 7], names[: 8 if with_ids else 7])

        def piece(doc: int | None, ids: np.ndarray, start: int, stop: int, sequence: int, offset: int) -> tuple:
            body = ids[start:stop].astype("<u4")
            return doc, start, stop - start, zlib.crc32(body), len(ids), part | sequence, offset, body.tobytes() if with_ids else None

        held: list[tuple] = []  # (doc_id, ids, start, stop) of the sequence being filled
        room = size
        for batch in batches:
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, start = np.frombuffer(data, dtype), 0
                while start < len(ids):
                    stop = min(len(ids), start + room)
                    held.append((doc, ids, start, stop))
                    room -= stop - start
                    start = stop
                    if not room:
                        offset = 0
                        for d, x, a, b in held:
                            out.append(piece(d, x, a, b, number, offset))
                            offset += b - a
                        held, room, number = [], size, number + 1
            if out:
                yield batch_of(out)
        sizes, offset, out = tail_sizes(size - room), 0, []
        for d, x, a, b in held:  # the range's rest, in sequences of powers of two
            while a < b:
                stop = min(b, a + sizes[0] - offset)
                out.append(piece(d, x, a, stop, number, offset))
                offset += stop - a
                a = stop
                if offset == sizes[0]:
                    sizes, offset, number = sizes[1:], 0, number + 1
        if out:
            yield batch_of(out)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(encode, staged)
    rows = written(rows, "packing-ids").repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id")
    return rows.mapInArrow(fill, PIECES + (", ids binary" if with_ids else ""))
