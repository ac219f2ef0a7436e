"""Near-duplicate detection with HyperMinHash registers.

1. Every text becomes its set of hashed word shingles; equal sets are one node
   (a group of exact copies shrinks to one row in each task before it is
   shuffled).  A node keeps 16-bit HyperMinHash registers: 6 bits of leading
   zeros and 10 bits of mantissa of a minimum.  Each register has a hash
   function of its own instead of a share of one, so short texts fill them all.
2. Bands of registers give buckets.  A bucket's nodes are compared with the one
   of them that meets most nodes, not with each other: candidates are filtered by set size, then by the
   collision-corrected estimate, and confirmed on the full sets.
3. Confirmed links make components.  Where a bucket's nodes still lie in
   several, blocks of them are compared, each pair of blocks in one matrix
   product of full sets, so no link between two components is missed and only
   links that join components are put out.

No pair is made within a component or for each pair of a bucket's nodes: a group
of n near copies around a common text costs work in proportion to n.  At a similarity of exactly 0.8
the bands (36 of 5 registers) miss a pair of nodes with a probability of 6.2e-7,
and the estimate, which gives up pairs 5.5 deviations under the threshold
unconfirmed, with one of 1.65e-7: together 7.9e-7.

Defined results: a text without words has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows repeated
under one doc_id each get their own text's answer; a null doc_id takes no part and has a
null component; an empty table gives an empty result; other columns play no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import bounded_batches, forget, fresh, sieved, slices, sole_cache, written
from lexispark.llm.components import components

WORDS_KNOWN = 150_000
MANTISSA = 10
#: The share of one register by which different minima collide, from the HyperMinHash paper.
COLLISIONS = 0.169919487159739


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    block: int = 256
    #: Nodes that share one copy of their lead's text.
    run: int = 512
    #: Standard deviations by which an estimate may fall short before a pair is given up unconfirmed.
    margin: float = 5.5

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def slack(self) -> float:
        """The estimate under which a pair is given up."""
        t = self.percent / 100
        return t - self.margin * (t * (1 - t) / self.registers) ** 0.5


class WordHashes(dict):
    """word -> 64-bit hash, for the words a worker has met; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, whose words are lower-cased (A-Z) and split at white space."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def digest(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 32, count, np.uint32)[:, None], (r.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def registers(shingle_set: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash registers: leading zeros and mantissa of the least value under each hash function."""
    offsets, factors = hash_family(count)
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            y = x[None, at : at + 512] ^ offsets
            y *= factors
            np.minimum(least, y.min(axis=1), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = (fraction * (2 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (np.minimum(32 - exponent, 63).astype(np.int64) << MANTISSA | mantissa).astype("<u2")


def estimates(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities from shares of equal registers of sets of n and m shingles, less the expected chance collisions."""
    chance = COLLISIONS * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2
    return (equal - chance) / (1 - chance)


def buckets(registers_of: np.ndarray, s: Settings) -> np.ndarray:
    """(documents, bands) bucket keys."""
    r = registers_of.reshape(-1, s.bands, s.rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), r.shape[:2])
        for k in range(s.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(sets of a, sets of b) sizes of the intersections, as matrix products over slices of the shared shingles."""
    out = np.zeros((len(a), len(b)), np.float32)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        whole, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(shared.searchsorted(whole), len(shared) - 1)
        hit = shared[at] == whole
        order = at[hit].argsort(kind="stable")
        return at[hit][order], owner[hit][order]

    if len(shared):
        sides = places(a), places(b)
        for low in range(0, len(shared), 8192):
            slices = []
            for (at, owner), sets in zip(sides, (a, b), strict=True):
                k = slice(*at.searchsorted((low, low + 8192)))
                dense = np.zeros((len(sets), min(8192, len(shared) - low)), np.float32)
                dense[owner[k], at[k] - low] = 1
                slices.append(dense)
            out += slices[0] @ slices[1].T
    return out


def promising_pairs(one: list[tuple], other: list[tuple], s: Settings) -> np.ndarray:
    """(rows of one, rows of other): of different components, and similar enough by size and estimate."""
    n, m = (np.array([r[4] for r in x], float) for x in (one, other))
    roots = {x: k for k, x in enumerate(dict.fromkeys(r[3] for r in (*one, *other)))}
    ra, rb = (np.array([roots[r[3]] for r in x]) for x in (one, other))
    maybe = (ra[:, None] != rb) & (100 * np.minimum(n[:, None], m) >= s.percent * np.maximum(n[:, None], m))
    if maybe.any():
        marks = [np.array([np.frombuffer(r[5], "<u2") for r in x]).T for x in (one, other)]
        same = np.zeros(maybe.shape, np.int32)
        for x, y in zip(*marks, strict=True):
            same += x[:, None] == y
        maybe &= estimates(same / s.registers, n[:, None], m) >= s.slack
    return maybe


def both_sides(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    one, other = ([r for r in rows if r[1] == k] for k in (0, 1))
    return one, other or one


def hopeful(rows: list[tuple], s: Settings) -> list[tuple]:
    """Those of the rows (pair, side, node, root, n, marks) of two blocks, or one, that have a promising partner."""
    one, other = both_sides(rows)
    if not one:
        return []
    maybe = promising_pairs(one, other, s)
    left, right = maybe.any(axis=1), maybe.any(axis=0)
    if other is one:
        left = left | right
    kept = [r for r, k in zip(one, left, strict=True) if k]
    return kept if other is one else kept + [r for r, k in zip(other, right, strict=True) if k]


def block_links(rows: list[tuple], s: Settings) -> list[tuple[bytes, bytes]]:
    """Of the rows (pair, side, node, root, n, marks, text) of two blocks, or one: links that
    join components of which any two texts, one of either block, are similar enough."""
    one, other = both_sides(rows)
    if not one or not (maybe := promising_pairs(one, other, s)).any():
        return []
    n, m = (np.array([r[4] for r in x], float) for x in (one, other))
    roots = {x: k for k, x in enumerate(dict.fromkeys(r[3] for r in rows))}
    ra, rb = (np.array([roots[r[3]] for r in x]) for x in (one, other))
    ka, kb = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    a, b = [shingles(one[k][6], s.shingle) for k in ka], [shingles(other[k][6], s.shingle) for k in kb]
    sound = np.array([digest(x) == one[k][2] for x, k in zip(a, ka, strict=True)])[:, None] & np.array([digest(x) == other[k][2] for x, k in zip(b, kb, strict=True)])
    both = common(a, b)
    similar = maybe[np.ix_(ka, kb)] & sound & (100 * both >= s.percent * (n[ka][:, None] + m[kb] - both))
    parent = list(range(len(roots)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    for i, j in zip(*similar.nonzero(), strict=True):
        x, y = top(ra[ka[i]]), top(rb[kb[j]])
        if x != y:
            parent[x] = y
            out.append((one[ka[i]][2], other[kb[j]][2]))
    return out


class Finder:
    """The steps over one table; every step's output is a written table or a lazy read of one."""

    def __init__(self, docs: DataFrame, s: Settings, *, text: str = "text", key: str = "doc_id"):
        self.s = s
        bounded_batches(docs)
        self.docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
        kind = self.docs.schema["doc_id"].dataType.simpleString()

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_cache("words", word_hashes().clear)
            for batch in slices(batches):
                n, nodes, marks = [], [], []
                for body in batch.column("text").to_pylist():
                    found = shingles(body, s.shingle)
                    n.append(len(found))
                    nodes.append(digest(found) if len(found) else None)
                    marks.append(registers(found, s.registers).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(marks, pa.binary())], ["doc_id", "n", "node", "marks"])

        self.sketches = written(self.docs.mapInArrow(sketch, f"doc_id {kind}, n long, node binary, marks binary"), "sketches")
        whole = self.sketches.where("node is not null and doc_id is not null")
        self.nodes = written(whole.groupBy("node", "n", "marks").agg(F.min("doc_id").alias("least")), "nodes")

    def members(self) -> DataFrame:
        """(bucket, node, n): every node in each of its buckets."""
        s = self.s

        def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), "<u2")
                at = pa.array(np.repeat(np.arange(batch.num_rows), s.bands))
                yield pa.RecordBatch.from_arrays([pa.array(buckets(marks, s).ravel()), batch.column("node").take(at), batch.column("n").take(at)], ["bucket", "node", "n"])

        return self.nodes.select("node", "n", "marks").mapInArrow(band, "bucket long, node binary, n long")

    def near(self, other: str) -> F.Column:
        """The sizes allow the similarity asked for."""
        return (100 * F.least("n", other) >= self.s.percent * F.greatest("n", other)) & (F.col("node") != F.col("lead"))

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes; a repeated doc_id may bring another text, too.

        The one step that shuffles whole texts, and hardly any but those that the nodes name.
        """
        wanted = nodes.select("node", F.col("least").alias("doc_id"))
        likely, _ = sieved(self.docs, "doc_id", wanted.select("doc_id"))
        return written(likely.join(wanted, "doc_id").select("node", "text"), "texts")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those distinct (node, lead) pairs whose registers allow the similarity asked for; no text is read."""
        s = self.s

        def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, s.registers) for c in ("marks", "lead_marks"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "lead_n"))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lead")], ["node", "lead"]).filter(pa.array(estimates((x == y).mean(axis=1), n, m) >= s.slack))

        one = self.crowded.select("node", "n", "marks")
        other = self.crowded.select(F.col("node").alias("lead"), F.col("n").alias("lead_n"), F.col("marks").alias("lead_marks"))
        pairs = pairs.select("node", "lead").distinct().join(one, "node").join(other, "lead")
        return written(pairs.mapInArrow(promising, "node binary, lead binary"), "likely")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those (node, lead) pairs that are similar enough: by estimate first, then on full sets.

        A lead's nodes come in runs of bounded number, and each run brings the lead's text once.
        """
        s = self.s
        pairs = self.likely(pairs)
        leads = written(pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / s.run).alias("runs")), "runs")
        one = pairs.join(leads, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("runs")).alias("run"), F.lit(1).alias("kind"), "node")
        first = leads.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind"), F.col("lead").alias("node"))
        rows = one.union(first).join(self.texts, "node").select("lead", "run", "kind", "node", "text")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_cache("words", word_hashes().clear)
            last, whole = None, np.zeros(0, np.uint64)
            for batch in slices(batches):
                found: list[tuple[bytes, bytes]] = []
                for lead, kind, node, text in zip(*(batch.column(c).to_pylist() for c in ("lead", "kind", "node", "text")), strict=True):
                    own = shingles(text, s.shingle)
                    if digest(own) != node:  # a repeated doc_id may bring another text
                        continue
                    if kind == 0:
                        last, whole = lead, own
                    elif last == lead and linked(own, whole, s.percent):
                        found.append((node, lead))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        rows = rows.repartition("lead", "run").sortWithinPartitions("lead", "run", "kind")
        out = written(rows.mapInArrow(confirm, "a binary, b binary").distinct(), "confirmed")
        forget(pairs, leads)
        return out

    def crowds(self) -> DataFrame:
        """(bucket, node, n, weight) of the buckets that more than one node shares.

        A node's weight is the number of nodes it meets over all its buckets:
        the middle of a group of copies meets more than its fringe.
        """
        shared = written(self.members().groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
        met = written(sieved(self.members(), "bucket", shared.select("bucket"))[0].join(shared, "bucket"), "met")
        weights = written(met.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
        crowded = weights.select("node")
        self.crowded = written(sieved(self.nodes, "node", crowded)[0].join(crowded, "node").select("node", "n", "marks", "least"), "crowded")
        self.texts = self.texts_of(self.crowded)
        out = written(met.join(weights, "node").select("bucket", "node", "n", "weight"), "crowds")
        forget(shared, met, weights)
        return out

    def links(self) -> DataFrame:
        """(node, root) for every node that isn't alone, but the roots."""
        crowd = self.crowds()
        heaviest = F.max(F.struct("weight", "node", "n")).alias("lead")
        leads = written(crowd.groupBy("bucket").agg(heaviest).select("bucket", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "leads")
        found = self.confirmed(crowd.join(leads, "bucket").where(self.near("lead_n")))
        stars = components(found)
        named = written(crowd.join(stars, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "named")
        forget(crowd, leads, found)
        sizes = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
        parts = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "root")).alias("main")).where("parts > 1")
        mixed = written(parts.select("bucket", F.col("main.root").alias("main")), "mixed")
        if mixed.isEmpty():
            return stars
        return components(self.crossing(named, mixed).union(stars.select("node", "root")))

    def crossing(self, named: DataFrame, mixed: DataFrame) -> DataFrame:
        """Links between the components of mixed buckets: enough of them to join all that belong together.

        Nodes are dealt to blocks by the first mixed bucket they are in.  For
        every bucket, each block with a node outside the bucket's largest
        component meets each block of the bucket; two blocks are compared in
        one matrix product, whatever the number of buckets they share.
        """
        s = self.s
        inside = written(named.join(mixed, "bucket").select("bucket", "node", "root", (F.col("root") != F.col("main")).alias("rest")), "inside")
        first = written(inside.groupBy("node", "root").agg(F.min("bucket").alias("anchor")), "anchors")
        # Once along the buckets: nodes that share some bucket mostly come to share the anchor, and so blocks.
        least = written(inside.select("bucket", "node").join(first, "node").groupBy("bucket").agg(F.min("anchor").alias("anchor")), "bucket-anchors")
        first = written(inside.join(least, "bucket").groupBy("node", "root").agg(F.min("anchor").alias("anchor")), "anchors")
        shares = written(first.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / s.block).alias("shares")), "shares")
        placed = first.join(shares, "anchor").select("node", "root", F.xxhash64("anchor", F.pmod(F.xxhash64("node"), F.col("shares"))).alias("block"))
        placed = written(placed, "placed")
        per = written(inside.join(placed.select("node", "block"), "node").groupBy("bucket", "block").agg(F.max("rest").alias("rest")), "bucket-blocks")
        met = per.where("rest").select("bucket", F.col("block").alias("one")).join(per.select("bucket", F.col("block").alias("other")), "bucket")
        met = written(met.select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct(), "block-pairs")
        sides = met.select(F.xxhash64("one", "other").alias("pair"), F.lit(0).alias("side"), F.col("one").alias("block"))
        sides = sides.union(met.where("one != other").select(F.xxhash64("one", "other"), F.lit(1), "other"))
        marked = written(placed.join(self.crowded.select("node", "n", "marks"), "node"), "marked")

        def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
            """The rows of each pair of blocks."""
            held: list[tuple] = []
            for batch in slices(batches):
                for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if held and held[0][0] != row[0]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in runs(batches, ("pair", "side", "node", "root", "n", "marks")):
                kept = hopeful(held, s)
                columns = zip(*kept, strict=True) if kept else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["pair", "side", "node", "root", "n", "marks"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole_cache("words", word_hashes().clear)
            for held in runs(batches, ("pair", "side", "node", "root", "n", "marks", "text")):
                links = block_links(held, s)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])

        # Registers alone go to the pairs of blocks; texts follow for nodes that have a partner by estimate.
        rows = sides.join(marked, "block").select("pair", "side", "node", "root", "n", "marks")
        rows = rows.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(sift, "pair long, side int, node binary, root binary, n long, marks binary")
        rows = written(rows, "hopeful").join(self.texts, "node").select("pair", "side", "node", "root", "n", "marks", "text")
        return written(rows.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(compare, "a binary, b binary"), "crossing")

    def classes(self) -> DataFrame:
        """(node, root, component_id): every node's component and its smallest doc_id."""
        rooted = written(self.nodes.select("node", "least").join(self.links(), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
        smallest = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
        return written(rooted.join(smallest, "root").select("node", "root", "component_id"), "classes")


def duplicates(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    return verdicts(Finder(docs, settings, text=text, key=key)).drop("node", "root")


def verdicts(found: Finder) -> DataFrame:
    """duplicates()' rows, with the node of each and its component's root."""
    rows = found.sketches.select("doc_id", "n", "node").join(found.classes(), "node", "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), (F.col("doc_id") == alone).alias("kept"), "node", "root")


def deduplicated(docs: DataFrame, settings: Settings = Settings(), *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group; rows with a null doc_id stay, and so do texts without words.

    Rows whose doc_id is repeated are told apart by their sets of shingles.
    """
    found = Finder(docs, settings, text=text, key=key)
    judged = written(verdicts(found).select("doc_id", "node", "root", "kept"), "verdicts")
    repeated = written(judged.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias(key)), "repeated")
    gone = written(judged.where("not kept").select(F.col("doc_id").alias(key)).union(repeated).distinct(), "gone")
    maybe, sure = sieved(docs, key, gone)
    out = sure.union(maybe.join(gone, key, "left_anti").select(*docs.columns))
    if repeated.isEmpty():
        return out

    @F.arrow_udf("binary")
    def node_of(texts: pa.Array) -> pa.Array:
        sets = (shingles(body, settings.shingle) for body in texts.to_pylist())
        return pa.array([digest(x) if len(x) else None for x in sets], pa.binary())

    node, root, place = fresh(docs, "node", "root", "place")
    rows = docs.join(repeated, key, "left_semi").withColumn(node, node_of(F.col(text).cast("binary")))
    kept = judged.where("kept and node is not null").select(F.col("doc_id").alias(key), F.col("node").alias(node), F.col("root").alias(root)).distinct()
    first = rows.join(kept, [key, node]).withColumn(place, F.row_number().over(Window.partitionBy(key, root).orderBy(text))).where(F.col(place) == 1)
    return out.union(rows.where(F.col(node).isNull()).select(*docs.columns)).union(first.select(*docs.columns))
