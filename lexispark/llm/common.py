"""What the operators of this subpackage share: written tables, folds, digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD_PATTERN_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))


_CACHES: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """A worker that goes from one operator to another keeps the named cache alone; the others are emptied, and their memory is given back."""
    if others := [other for other in _CACHES if other != name]:
        for other in others:
            _CACHES.pop(other)()
        gc.collect()
        give_back(0)
    _CACHES[name] = clear


_GIVEN_BACK = [0.0]


def give_back(every: float = 0.5) -> None:
    """Freed memory goes back to the system, at most once in so many seconds: workers stay, and an idle one should be small."""
    if time.monotonic() - _GIVEN_BACK[0] >= every:
        _GIVEN_BACK[0] = time.monotonic()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every system's library can
            ctypes.CDLL(None).malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as spark.checkpoint.dir names it.

    Only where that is unset and the master is local is one made here, for tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = f"file://{tempfile.mkdtemp(prefix='lexispark-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads: all that came from them has been written itself."""
    for df in tables:
        drop(df.sparkSession, df.written_path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sieved(rows: DataFrame, key: str, wanted: DataFrame, most_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of wanted, rows that surely have none): only the former need a join.

    wanted has the key alone.  The sieve is a bitmap of hashed keys, 16 bits or
    more for each while 2**most_bits (32 MB, which is broadcast) suffice; beyond
    that it lets more rows through, and never loses one.
    """
    bits = min(max(15, (16 * wanted.count()).bit_length()), most_bits)
    place, bucket, bitmap = fresh(rows, "place", "bucket", "bitmap")
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    within = lambda c: c.bitwiseAND(F.lit((1 << 15) - 1).cast("long"))
    sieve = wanted.select(hashed.alias(place)).groupBy(F.shiftright(place, 15).alias(bucket)).agg(F.bitmap_construct_agg(within(F.col(place))).alias(bitmap))
    marked = rows.withColumn(place, hashed).withColumn(bucket, F.shiftright(place, 15)).join(F.broadcast(written(sieve, "sieve")), bucket, "left")
    at = within(F.col(place))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
    return tuple(marked.where(x).select(*rows.columns) for x in (there, ~there))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def share(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id alone, to draw bounded samples."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) / F.lit(float(1 << 53))


def bounded_batches(df: DataFrame) -> None:
    """From now on, batches on their way to Python hold few megabytes, however long the texts are (unless the session says otherwise)."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) in (None, "-1", str(2**31 - 1)):
        spark.conf.set(BATCH_BYTES, "4m")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: fewer whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
