"""Rows that no later join can match go before they are shuffled: a bitmap of hashed keys, which is broadcast, tells which.

The bitmap has 16 bits or more for each key while its largest size suffices;
beyond that it lets more rows through.  It never loses a row that matches, so
what is joined and added up afterwards is the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import load_form
from lexispark.operators.statistics import candidates_of, chained, document_counts, forms_of
from lexispark.operators.store import checkpointed

#: Powers of two: bits of the smallest and the largest bitmap (4 KB and 32 MB), and of one of its rows.
LEAST, MOST, ROW = 15, 28, 15


@dataclass(frozen=True)
class Sieve:
    rows: DataFrame
    bits: int

    def marked(self, rows: DataFrame, name: str, *key: Column) -> DataFrame:
        """rows with a column that is true where their key may be one of the sieve's, and else false."""
        place = F.pmod(F.xxhash64(*key), F.lit(1 << self.bits))
        within = F.col("_place").bitwiseAND(F.lit((1 << ROW) - 1).cast("long"))
        word = F.get("_bits", F.shiftright(within, 6).cast("int"))
        hit = F.getbit(word, within.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        out = rows.withColumn("_place", place).withColumn("_bucket", F.shiftright("_place", ROW))
        return out.join(F.broadcast(self.rows), "_bucket").withColumn(name, hit).drop("_place", "_bucket", "_bits")


def sieve_of(keys: DataFrame) -> Sieve:
    """The sieve of the keys that a stored table's columns are, in their order."""
    spark = keys.sparkSession
    bits = min(max(LEAST, (16 * keys.count()).bit_length()), MOST)
    places = keys.select(F.pmod(F.xxhash64(*keys.columns), F.lit(1 << bits)).alias("p"))
    none = spark.range(1 << (bits - 6)).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("w"))
    words = places.selectExpr("shiftright(p, 6) as k", "shiftleft(1L, cast(p & 63 as int)) as w").unionByName(none).groupBy("k").agg(F.bit_or("w").alias("w"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"])
    return Sieve(checkpointed(words.groupBy(F.shiftright("k", ROW - 6).alias("_bucket")).agg(in_order.alias("_bits"))), bits)


def relevant(tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """The tokens that may have parses, in lower case, and the words before them that may: all three statistics are the same over them.

    parses is a stored table.  Of a token's place is left whether it has one.
    """
    held = sieve_of(parses.select("language_code", "form"))
    rows = held.marked(forms_of(chained(tokens)).select("document_id", "language_code", "pos", "form", "before"), "_known", F.col("language_code"), F.col("form")).where("_known").drop("_known")
    # As a function of an array this is a step of its own: one method with both sieves would be too long to be compiled.
    rows = rows.withColumn("_before", F.transform(F.array("before"), lambda w: load_form(F.col("language_code"), w)))
    rows = held.marked(rows, "_known", F.col("language_code"), F.get("_before", F.lit(0)))
    rows = rows.select("document_id", "language_code", F.when(F.col("pos").isNotNull(), F.lit(0).cast("long")).alias("pos"), F.col("form").alias("token"), F.when(F.col("_known"), F.get("_before", F.lit(0))).alias("before"))
    return rows.where("pos is not null or before is not null")


def document_counts_of(wanted: DataFrame, tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """statistics.document_counts of the wanted (document_id, lemma_id) alone, and of some others: of a document's words, those of its wanted lemmas count."""
    lemmas = candidates_of(parses).select("language_code", "form", "lemma_id", "n_lemmas").distinct()
    pairs = checkpointed(wanted.distinct().join(lemmas.select("lemma_id", "language_code", "form"), "lemma_id").select("document_id", "language_code", "form"))
    rows = sieve_of(pairs).marked(forms_of(tokens), "_known", F.col("document_id"), F.col("language_code"), F.col("form"))
    return document_counts(rows.where("_known").drop("_known"), parses)


def sieved(rows: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The rows that may have one of the wanted keys (a stored table of these columns)."""
    return sieve_of(wanted.select(*keys)).marked(rows, "_known", *(F.col(c) for c in keys)).where("_known").drop("_known")
