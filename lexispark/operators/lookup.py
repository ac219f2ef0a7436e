"""Batch look-up of inflected words: tiered matching against the lexicon, one equi-join for all tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import bare_form, beta_code_to_greek, lexicon_key, normalize_unicode, query_form
from lexispark.schemas import LEXICA, SHORT_DEFINITIONS


#: The columns in which a word is looked for, from the first tier on, and what is looked for in each.
WAYS = (("form", query_form), ("bare_form", lambda _, c: bare_form(c)), ("form_normalized", lambda _, c: normalize_unicode(c)))


def _bits(value: Column, spelled_so: Sequence[Column]) -> Column:
    """A bit for each of the columns that equals the value."""
    out = F.lit(0)
    for k, c in enumerate(spelled_so):
        out = out + F.when(c.eqNullSafe(value), 1 << k).otherwise(0)
    return out


def words_of(requests: DataFrame, *columns: str) -> DataFrame:
    """(language_code, word): the different words of some of the requests' columns."""
    words = F.array_compact(F.array(*(F.col(c) for c in columns)))
    return requests.select("language_code", F.explode(words).alias("word")).distinct()


def probes(words: DataFrame) -> DataFrame:
    """(language_code, word, base, value, ways): what is looked for, and in which columns.

    Tiers 1 to 3 look for the word's lower-case form, its bare form and its form
    without accents; for Greek, tiers 4 to 6 do so for its Beta Code conversion
    where that changes it.  Spellings that are the same are one row.
    """
    words = words.withColumn("greek", F.when(F.col("language_code") == "grc", beta_code_to_greek(F.col("word"))))
    both = F.array(F.struct(F.lit(0).alias("base"), F.col("word").alias("spelling")), F.struct(F.lit(3).alias("base"), F.col("greek").alias("spelling")))
    words = words.select("language_code", "word", F.inline(both)).where("base = 0 or (spelling is not null and spelling != word)")
    tiers = [f"tier{k}" for k in range(len(WAYS))]
    words = words.select("language_code", "word", "base", *(of(F.col("language_code"), F.col("spelling")).alias(t) for t, (_, of) in zip(tiers, WAYS, strict=True)))
    words = words.withColumn("value", F.explode(F.array_distinct(F.array(*tiers))))
    return words.select("language_code", "word", "base", "value", _bits(F.col("value"), [F.col(t) for t in tiers]).alias("ways"))


def spelled(parses: DataFrame) -> DataFrame:
    """parses under each of their different spellings (value), with ways: the columns spelled so."""
    columns = [F.col(c) for c, _ in WAYS]
    rows = parses.withColumn("value", F.explode(F.array_distinct(F.array(*columns)))).where("value is not null")
    return rows.select("value", _bits(F.col("value"), columns).alias("ways"), *parses.columns)


def matches(probed: DataFrame, index: DataFrame) -> DataFrame:
    """(language_code, word, tier, parses' columns): a word's candidates from its first tier that has any.

    An index without language_code is of the one language that is probed for.
    """
    met = F.col("sought").bitwiseAND(F.col("ways"))
    found = probed.withColumnRenamed("ways", "sought").join(index, [c for c in ("language_code", "value") if c in index.columns]).withColumn("met", met).where("met != 0")
    tier = F.col("base") + F.when(F.col("met").bitwiseAND(F.lit(1)) != 0, 1).when(F.col("met").bitwiseAND(F.lit(2)) != 0, 2).otherwise(3)
    found = found.withColumn("tier", tier).drop("base", "sought", "ways", "met", "value")
    return found.withColumn("first", F.min("tier").over(Window.partitionBy("language_code", "word"))).where("tier = first").drop("first")


def of_requests(requests: DataFrame, matched: DataFrame, word: str = "word") -> DataFrame:
    """request_id, tier and parses' columns: every request's candidates."""
    return requests.select("request_id", "language_code", F.col(word).alias("word")).join(matched, ["language_code", "word"]).drop("word")


def lookup(requests: DataFrame, parses: DataFrame, word: str = "word") -> DataFrame:
    """request_id, tier and parses' columns: every request's candidates from its first tier that has any."""
    return of_requests(requests, matches(probes(words_of(requests, word)), spelled(parses)), word)


def document_frequency(candidates: DataFrame, requests: DataFrame, frequencies: DataFrame) -> DataFrame:
    """candidates with document_id and their lemma's document_frequency (null without document or row)."""
    return with_frequency(with_documents(candidates, requests), frequencies)


def with_documents(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """candidates with their request's document_id; an empty one is none."""
    return candidates.join(requests.select("request_id", F.nullif("document_id", F.lit("")).alias("document_id")), "request_id", "left")


def with_frequency(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """candidates (with document_id) and their lemma's document_frequency."""
    rows = frequencies.select("document_id", "lemma_id", F.col("weighted_frequency").alias("document_frequency"))
    return candidates.join(rows, ["document_id", "lemma_id"], "left")


def registry(like: DataFrame) -> DataFrame:
    """(language_code, document_id, is_short) of the known lexica: a handful of rows."""
    rows = [(lang, lexicon, SHORT_DEFINITIONS.get(lang) == lexicon) for lang, names in LEXICA.items() for lexicon in names]
    return like.sparkSession.createDataFrame(rows, "language_code string, document_id string, is_short boolean")


def attached(lemmas: DataFrame, senses: DataFrame, entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """lemmas (language_code, headword, sequence_number, ...) with arrays of senses and entries, and short_definition.

    Only lexica of the lemma's language count; arrays follow the order of ids
    and of (lexicon, key); the short definition is the first sense of the
    language's short lexicon.  Where there are none, the arrays are empty.
    """
    known = registry(lemmas) if known is None else known
    keyed = lemmas.withColumn("lexicon_key", lexicon_key(F.col("headword"), F.col("sequence_number")))
    wanted = keyed.select("language_code", "lexicon_key").distinct()
    sense = senses.join(F.broadcast(known), "document_id").withColumn("lexicon_key", F.expr("substring(lemma, length('entry=') + 1)")).where("startswith(lemma, 'entry=')")
    sense = sense.join(wanted, ["language_code", "lexicon_key"], "left_semi")
    row = F.struct("id", "document_id", "sense", F.nullif("level", F.lit(-1)).alias("level"), "definition")
    sense = sense.groupBy("language_code", "lexicon_key").agg(F.array_sort(F.collect_list(row)).alias("senses"), F.min_by("definition", F.when(F.col("is_short"), F.col("id"))).alias("short_definition"))
    entry = entries.withColumnRenamed("key", "lexicon_key").join(F.broadcast(known), "document_id").join(wanted, ["language_code", "lexicon_key"], "left_semi")
    entry = entry.groupBy("language_code", "lexicon_key").agg(F.array_sort(F.collect_list(F.struct("document_id", "text"))).alias("entries"))
    out = keyed.join(sense, ["language_code", "lexicon_key"], "left").join(entry, ["language_code", "lexicon_key"], "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("senses", "entries")})
