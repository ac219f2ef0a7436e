"""Corpus statistics: counts of features, feature pairs and lemmas, with fractional weights.

A token's weight is divided among its candidate parses, and every subset of a
parse's features counts.  All three statistics are linear in token counts, so
tokens are counted first and expanded last: the power set is taken of distinct
feature vectors, never of tokens, and frequent words cost one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.powerset import present, subsets
from lexispark.functions.text import fold_key, load_form
from lexispark.schemas import FEATURES


def words_of(text: Column) -> Column:
    """Runs of letters and marks."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+)"), 1)


def tokens_of(texts: DataFrame) -> DataFrame:
    """(document_id, language_code, text) -> TOKENS rows.

    A row is a chain of its own, also beside others of its document_id (files of
    one name, say), unless the rows are PARTS: parts of one file go on from each
    other, by their seams.
    """
    rows = texts.select("document_id", "language_code", words_of(F.col("text")).alias("words"))
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), "words"), 1, F.greatest(F.size("words"), F.lit(0)))
    rows = rows.select("document_id", "language_code", F.posexplode(F.arrays_zip(F.col("words").alias("token"), before.alias("before"))).alias("pos", "word"))
    rows = rows.select("document_id", "language_code", F.col("pos").cast("long").alias("pos"), "word.token", "word.before")
    return rows.unionByName(seams_of(ends_of(texts))) if "seq" in texts.columns else rows


def ends_of(parts: DataFrame) -> DataFrame:
    """The first and last word of every part of a file."""
    words = words_of(F.col("text"))
    return parts.where("file is not null").select("document_id", "language_code", "file", "seq", F.get(words, 0).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"))


def seams_of(ends: DataFrame) -> DataFrame:
    """TOKENS rows of the pairs across parts; parts without words are passed over."""
    w = Window.partitionBy("document_id", "file", "language_code").orderBy("seq")
    rows = ends.where("first is not null").withColumn("before", F.lag("last").over(w)).where("before is not null")
    return rows.select("document_id", "language_code", F.lit(None).cast("long").alias("pos"), F.col("first").alias("token"), "before")


def chained(tokens: DataFrame) -> DataFrame:
    """tokens with before, where they come without: every document one chain, in the order of pos."""
    if "before" in tokens.columns:
        return tokens
    return tokens.withColumn("before", F.lag("token").over(Window.partitionBy("document_id", "language_code").orderBy("pos")))


def forms_of(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("form", load_form(F.col("language_code"), F.col("token")))


def candidates_of(parses: DataFrame) -> DataFrame:
    """parses with n_parses and n_lemmas of their form; stored ones have them already."""
    if {"n_parses", "n_lemmas"} <= {*parses.columns}:
        return parses
    w = Window.partitionBy("language_code", "form")
    return parses.withColumn("n_parses", F.count(F.lit(1)).over(w)).withColumn("n_lemmas", F.size(F.collect_set("lemma_id").over(w)).cast("long"))


def ambiguity(parses: DataFrame) -> DataFrame:
    return parses.groupBy("language_code", "form").agg(F.count(F.lit(1)).alias("n_parses"), F.countDistinct("lemma_id").alias("n_lemmas"))


def picked(pairs: Column, features: Sequence[str], prefix: str = "") -> list[Column]:
    """A subset's feature columns."""
    as_map = F.map_from_entries(pairs)
    return [as_map[c].alias(prefix + c) for c in features]


def morph_counts(tokens: DataFrame, parses: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """language_code, features, feature_key, count: each candidate parse adds 1 / n to all its feature subsets.

    Subsets with one key are one row, which shows the features of the least of them.
    """
    seen = forms_of(tokens.where("pos is not null")).groupBy("language_code", "form").agg(F.count(F.lit(1)).alias("c"))
    found = seen.join(candidates_of(parses).select("language_code", "form", "n_parses", *features), ["language_code", "form"])
    vectors = found.groupBy("language_code", *features).agg(F.sum(F.col("c") / F.col("n_parses")).alias("weight"))
    rows = subset_rows(vectors, features).withColumn("feature_key", fold_key(*(F.col(c) for c in features)))
    return accumulated(rows.withColumnRenamed("weight", "count"), ["language_code", "feature_key"], list(features), "count")


#: Features that are dropped or kept between two aggregations.
TOGETHER = 4


def subset_rows(vectors: DataFrame, features: Sequence[str], together: int = TOGETHER) -> DataFrame:
    """(language_code, features, weight): all subsets of the vectors' features, some features at a time.

    Between two steps, equal rows are added up: vectors that differ in what was
    dropped go on as one, instead of 2**k rows of each vector at once.
    """
    rows = vectors.select("language_code", *features, "weight")
    for at in range(0, len(features), together):
        some = tuple(features[at : at + together])
        rest = [c for c in rows.columns if c not in some]
        rows = rows.select(*rest, F.explode(subsets(present(some))).alias("subset")).select(*rest, *picked(F.col("subset"), some))
        if at + together < len(features):
            rows = rows.groupBy("language_code", *features).agg(F.sum("weight").alias("weight"))
    return rows


def prior_counts(tokens: DataFrame, parses: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Every pair of a candidate of the previous token and one of this adds 1 / n of this token's candidates.

    Tokens without candidates break the chain; texts start afresh.
    """
    pairs = forms_of(chained(tokens).where("before is not null")).select("language_code", load_form(F.col("language_code"), F.col("before")).alias("before"), "form")
    pairs = pairs.groupBy("before", "form", "language_code").agg(F.count(F.lit(1)).alias("c"))
    key = fold_key(*(F.col(c) for c in features))
    known = candidates_of(parses).select("language_code", "form", "n_parses", key.alias("key"))
    # Of a word's parses, those with one key count together.
    now = known.groupBy("language_code", "form", F.col("key").alias("current_feature_key")).agg(F.sum(F.lit(1.0) / F.col("n_parses")).alias("share"))
    was = known.groupBy("language_code", F.col("form").alias("before"), F.col("key").alias("previous_feature_key")).agg(F.count(F.lit(1)).alias("times"))
    # Of the words before, only those that are met by a key go on, each once a key.
    met = pairs.join(now, ["language_code", "form"]).groupBy("before", "language_code", "current_feature_key").agg(F.sum(F.col("c") * F.col("share")).alias("weight"))
    rows = met.join(was, ["language_code", "before"]).withColumn("count", F.col("weight") * F.col("times"))
    return accumulated(rows, ["language_code", "previous_feature_key", "current_feature_key"], [], "count")


def with_features(counts: DataFrame, parses: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Counts of pairs of keys with the features of both: of those that fold to a key, the least."""
    least = parses.select("language_code", *features).distinct().groupBy("language_code", fold_key(*(F.col(c) for c in features)).alias("key")).agg(F.min(F.struct(*features)).alias("least"))
    out = counts
    for side in ("previous", "current"):
        out = out.join(least.select("language_code", F.col("key").alias(f"{side}_feature_key"), *(F.col(f"least.{c}").alias(f"{side}_{c}") for c in features)), ["language_code", f"{side}_feature_key"])
    return out


def document_counts(tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """document_id, language_code, lemma_id, weighted_frequency: each candidate lemma of a token gets an equal part of it."""
    seen = forms_of(tokens.where("pos is not null")).groupBy("document_id", "form", "language_code").agg(F.count(F.lit(1)).alias("c"))
    lemmas = candidates_of(parses).select("language_code", "form", "lemma_id", "n_lemmas").distinct()
    rows = seen.join(lemmas, ["language_code", "form"])
    return rows.groupBy("document_id", "language_code", "lemma_id").agg(F.sum(F.col("c") / F.col("n_lemmas")).alias("weighted_frequency"))


def accumulated(rows: DataFrame, keys: Sequence[str], shown: Sequence[str], count: str) -> DataFrame:
    """One row a key: the sum of its counts, and the least of its shown columns."""
    least = F.min(F.struct(*shown)).alias("_least")
    out = rows.groupBy(*keys).agg(least, F.sum(count).alias(count)) if shown else rows.groupBy(*keys).agg(F.sum(count).alias(count))
    return out.select(*keys, *(F.col(f"_least.{c}").alias(c) for c in shown), count)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """old with new's counts added; rows of either alone stay.  Applied twice, it counts twice."""
    shown = [c for c in old.columns if c not in {*keys, count}]
    return accumulated(old.unionByName(new), keys, shown, count).select(*old.columns)
