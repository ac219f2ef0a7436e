"""Disambiguation: three scores for a request's candidate parses, and the winner.

Candidates of a request are few, so they are gathered into one array per
request: features are compared inside it, without a window per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import fold_key
from lexispark.schemas import FEATURES


def exclusive(candidates: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """candidates (request_id, id, language_code, features) with exclusive_key.

    A feature is exclusive unless every candidate of the request has its value;
    where none is, all the parse's features stand in.
    """
    row = F.struct("id", "language_code", *features)
    groups = candidates.groupBy("request_id").agg(F.collect_list(row).alias("all"))

    def differs(x: Column, c: str) -> Callable[[Column], Column]:
        return lambda y: ~y[c].eqNullSafe(x[c])

    def own(x: Column) -> Column:
        kept = [F.when(F.exists("all", differs(x, c)), x[c]) for c in features]
        return F.when(F.coalesce(*kept).isNull(), F.concat_ws("", *(x[c] for c in features))).otherwise(F.concat_ws("", *kept))

    keyed = F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["language_code"].alias("language_code"), own(x).alias("exclusive_key")))
    return groups.select("request_id", F.inline(keyed))


def form_scores(candidates: DataFrame, morph: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """request_id, id, form_score: how often the parse's exclusive features occur."""
    counts = morph.select("language_code", F.col("feature_key").alias("exclusive_key"), "count")
    return exclusive(candidates, features).join(counts, ["language_code", "exclusive_key"], "left").select("request_id", "id", F.coalesce("count", F.lit(0.0)).alias("form_score"))


def prior_scores(candidates: DataFrame, before: DataFrame, prior: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """request_id, id, prior_score: how often the parse's features follow any of the previous word's.

    before: candidates of the previous word; requests without any get no row.
    """
    keys = [F.col(c) for c in features]
    was = before.select("request_id", fold_key(*keys).alias("previous_feature_key")).distinct()
    now = candidates.select("request_id", "id", "language_code", fold_key(*keys).alias("current_feature_key"))
    counts = prior.select("language_code", "previous_feature_key", "current_feature_key", "count")
    found = now.join(was, "request_id").join(counts, ["language_code", "previous_feature_key", "current_feature_key"], "left")
    return found.groupBy("request_id", "id").agg(F.coalesce(F.sum("count"), F.lit(0.0)).alias("prior_score"))


def word_scores(candidates: DataFrame) -> DataFrame:
    """request_id, id, word_score: the lemma's document_frequency, where a request has two lemmas or more."""
    several = candidates.groupBy("request_id").agg(F.countDistinct("lemma_id").alias("n")).where("n > 1").select("request_id")
    return candidates.join(several, "request_id").select("request_id", "id", F.coalesce("document_frequency", F.lit(0.0)).alias("word_score"))


def winners(candidates: DataFrame, *scores: DataFrame) -> DataFrame:
    """candidates (request_id, id, lemma_id) with average and is_winner.

    Each score is divided by its sum over the request (all zero if that is
    zero); the mean over the scores that a request has decides; ties go to the
    lemma and then the parse that comes first.
    """
    request = Window.partitionBy("request_id")
    out = candidates.select("request_id", "id", "lemma_id")
    parts = []
    for rows in scores:
        name = rows.columns[-1]
        out = out.join(rows, ["request_id", "id"], "left")
        total = F.sum(name).over(request)
        parts.append(F.when(F.col(name).isNotNull(), F.when(total == 0, 0.0).otherwise(F.col(name) / total)))
    held = [F.when(p.isNotNull(), 1).otherwise(0) for p in parts]
    total, count = F.lit(0.0), F.lit(0)
    for p, h in zip(parts, held, strict=True):
        total, count = total + F.coalesce(p, F.lit(0.0)), count + h
    out = out.withColumn("average", F.round(total / count, 12)).withColumn("lemma_rank", F.min("id").over(Window.partitionBy("request_id", "lemma_id")))
    first = F.row_number().over(request.orderBy(F.desc_nulls_last("average"), "lemma_rank", "id"))
    return out.select("request_id", "id", "lemma_id", "average", (first == 1).alias("is_winner"))


def respond(requests: DataFrame, candidates: DataFrame, won: DataFrame, lemmas: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """request_id, word, language_code, lemmas: the nested response of every request, empty if nothing matched.

    lemmas: lemma_id, headword, sequence_number, senses, entries, short_definition.
    """
    shown = [c for c in ("form", "expanded_form", *features) if c in candidates.columns]
    rows = candidates.join(won.select("request_id", "id", "is_winner"), ["request_id", "id"])
    parse = F.struct("id", F.struct(*shown, "is_winner").alias("parse"))
    per = rows.groupBy("request_id", "lemma_id").agg(F.array_sort(F.collect_list(parse)).alias("parses"), F.min("document_frequency").alias("document_frequency"))
    lemma = F.struct(
        F.col("parses")[0]["id"].alias("order"),
        F.struct("headword", "sequence_number", F.transform("parses", lambda p: p["parse"]).alias("parses"), "senses", "entries", "document_frequency", "short_definition").alias("lemma"),
    )
    nested = _nested(per.join(lemmas, "lemma_id"), lemma)
    out = requests.select("request_id", "word", "language_code").join(nested, "request_id", "left")
    return out.withColumn("lemmas", F.coalesce("lemmas", F.array().cast(out.schema["lemmas"].dataType)))


def _nested(rows: DataFrame, lemma: Column) -> DataFrame:
    """Lemmas of a request in the order of their first parse."""
    got = rows.groupBy("request_id").agg(F.collect_list(lemma).alias("all"))
    ordered = F.array_sort("all", lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    return got.select("request_id", F.transform(ordered, lambda x: x["lemma"]).alias("lemmas"))
