"""A lexicon, lexica and requests derived from the documents table, so that every operator has whole-table inputs.

Forms are the documents' words of three letters or more; suffix rules give
their parses.  Ids are natural keys as text, so no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import bare_form, fold_key, load_form, normalize_unicode
from lexispark.operators import statistics

FEATURES = ("grammatical_case", "number", "part_of_speech", "tense")
# Suffix, part of speech, number, tense, case of the derived lexicon.
RULES = (
    ("s", "noun", "plural", None, None),
    ("s", "verb", "singular", "present", None),
    ("s", "noun", "singular", None, "genitive"),
    ("ed", "verb", None, "past", None),
    ("ed", "adj", None, None, None),
    ("tion", "noun", "singular", None, "nominative"),
    ("ing", "verb", None, "present", None),
    ("ing", "noun", "singular", None, None),
    ("er", "adj", None, None, None),
    ("en", "verb", None, "past", None),
    ("e", "noun", "singular", None, "nominative"),
    ("re", "verb", None, "present", None),
    ("th", "verb", "singular", "present", None),
    ("at", "part", None, None, None),
)
LEXICA = (("short", True), ("full", False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    if docs.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        docs = docs.repartition(cores)  # a small file is one split; splitting words is the longer work
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("language_code"), "text").where("language_code is not null and text is not null")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.tokens_of(documents(spark, sf_dir))


def parses_of(words: DataFrame) -> DataFrame:
    """Parses of the forms of tokens, by the suffix rules (a broadcast of fourteen rows)."""
    spark = words.sparkSession
    rules = spark.createDataFrame(RULES, "suffix string, part_of_speech string, number string, tense string, grammatical_case string")
    forms = statistics.forms_of(words).select("language_code", "form").distinct().where(F.char_length("form") >= 3)
    sizes = sorted({len(r[0]) for r in RULES})
    ends = F.array(*(F.substring(F.col("form"), -n, n) for n in sizes))
    cut = forms.withColumn("suffix", F.explode(F.array_distinct(ends))).where(F.char_length("form") > F.char_length("suffix"))
    out = cut.join(F.broadcast(rules), "suffix").withColumn("headword", F.expr("substring(form, 1, char_length(form) - char_length(suffix))"))
    out = out.withColumn("dedup_key", fold_key(*(F.col(c) for c in FEATURES))).withColumn("lemma_id", F.concat_ws(":", "language_code", "headword"))
    out = out.withColumn("id", F.concat_ws("|", "language_code", "headword", "form", "dedup_key")).withColumn("bare_form", bare_form(F.col("form"))).withColumn("form_normalized", normalize_unicode(F.col("form")))
    return out.select("id", "lemma_id", "language_code", "headword", "form", "bare_form", "form_normalized", *FEATURES, "dedup_key")


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parses_of(tokens(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(tokens(spark, sf_dir))


def firsts_of(words: DataFrame) -> DataFrame:
    """(language_code, token, at): every distinct form, and where it first occurs, after which word."""
    rows = statistics.forms_of(statistics.chained(words))
    # The word before goes to lower case once a form; forms come first among the keys, as rows are sorted by them.
    first = rows.groupBy("form", "language_code").agg(F.min(F.struct(F.col("document_id").cast("long").alias("d"), "pos", "before")).alias("at"))
    return first.select("language_code", F.col("form").alias("token"), "at")


def requests_of(words: DataFrame) -> DataFrame:
    """One request a distinct form: where it first occurs, after which word; spelled as is, elided, in capitals or without accents."""
    return requests_of_firsts(firsts_of(words))


def requests_of_firsts(firsts: DataFrame) -> DataFrame:
    first = firsts.select("language_code", F.col("token").alias("form"), F.struct(F.col("at.d").cast("string").alias("document_id"), load_form(F.col("language_code"), F.col("at.before")).alias("prior_word")).alias("at"))
    kind = F.char_length("form") % 4
    word = F.when(kind == 1, F.concat(F.lit("'"), "form")).when(kind == 2, F.translate("form", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(kind == 3, normalize_unicode(F.col("form"))).otherwise(F.col("form"))
    return first.select(F.concat_ws(":", "language_code", "form").alias("request_id"), "language_code", word.alias("word"), F.col("at.document_id").alias("document_id"), F.col("at.prior_word").alias("prior_word"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, f"{name}-{lang}", short) for lang in ("en", "fr", "de", "es") for name, short in LEXICA], "language_code string, document_id string, is_short boolean")


def lemmas(found: DataFrame) -> DataFrame:
    return found.select("lemma_id", "language_code", "headword", F.lit(-1).alias("sequence_number")).distinct()


def senses(found: DataFrame) -> DataFrame:
    """Every lemma's short definition, and a fuller one for headwords of five letters or more."""
    rows = lemmas(found)
    short = rows.select(F.concat(F.lit("short-"), "language_code").alias("document_id"), "headword", F.concat(F.lit("see "), "headword").alias("definition"), F.lit(-1).alias("level"))
    full = rows.where(F.char_length("headword") >= 5).select(F.concat(F.lit("full-"), "language_code"), "headword", F.reverse("headword"), F.lit(1))
    return short.union(full).select(F.concat_ws("|", "document_id", "headword").alias("id"), "document_id", F.concat(F.lit("entry="), "headword").alias("lemma"), F.lit(None).cast("string").alias("sense"), "level", "definition")


def entries(found: DataFrame) -> DataFrame:
    rows = lemmas(found).where(F.char_length("headword") >= 5)
    return rows.select(F.concat(F.lit("full-"), "language_code").alias("document_id"), F.col("headword").alias("key"), F.concat(F.lit("<orth>"), "headword", F.lit("</orth>")).alias("text"))
