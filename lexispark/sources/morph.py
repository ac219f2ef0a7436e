"""Morph records: JSON lines (and the XML they come from) to lemmas and parses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import bare_form, beta_code_to_greek, canonical_language, fold_key, lemma_parts, load_form, normalize_unicode
from lexispark.operators.ordering import first_wins, numbered
from lexispark.operators.store import checkpointed, observed
from lexispark.schemas import FEATURE_TAGS, LANGUAGES, MORPH_RECORD


def language_of_file(path: str) -> str:
    """The code of the language in a file's name, up to its first stop."""
    from lexispark.schemas import LANGUAGE_CODES

    base = path.rsplit("/", 1)[-1].split(".", 1)[0]
    return LANGUAGE_CODES.get(base, base)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, file): a text's lines with what orders them: file, split of the file, place among the split's lines."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return spark.read.text(path).select(place.alias("line"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))


def _decoded(spark: SparkSession, path: str, language: str | None) -> DataFrame:
    rows = lines(spark, path).where("trim(text) != ''")
    code = F.lit(language) if language else canonical_language(F.substring_index("file", ".", 1))
    return rows.select("line", code.alias("language_code"), F.from_json("text", MORPH_RECORD, {"mode": "FAILFAST"}).alias("r")).select("line", "language_code", "r.*")


COMPLETE = "form is not null and lemma is not null"


def records(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """MORPH_RECORD columns with line and language_code; malformed JSON fails, blank lines and records without form or lemma are left out."""
    return _decoded(spark, path, language).where(COMPLETE)


def analyses(spark: SparkSession, path: str, language: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """records() as a written table, and the number of all records and of those with form and lemma."""
    found, told = observed(_decoded(spark, path, language), records=F.count(F.lit(1)), complete=F.count_if(F.expr(COMPLETE)))
    return found.where(COMPLETE), told


def convert_xml(spark: SparkSession, path: str, out: str, greek: bool) -> None:
    """Write an XML file's analyses as JSON lines, a folder of them; nulls are left out."""
    from_xml(spark, path, greek).select(F.to_json(F.struct(*MORPH_RECORD.names)).alias("value")).write.text(out)


def from_xml(spark: SparkSession, path: str, greek: bool) -> DataFrame:
    """Records of an XML file's analysis elements: the text of each child under its tag.

    The last of a repeated tag counts, an empty element is null; Greek forms and
    lemmas leave Beta Code.
    """
    rows = spark.read.format("xml").option("rowTag", "analysis").schema(MORPH_RECORD).load(path)
    rows = rows.select(*(F.nullif(F.col(c), F.lit("")).alias(c) for c in MORPH_RECORD.names))
    return rows.withColumns({c: beta_code_to_greek(F.col(c)) for c in ("form", "lemma")}) if greek else rows


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lemmas, parses) of records: ids by first appearance; of parses with one key, the first stays."""
    unknown = found.select("language_code").distinct().where(~F.col("language_code").isin(*LANGUAGES)).first()
    if unknown:
        raise ValueError(f"unknown language {unknown.language_code!r}")
    lang = F.col("language_code")
    rows = found.select("line", lang, lemma_parts(F.col("lemma")).alias("p"), load_form(lang, F.col("form")).alias("form"), "orth", *(F.col(t).alias(c) for t, c in FEATURE_TAGS.items()))
    rows = rows.select("line", lang, "p.*", "form", "orth", *FEATURE_TAGS.values())
    natural = ["headword", "sequence_number", "language_code"]
    ids = numbered(rows.groupBy(*natural).agg(F.min("line").alias("line")), ["line", *natural])
    head = F.col("headword")
    lemmas = checkpointed(ids.select("id", head, normalize_unicode(head).alias("headword_normalized"), bare_form(head).alias("bare_headword"), F.col("sequence_number").cast("int").alias("sequence_number"), "language_code"))
    rows = rows.join(lemmas.select(F.col("id").alias("lemma_id"), *natural), natural).withColumn("dedup_key", fold_key())
    rows = numbered(first_wins(rows, ["lemma_id", "form", "dedup_key"], "line"), ["line"])
    form = F.col("form")
    parses = rows.select("id", "lemma_id", "form", normalize_unicode(form).alias("form_normalized"), F.coalesce("orth", form).alias("expanded_form"), bare_form(form).alias("bare_form"), *sorted(FEATURE_TAGS.values()), "dedup_key", "language_code")
    return lemmas, checkpointed(parses)
