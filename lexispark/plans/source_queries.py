"""Queries over the sources, the store and the engine: their inputs are files and tables made from all documents.

The derived lexicon is written in each source's own format into the shared
folder, read back by the source, and compared row by row with what went in.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import lookup, ordering, scoring, sieve, statistics
from lexispark.operators.store import checkpointed, cleaned, forgotten, shared_folder, temporary
from lexispark.plans import derived as D
from lexispark.plans.engine import Engine
from lexispark.plans.queries import ALL, BIGRAMS, DOCUMENT, EXCLUSIVE, LEXICON, MORPH, PRIOR, REQUESTS, SCORES, TOKENS, _tiers, query
from lexispark.schemas import FEATURES, LANGUAGES
from lexispark.sources import lexica, morph, tei, tei_elements, tei_lexicon
from lexispark.streaming.corpus import follow

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Beta Code's letters beside Greek ones, for forms of plain Latin letters.
BETA = "abgdezhqiklmncoprstufxyw"
GREEK, GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_lines(rows: DataFrame, line: Column, *order: str) -> str:
    """Write a line for each row, in order; returns the folder."""
    at = new_folder(rows.sparkSession, "lines")
    with cleaned(rows.sparkSession):
        rows.orderBy(*order).select(line.alias("value")).write.text(at)
    return at


def capital(c: Column) -> Column:
    """The first letter, if it is one of a-z, in upper case."""
    return F.concat(F.translate(F.substring(c, 1, 1), LOWER, UPPER), F.expr("substring(form, 2)"))


CAPITAL = f"translate(substr(form, 1, 1), '{LOWER}', '{UPPER}') || substr(form, 2)"


def records(found: DataFrame) -> Column:
    """The JSON record of a derived parse: capitals in some forms, an orthography and a homonym's number for some."""
    form = F.when(F.char_length("form") % 2 == 0, capital(F.col("form"))).otherwise(F.col("form"))
    lemma = F.concat("headword", F.when(F.char_length("headword") % 3 == 0, "2").otherwise(""))
    orth = F.when(F.char_length("form") % 4 == 1, F.concat("form", F.lit("-")))
    tags = {"pos": "part_of_speech", "number": "number", "tense": "tense", "case": "grammatical_case"}
    return F.to_json(F.struct(form.alias("form"), lemma.alias("lemma"), orth.alias("orth"), *(F.col(c).alias(t) for t, c in tags.items())))


def record_folder(spark: SparkSession, sf_dir: str) -> str:
    """All derived parses as JSON lines, with a record without a lemma after each noun."""
    found = D.parses(spark, sf_dir)
    lines = found.select("id", F.lit(0).alias("k"), records(found).alias("line"))
    lacking = found.where("part_of_speech = 'noun'").select("id", F.lit(1), F.to_json(F.struct("form")))
    return as_lines(lines.union(lacking), F.col("line"), "id", "k")


LOADED = f"""{LEXICON},
rec AS (SELECT row_number() OVER (ORDER BY id) AS line, lower(CASE WHEN length(form) % 2 = 0 THEN {CAPITAL} ELSE form END) AS loaded, CASE WHEN length(form) % 4 = 1 THEN form || '-' END AS orth,
               headword, CASE WHEN length(headword) % 3 = 0 THEN 2 ELSE -1 END AS sequence_number, part_of_speech, number, tense, grammatical_case, dedup_key FROM lex),
lem AS MATERIALIZED (SELECT headword, sequence_number, row_number() OVER (ORDER BY min(line)) AS lemma_id FROM rec GROUP BY ALL),
par AS MATERIALIZED (SELECT row_number() OVER (ORDER BY line) AS id, * EXCLUDE k FROM (
  SELECT *, row_number() OVER (PARTITION BY headword, sequence_number, loaded, dedup_key ORDER BY line) AS k FROM rec) WHERE k = 1)"""


@query(rf"""
WITH {LOADED} SELECT p.id, lemma_id, p.headword, p.sequence_number, loaded AS form, lower(strip_accents(loaded)) AS form_normalized, coalesce(orth, loaded) AS expanded_form,
  regexp_replace(loaded, '[()\\/*=|+'']', '', 'g') AS bare_form, part_of_speech, number, tense, grammatical_case, dedup_key
FROM par p JOIN lem USING (headword, sequence_number)""")
def load_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of JSON lines: lemmas numbered by first appearance, the first parse of a key, in the order of lines."""
    lemmas, parses = morph.tables(checkpointed(morph.records(spark, record_folder(spark, sf_dir), "lat")))
    out = parses.join(lemmas.select(F.col("id").alias("lemma_id"), "headword", "sequence_number"), "lemma_id")
    return out.select("id", "lemma_id", "headword", "sequence_number", "form", "form_normalized", "expanded_form", "bare_form", "part_of_speech", "number", "tense", "grammatical_case", "dedup_key")


@query(rf"""
WITH {LOADED} SELECT lemma_id AS id, headword, lower(strip_accents(headword)) AS headword_normalized, regexp_replace(headword, '[()\\/*=|+'']', '', 'g') AS bare_headword, sequence_number,
  headword || CASE WHEN sequence_number = -1 THEN '' ELSE CAST(sequence_number AS VARCHAR) END AS lexicon_key FROM lem""")
def load_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas, _ = morph.tables(checkpointed(morph.records(spark, record_folder(spark, sf_dir), "lat")))
    return lemmas.select("id", "headword", "headword_normalized", "bare_headword", "sequence_number", X.lexicon_key(F.col("headword"), F.col("sequence_number")).alias("lexicon_key"))


@query(f"WITH {LEXICON} SELECT form, headword AS lemma, CAST(NULL AS VARCHAR) AS orth, part_of_speech AS pos, number, tense, grammatical_case AS \"case\" FROM lex")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis elements to JSON lines and back: the last of a repeated tag counts, an empty element is null."""
    found = D.parses(spark, sf_dir)
    parts = found.select("form", F.col("headword").alias("lemma"), F.lit("").alias("orth"), F.array(F.lit("unknown"), "part_of_speech").alias("pos"), "number", "tense", F.col("grammatical_case").alias("case"))
    at, out = new_folder(spark, "analyses"), new_folder(spark, "converted")
    parts.write.format("xml").option("rootTag", "analyses").option("rowTag", "analysis").save(at)
    morph.convert_xml(spark, at, out, greek=False)
    return morph.records(spark, out, "lat").select("form", "lemma", "orth", "pos", "number", "tense", "case")


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE t || '  after  end' END AS text FROM d)
SELECT CAST(doc_id AS VARCHAR) AS document_id, length(text) AS n_chars, md5(text) AS text_md5, text IS NULL AS failed, coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}]+')), 0) AS n_tokens FROM x""")
def tei_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a TEI file: what stands in notes and labels goes, each leaving a space at either end; some files are broken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.regexp_replace("text", "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", "").alias("body"))
    body = F.replace(F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><p>'), body, F.lit("</p><note>hidden <bibl>twice</bibl> so</note>after<label>gone</label>end</body></text>"), F.when(F.col("doc_id") % 50 == 7, "").otherwise("</TEI>"))
    # A note in a note leaves spaces of its own, so those are made one pair.
    rows = tei.extracted(docs.select(F.col("doc_id").cast("string").alias("document_id"), xml.alias("content")), "content").drop("content")
    text = F.regexp_replace("text", " {4}after", "  after")
    words = statistics.tokens_of(rows.where("error is null").select("document_id", F.lit("lat").alias("language_code"), "text")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    out = rows.select("document_id", F.char_length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"), F.col("error").isNotNull().alias("failed"))
    return out.join(words, "document_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long"))


@query(r"""
WITH n AS (SELECT doc_id, source || '.' || doc_id || CASE doc_id % 5 WHEN 0 THEN '-grc2' WHEN 1 THEN '-lat' WHEN 2 THEN '-eng1' WHEN 3 THEN '-grc1.old' ELSE '-lat10' END || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.xml' END AS name FROM documents)
SELECT name, CASE WHEN ends_with(name, '.xml') THEN left(name, length(name) - 4) ELSE name END AS document_id, regexp_extract(name, '-([a-z]{2,3})\d*\.xml$', 1) AS language_code,
       regexp_extract(name, '-([a-z]{2,3})\d*\.xml$', 1) IN ('grc', 'lat') AS counts FROM n""")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a corpus count, their documents' ids and languages."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("-grc2", "-lat", "-eng1", "-grc1.old", "-lat10"))), (i % 5 + 1).cast("int"))
    name = F.concat("source", F.lit("."), i.cast("string"), kind, F.when(i % 7 == 0, ".txt").otherwise(".xml"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(name.alias("name"))
    return rows.select("name", *tei.file_columns(F.col("name")))


_ENTRY = "'<orth xml:lang=\"la\">' || headword || '</orth><sense id=\"n' || length(headword) || '.1\" level=\"1\" n=\"A\">to <tr rend=\"x\">' || headword || '</tr>, <cit a=\"&lt;\" n=\"b\"><bibl>x &amp; y</bibl></cit><sense n=\"a\" xml:id=\"n3.3\">in</sense></sense><sense id=\"bad\" level=\"2\"></sense>'"


_TEI_ENTRY = '<entryFree key="%s">\n <orth xml:lang="la">%s</orth><sense n="A" level="1" id="n%d.1">to &mdash;<tr rend="x">%s</tr>, <cit n="b" a="&lt;"><bibl>x &amp; y</bibl></cit><sense xml:id="n3.3" n="a">in</sense></sense>\n<sense level="2" id="bad"/></entryFree>'


@query(f"""
WITH {LEXICON}, l AS (SELECT DISTINCT lemma_id, headword FROM lex)
SELECT lemma_id, 'entry' AS kind, -1 AS ordinal, '-1' AS entry_id, '-1' AS sense_id, CAST(NULL AS VARCHAR) AS sense, -1 AS level, {_ENTRY} AS text FROM l
UNION ALL SELECT lemma_id, 'sense', 0, CAST(length(headword) AS VARCHAR), '1', 'A', 1, 'to <g>' || headword || '</g>, <cit a="&lt;" n="b"><bibl>x &amp; y</bibl></cit>' FROM l
UNION ALL SELECT lemma_id, 'sense', 1, '-1', '-1', 'a', -1, 'in' FROM l
UNION ALL SELECT lemma_id, 'sense', 2, '-1', '-1', NULL, 2, '[no specified meaning]' FROM l""")
def lexicon_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TEI file for every lemma: its senses, nested and empty ones too, and its entry, as they are stored."""
    rows = D.lemmas(D.parses(spark, sf_dir))
    xml = F.format_string(
        f'<!DOCTYPE TEI SYSTEM "unread.dtd"><TEI><body>{_TEI_ENTRY}</body></TEI>', "headword", "headword", F.char_length("headword"), "headword",
    )
    out = tei_lexicon.lexicon_of(rows.select(F.col("lemma_id").alias("file"), xml.cast("binary").alias("content")), lexica.tag_of("some:text:1999.04.0057"))
    ids = X.sense_ids(F.col("xml_id"))
    return out.select(F.col("file").alias("lemma_id"), "kind", F.col("ordinal").cast("int").alias("ordinal"), ids["entry_id"].alias("entry_id"), ids["sense_id"].alias("sense_id"), "sense", X.stored_level(F.col("level")).alias("level"), "text")


def as_lexicon(entries: DataFrame) -> str:
    """Write entries as TEI documents under a declaration, one for each partition; returns the folder."""

    def whole(batches):
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE TEI SYSTEM "unread.dtd" [ <!ENTITY a "b > c"> ]>\n<TEI><body>']})
        yield from batches
        yield pd.DataFrame({"value": ["</body></TEI>"]})

    at = new_folder(entries.sparkSession, "lexicon")
    entries.mapInPandas(whole, "value string").write.text(at)
    return at


@query(f"""
WITH {LEXICON}, l AS (SELECT DISTINCT headword FROM lex)
SELECT headword AS key, 'entry' AS kind, '-1' AS entry_id, CAST(NULL AS VARCHAR) AS sense, -1 AS level, {_ENTRY} AS text FROM l
UNION ALL SELECT headword, 'sense', CAST(length(headword) AS VARCHAR), 'A', 1, 'to <g>' || headword || '</g>, <cit a="&lt;" n="b"><bibl>x &amp; y</bibl></cit>' FROM l
UNION ALL SELECT headword, 'sense', '-1', 'a', -1, 'in' FROM l UNION ALL SELECT headword, 'sense', '-1', NULL, 2, '[no specified meaning]' FROM l""")
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEI files of many lemmas each, under a declaration and with comments that look like entries; they are read in splits."""
    heads = D.parses(spark, sf_dir).select("headword").distinct()
    entries = heads.select(F.format_string(f"<!-- <entry> a > b -->{_TEI_ENTRY}", "headword", "headword", F.char_length("headword"), "headword").alias("value"))
    at = as_lexicon(entries)
    out = tei_lexicon.lexicon(spark, [at], "g")
    return out.select("key", "kind", X.sense_ids(F.col("xml_id"))["entry_id"].alias("entry_id"), "sense", X.stored_level(F.col("level")).alias("level"), "text")


@query(f"""
WITH {LEXICON}, l AS (SELECT DISTINCT headword FROM lex),
k AS (SELECT headword, substr(headword, 1, 3) AS k, row_number() OVER (PARTITION BY substr(headword, 1, 3) ORDER BY headword) AS n FROM l),
e AS (SELECT headword, k || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END AS key FROM k)
SELECT key, 'entry' AS kind, '<orth>' || headword || '</orth><sense id="n1.1">' || headword || '</sense>' AS text FROM e UNION ALL SELECT key, 'sense', headword FROM e""")
def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEI files of all headwords in order, under the first three letters of each: repeats of a key are numbered through all files."""
    heads = D.parses(spark, sf_dir).select("headword").distinct().orderBy("headword")
    xml = F.format_string('<entry key="%s"><orth>%s</orth><sense id="n1.1">%s</sense></entry>', F.substring("headword", 1, 3), "headword", "headword")
    rows = checkpointed(tei_lexicon.lexicon(spark, [as_lexicon(heads.select(xml.alias("value")))], "i"))
    return lexica.numbered_keys(rows).select("key", "kind", "text")


@query(f"""
WITH {LEXICON} SELECT row_number() OVER (ORDER BY headword) AS id, 'entry=' || headword AS lemma, 'of ' || length(headword) || ' letters' AS definition, '-1' AS entry_id, '-1' AS sense_id, CAST(NULL AS INTEGER) AS shown_level
FROM (SELECT DISTINCT headword FROM lex) WHERE length(headword) % 6 <> 5""")
def short_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of headwords and definitions, with a header, blank lines and headwords without a definition, ingested as a lexicon."""
    heads = D.parses(spark, sf_dir).select("headword").distinct()
    n = F.char_length("headword")
    line = F.when(n % 6 == 5, F.concat("headword", F.lit("  "))).otherwise(F.concat(F.lit(" "), "headword", F.lit("\t  of "), n.cast("string"), F.lit(" letters ")))
    lines = heads.select(F.lit(1).alias("k"), "headword", line.alias("line")).union(spark.createDataFrame([(0, "", "Lemma\tDEF"), (0, "a", "")], "k int, headword string, line string"))
    engine = Engine(spark, new_folder(spark, "store"))
    engine.ingest_lexicon("Logeion-Latin-Shortdef", as_lines(lines, F.col("line"), "k", "headword"))
    out = engine.store.read("senses")
    return out.select("id", "lemma", "definition", "entry_id", "sense_id", X.shown_level(F.col("level")).alias("shown_level"))


@query(f"""
WITH {TOKENS}, f AS (SELECT DISTINCT form, translate(regexp_replace(form, '[^{BETA}]', '', 'g'), '{BETA}', '{GREEK}') AS g FROM fm),
c AS (SELECT form, length(form) % 4 AS k, g, translate(substr(g, 1, 1), '{GREEK}', '{GREEK_UPPER}') || substr(g, 2) AS u FROM f)
SELECT form, g AS greek_load, CASE WHEN k = 2 THEN '''' || g ELSE g END AS greek_load_elided, CASE WHEN k = 2 THEN '''' || u ELSE g END AS greek_query,
       lower(CASE k WHEN 0 THEN g WHEN 1 THEN u WHEN 2 THEN '''' || u ELSE '*' || g END) AS latin_load, CASE k WHEN 0 THEN g WHEN 1 THEN u WHEN 2 THEN '''' || u ELSE '*' || g END AS arabic_load FROM c""")
def letter_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case by language, on loading and in requests: Greek words as they are, with a capital, elided, and with a capital sign."""
    forms = statistics.forms_of(D.tokens(spark, sf_dir)).select("form").distinct()
    g = F.translate(F.regexp_replace("form", f"[^{BETA}]", ""), BETA, GREEK)
    rows = forms.withColumn("g", g).withColumn("u", F.concat(F.translate(F.substring("g", 1, 1), GREEK, GREEK_UPPER), F.expr("substring(g, 2)"))).withColumn("k", F.char_length("form") % 4)
    word = F.when(F.col("k") == 0, F.col("g")).when(F.col("k") == 1, F.col("u")).when(F.col("k") == 2, F.concat(F.lit("'"), "u")).otherwise(F.concat(F.lit("*"), "g"))
    rows = rows.withColumn("word", word)
    load = lambda code, c="word": X.load_form(F.lit(code), F.col(c))
    return rows.select("form", X.bare_form(load("grc")).alias("greek_load"), load("grc").alias("greek_load_elided"), X.query_form(F.lit("grc"), F.col("word")).alias("greek_query"), load("lat").alias("latin_load"), load("ara").alias("arabic_load"))


_BETA_SQL = f"regexp_replace(translate(regexp_replace(form, '[^{BETA}]', '', 'g'), '{BETA}', '{GREEK}'), 'σ$', 'ς')"


def beta_word(c: str = "form") -> Column:
    return F.regexp_replace(c, f"[^{BETA}]", "")


@query(f"""
WITH {TOKENS}, f AS (SELECT DISTINCT form FROM fm)
SELECT form, {_BETA_SQL} AS greek, replace({_BETA_SQL}, 'α', 'ά') AS acute, {_BETA_SQL} || 'Α' AS again, CASE WHEN length({_BETA_SQL}) = 0 THEN 'Α' ELSE regexp_replace({_BETA_SQL}, 'ς$', 'σ') || 'α' END AS middle FROM f""".replace("'Α' ELSE", "'α' ELSE"))
def beta_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta Code to Greek: final and medial sigma, accents, capitals, and text that is Greek already."""
    rows = statistics.forms_of(D.tokens(spark, sf_dir)).select("form").distinct().withColumn("beta", beta_word())
    greek = X.beta_code_to_greek(F.col("beta"))
    return rows.select(
        "form",
        greek.alias("greek"),
        X.beta_code_to_greek(F.replace(F.col("beta"), F.lit("a"), F.lit("a/"))).alias("acute"),
        X.beta_code_to_greek(F.concat(greek, F.lit("Α"))).alias("again"),
        X.beta_code_to_greek(F.concat("beta", F.lit("a"))).alias("middle"),
    )


_BETA_LEMMA = _BETA_SQL.replace("form", "headword")


@query(f"""
WITH {LEXICON} SELECT {_BETA_SQL} AS form, {_BETA_LEMMA} AS lemma, part_of_speech AS pos, number, tense, grammatical_case AS "case" FROM lex
WHERE length({_BETA_SQL}) > 0 AND length({_BETA_LEMMA}) > 0""")
def greek_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis elements in Beta Code to JSON lines in Greek and back; what has no Beta Code letter in its form or lemma is no record."""
    found = D.parses(spark, sf_dir)
    parts = found.select(beta_word("form").alias("form"), beta_word("headword").alias("lemma"), F.col("part_of_speech").alias("pos"), "number", "tense", F.col("grammatical_case").alias("case"))
    at, out = new_folder(spark, "analyses"), new_folder(spark, "converted")
    parts.write.format("xml").option("rootTag", "analyses").option("rowTag", "analysis").save(at)
    morph.convert_xml(spark, at, out, greek=True)
    return morph.records(spark, out, "grc").select("form", "lemma", "pos", "number", "tense", "case")


@query(f"""
WITH {TOKENS}, f AS (SELECT DISTINCT form, regexp_replace(form, '[^{BETA}]', '', 'g') AS b, {_BETA_SQL} AS g FROM fm WHERE length(regexp_replace(form, '[^{BETA}]', '', 'g')) > 0)
SELECT r.form AS request_id, CASE WHEN r.b = r.g THEN 1 ELSE 4 END AS tier, l.form AS id FROM f r JOIN f l ON r.g = l.g""")
def greek_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greek words asked for in Beta Code: nothing is found as typed, so the converted word is looked up."""
    forms = checkpointed(statistics.forms_of(D.tokens(spark, sf_dir)).select("form").distinct().where(F.length(beta_word()) > 0))
    g = X.beta_code_to_greek(beta_word())
    known = checkpointed(forms.select(F.col("form").alias("id"), F.lit("grc").alias("language_code"), g.alias("form")))
    known = known.withColumn("bare_form", X.bare_form(F.col("form"))).withColumn("form_normalized", X.normalize_unicode(F.col("form")))
    asked = forms.select(F.col("form").alias("request_id"), F.lit("grc").alias("language_code"), beta_word().alias("word"))
    return lookup.lookup(asked, known).select("request_id", "tier", "id")


@query(f"""
WITH {ALL},
total AS (SELECT c.request_id, c.id, min(c.id) OVER (PARTITION BY c.request_id, c.lemma_id) AS lemma_rank, count(DISTINCT c.lemma_id) OVER (PARTITION BY c.request_id) AS n_lemmas, coalesce(form_score / nullif(sum(form_score) OVER (PARTITION BY c.request_id), 0), 0) AS b
          FROM cand c JOIN fs USING (request_id, id))
SELECT request_id, id, CAST(NULL AS DOUBLE) AS document_frequency FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(CASE WHEN n_lemmas > 1 THEN b / 2 ELSE b END, 12) DESC, lemma_rank, id) AS k FROM total) WHERE k = 1""")
def winner_without_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name neither a document (some an empty one) nor a word before: the form's features decide, and no frequency is shown."""
    words = checkpointed(D.tokens(spark, sf_dir))
    known = checkpointed(D.parses_of(words))
    asked = checkpointed(D.requests_of(words).withColumn("document_id", F.when(F.char_length("word") % 2 == 0, "")).withColumn("prior_word", F.lit(None).cast("string")))
    found = checkpointed(lookup.document_frequency(lookup.lookup(asked, known), asked, statistics.document_counts(words, known)))
    before = lookup.lookup(asked, known, "prior_word")
    counts = statistics.morph_counts(words, known, D.FEATURES)
    prior = spark.createDataFrame([], "language_code string, previous_feature_key string, current_feature_key string, count double")
    won = scoring.winners(found, scoring.word_scores(found), scoring.form_scores(found, counts, D.FEATURES), scoring.prior_scores(found, before, prior, D.FEATURES)).where("is_winner")
    return won.join(found.select("request_id", "id", "document_frequency"), ["request_id", "id"]).select("request_id", "id", "document_frequency")


@query(f"WITH {LEXICON}, {BIGRAMS}, {PRIOR} SELECT language_code, previous_feature_key, current_feature_key, round(2 * count, 4) AS count FROM prior")
def upsert_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two halves of the documents, added up and then added to themselves."""
    keys = ["language_code", "previous_feature_key", "current_feature_key"]
    return _twice(spark, sf_dir, statistics.prior_counts, keys, "count")


@query(f"WITH {LEXICON}, {DOCUMENT} SELECT document_id, lemma_id, round(2 * weighted_frequency, 4) AS weighted_frequency FROM df")
def upsert_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(spark, sf_dir, lambda words, known, _: statistics.document_counts(words, known), ["document_id", "lemma_id"], "weighted_frequency")


def _twice(spark: SparkSession, sf_dir: str, counts, keys: list[str], count: str) -> DataFrame:
    words = D.tokens(spark, sf_dir)
    late = F.col("document_id").cast("long") % 2 == 1
    with temporary(spark):
        known = checkpointed(D.parses_of(words))
        words = checkpointed(sieve.relevant(words, known))
        halves = [checkpointed(counts(words.where(w), known, D.FEATURES)) for w in (~late, late)]
        once = checkpointed(statistics.upsert(*halves, keys, count), keep=True)
    return statistics.upsert(once, once, keys, count).select(*keys, F.round(count, 4).alias(count))


_WIDE = ", ".join(f"CASE WHEN (length(form) * {j + 3} + length(headword) * {j + 1}) % 4 = 0 THEN '{c[:3]}' END" for j, c in enumerate(FEATURES))


@query(f"""
WITH {LEXICON},
wide AS (SELECT language_code, n_parses, form, list_filter([{_WIDE}], lambda x: x IS NOT NULL) AS f FROM known),
v AS (SELECT language_code, f, sum(c / n_parses) AS weight FROM (SELECT language_code, form, count(*) AS c FROM fm GROUP BY ALL) JOIN wide USING (language_code, form) GROUP BY ALL),
s AS (SELECT language_code, weight, f, unnest(range(CAST(1 << len(f) AS BIGINT))) AS m FROM v)
SELECT language_code, array_to_string(list_filter(f, lambda x, i: (m >> (i - 1)) & 1 = 1), '') AS feature_key, round(sum(weight), 4) AS count FROM s GROUP BY ALL""")
def morph_frequencies_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets over all fifteen columns of a parse, of which some words show all."""
    words = checkpointed(D.tokens(spark, sf_dir))
    a, b = F.char_length("form"), F.char_length("headword")
    wide = D.parses_of(words).select("id", "lemma_id", "language_code", "form", *(F.when((a * (j + 3) + b * (j + 1)) % 4 == 0, c[:3]).alias(c) for j, c in enumerate(FEATURES)))
    return statistics.morph_counts(words, wide).select("language_code", "feature_key", F.round("count", 4).alias("count"))


_CODES = {"en": "latin", "fr": "greek", "de": "arabic"}


@query("""
WITH n AS (SELECT DISTINCT lang, CASE lang WHEN 'en' THEN 'latin' WHEN 'fr' THEN 'greek' WHEN 'de' THEN 'arabic' ELSE lang END AS name FROM documents WHERE lang IS NOT NULL)
SELECT name || '.morph.jsonl' AS file, CASE name WHEN 'latin' THEN 'lat' WHEN 'greek' THEN 'grc' WHEN 'arabic' THEN 'ara' ELSE name END AS code, name = 'arabic' AS keeps_case,
       CASE name WHEN 'latin' THEN 'Latin' WHEN 'greek' THEN 'Greek' WHEN 'arabic' THEN 'Arabic' END AS language FROM n""")
def record_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that a record file's name stands for."""
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").where("lang is not null").distinct()
    file = F.concat(F.coalesce(X.lookup(F.col("lang"), _CODES), F.col("lang")), F.lit(".morph.jsonl"))
    code = X.canonical_language(F.substring_index("file", ".", 1))
    return langs.select(file.alias("file")).select("file", code.alias("code")).select("file", "code", X.match_case(F.col("code")).alias("keeps_case"), X.lookup(F.col("code"), LANGUAGES).alias("language"))


def _loaded_engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, dict[str, int]]:
    engine = Engine(spark, new_folder(spark, "store"))
    folder = record_folder(spark, sf_dir)
    told = engine.load_morph(folder, "lat")
    forgotten(spark, folder)  # what was loaded is in the store
    return engine, told


def _as_latin(words: DataFrame) -> DataFrame:
    return words.withColumn("language_code", F.lit("lat"))


LATIN = f"""{LOADED},
amb AS MATERIALIZED (SELECT loaded AS form, lemma_id, dedup_key, count(*) OVER (PARTITION BY loaded) AS n_parses, n_lemmas FROM par JOIN lem USING (headword, sequence_number)
        JOIN (SELECT loaded, count(DISTINCT (headword, sequence_number)) AS n_lemmas FROM par GROUP BY loaded) USING (loaded))"""


@query(f"""
WITH {LATIN} SELECT document_id, lemma_id, round(sum(c / n_lemmas), 4) AS weighted_frequency FROM (SELECT document_id, form, count(*) AS c FROM fm GROUP BY ALL) JOIN (SELECT DISTINCT form, lemma_id, n_lemmas FROM amb) USING (form) GROUP BY ALL""")
def engine_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine from end to end: load records, add a corpus' tokens, read the stored statistic."""
    engine, _ = _loaded_engine(spark, sf_dir)
    engine.add_tokens(_as_latin(D.tokens(spark, sf_dir)))
    return engine.store.read("document_frequencies").withColumn("weighted_frequency", F.round("weighted_frequency", 4))


@query(f"""
WITH {LATIN},
big AS (SELECT before, form, count(*) AS c FROM (SELECT form, lag(form) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM fm) WHERE before IS NOT NULL GROUP BY ALL)
SELECT p.dedup_key AS previous_feature_key, k.dedup_key AS current_feature_key, round(2 * sum(c / k.n_parses), 4) AS count FROM big b JOIN amb k ON k.form = b.form JOIN amb p ON p.form = b.before GROUP BY ALL""")
def engine_prior_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that is aggregated twice counts twice; a batch that is told twice under one name, once."""
    engine, _ = _loaded_engine(spark, sf_dir)
    words = engine.relevant(_as_latin(D.tokens(spark, sf_dir)))
    for batch in (None, "second", "second"):
        engine.add_tokens(words, batch)
    return engine.store.read("prior_frequencies").select("previous_feature_key", "current_feature_key", F.round("count", 4).alias("count"))


@query(f"""
WITH {LOADED}, n AS (SELECT count(*) AS parses, count(*) FILTER (part_of_speech = 'noun') AS lacking FROM rec)
SELECT 'analyses' AS counter, parses + lacking AS value FROM n UNION ALL SELECT 'parses', parses FROM n UNION ALL SELECT 'stored', (SELECT count(*) FROM par) UNION ALL SELECT 'lemmas', (SELECT count(*) FROM lem) UNION ALL SELECT 'reloaded', parses FROM n""")
def engine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load reports: records read and records with a form and a lemma, of which repeats aren't stored; loading again without deleting adds nothing."""
    at = record_folder(spark, sf_dir)
    engine = Engine(spark, new_folder(spark, "store"))
    first, again = engine.load_morph(at, "lat"), engine.load_morph(at, "lat", replace=False)
    rows = [*first.items(), ("stored", engine.store.read("parses").count()), ("lemmas", engine.store.read("lemmas").count()), ("reloaded", again["parses"])]
    return spark.createDataFrame(rows, "counter string, value long")


@query(f"""
WITH {LATIN} SELECT 'lat' AS language_code, (SELECT count(*) FROM lem) AS lemmas, (SELECT count(*) FROM par) AS parses, (SELECT count(*) FROM (SELECT DISTINCT document_id, lemma_id FROM fm JOIN amb USING (form))) AS document_frequencies""")
def delete_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a language takes its lemmas, and with them their parses and document frequencies, and leaves the other's."""
    engine, _ = _loaded_engine(spark, sf_dir)
    engine.add_tokens(_as_latin(D.tokens(spark, sf_dir)))
    extra = as_lines(spark.createDataFrame([('{"form": "λόγος", "lemma": "λόγος"}',), ('{"form": "λόγου", "lemma": "λόγος"}',)], "line string"), F.col("line"), "line")
    engine.load_morph(extra, "grc")
    engine.add_tokens(spark.createDataFrame([("greek", "grc", 0, "λόγος")], "document_id string, language_code string, pos long, token string"))
    s = engine.store
    s.delete_language("grc")
    sizes = [s.read(name).count() for name in ("lemmas", "parses", "document_frequencies")]
    left = s.read("lemmas").select("language_code").distinct()
    return left.select("language_code", *(F.lit(n).cast("long").alias(name) for name, n in zip(("lemmas", "parses", "document_frequencies"), sizes, strict=True)))


@query(f"""
WITH {LEXICON}, l AS (SELECT DISTINCT headword FROM lex) SELECT 'kept' AS document_id, 'senses' AS kind, count(*) AS n FROM l UNION ALL SELECT 'kept', 'entries', count(*) FROM l""")
def clear_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearing a lexicon takes its senses and entries and leaves another's."""
    heads = D.parses(spark, sf_dir).select("headword").distinct()
    engine = Engine(spark, new_folder(spark, "store"))
    for name in ("kept", "gone"):
        senses = ordering.numbered(heads, ["headword"]).select("id", F.lit("-1").alias("entry_id"), F.lit("-1").alias("sense_id"), F.concat(F.lit("entry="), "headword").alias("lemma"), F.lit(None).cast("string").alias("sense"), F.lit(-1).alias("level"), F.lit("d").alias("definition"), F.lit(name).alias("document_id"))
        entries = heads.select(F.col("headword").alias("key"), F.lit("t").alias("text"), F.lit(name).alias("document_id"))
        engine.store.replace("senses", senses, "document_id", [name])
        engine.store.replace("entries", entries, "document_id", [name])
    engine.store.clear_lexicon("gone")
    counted = lambda name: engine.store.read(name).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select("document_id", F.lit(name).alias("kind"), "n")
    return counted("senses").union(counted("entries"))


@query(f"""
WITH {ALL},
total AS (SELECT c.request_id, c.id, c.lemma_id,
  word_score / nullif(sum(word_score) OVER w, 0) AS a, word_score IS NOT NULL AS ha, form_score / nullif(sum(form_score) OVER w, 0) AS b, form_score IS NOT NULL AS hb,
  prior_score / nullif(sum(prior_score) OVER w, 0) AS c, prior_score IS NOT NULL AS hc, min(c.id) OVER (PARTITION BY c.request_id, c.lemma_id) AS lemma_rank
  FROM cand c LEFT JOIN ws USING (request_id, id) LEFT JOIN fs USING (request_id, id) LEFT JOIN ps USING (request_id, id) WINDOW w AS (PARTITION BY request_id)),
won AS (SELECT request_id, id, lemma_rank, row_number() OVER (PARTITION BY request_id ORDER BY round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (ha::INT + hb::INT + hc::INT), 12) DESC, lemma_rank, id) = 1 AS is_winner FROM total)
SELECT r.request_id, r.word, CAST(dense_rank() OVER (PARTITION BY r.request_id ORDER BY lemma_rank) AS INTEGER) AS lemma_place, c.headword, CAST(row_number() OVER (PARTITION BY r.request_id, c.lemma_id ORDER BY c.id) AS INTEGER) AS parse_place,
       c.form, {", ".join("c." + f for f in D.FEATURES)}, is_winner, round(df.weighted_frequency, 4) AS document_frequency, 'see ' || c.headword AS short_definition,
       CASE WHEN length(c.headword) >= 5 THEN 'see ' || c.headword || ';' || reverse(c.headword) ELSE 'see ' || c.headword END AS definitions,
       CASE WHEN length(c.headword) >= 5 THEN '<orth>' || c.headword || '</orth>' END AS entry
FROM req r JOIN cand c ON c.request_id = r.request_id JOIN won ON won.request_id = c.request_id AND won.id = c.id LEFT JOIN df ON df.document_id = r.document_id AND df.lemma_id = c.lemma_id""".replace("'see ' || c.headword || ';' || reverse(c.headword)", "reverse(c.headword) || ';see ' || c.headword"))
def response_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every nested response: lemmas and parses in their order, the winner, frequency, senses and entries."""
    from lexispark.plans.queries import scores_of

    known, asked, found, scores = scores_of(D.tokens(spark, sf_dir))
    lemmas = lookup.attached(D.lemmas(known), D.senses(known), D.entries(known), D.registry(spark))
    out = scoring.respond(asked, found, scoring.winners(found, *scores.values()), lemmas.drop("language_code"), D.FEATURES)
    lemma = out.select("request_id", "word", F.posexplode("lemmas").alias("k", "lemma"))
    parse = lemma.select("*", F.posexplode("lemma.parses").alias("j", "parse"))
    return parse.select(
        "request_id", "word", (F.col("k") + 1).alias("lemma_place"), "lemma.headword", (F.col("j") + 1).alias("parse_place"), "parse.form", *(F.col(f"parse.{c}") for c in D.FEATURES), "parse.is_winner",
        F.round("lemma.document_frequency", 4).alias("document_frequency"), "lemma.short_definition", F.array_join(F.transform("lemma.senses", lambda s: s["definition"]), ";").alias("definitions"), F.get("lemma.entries", 0)["text"].alias("entry"),
    )


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file in three parts; two files of neighbouring ids are one document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null")
    rows = docs.select("doc_id", statistics.words_of(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    cut = lambda k: F.floor(F.size("w") * k / 3).cast("int")
    text = F.array_join(F.slice("w", cut(F.col("k")) + 1, cut(F.col("k") + 1) - cut(F.col("k"))), " ")
    return rows.select(F.floor(F.col("doc_id") / 2).cast("string").alias("document_id"), F.lit("lat").alias("language_code"), F.col("doc_id").cast("string").alias("file"), F.col("k").cast("long").alias("seq"), text.alias("text"))


@query(f"""
WITH {LATIN},
big AS (SELECT before, form, count(*) AS c FROM (SELECT form, lag(form) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM fm) WHERE before IS NOT NULL GROUP BY ALL)
SELECT p.dedup_key AS previous_feature_key, k.dedup_key AS current_feature_key, round(sum(c / k.n_parses), 4) AS count FROM big b JOIN amb k ON k.form = b.form JOIN amb p ON p.form = b.before GROUP BY ALL""")
def file_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files' parts: two files of one document are two chains, a file whose parts come in three batches, in any order, is one."""
    engine, _ = _loaded_engine(spark, sf_dir)
    parts, folder, checkpoint = checkpointed(parts_of(spark, sf_dir)), new_folder(spark, "parts"), new_folder(spark, "stream")
    for batch in range(3):
        parts.where((F.col("seq") + F.col("file").cast("long")) % 3 == batch).write.mode("append").parquet(folder)
        follow(engine, folder, checkpoint).awaitTermination()
    return engine.store.read("prior_frequencies").select("previous_feature_key", "current_feature_key", F.round("count", 4).alias("count"))


@query(f"""
WITH {LATIN}, b AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS document_id, form, count(*) AS c FROM fm GROUP BY ALL)
SELECT 'document' AS kind, document_id AS of, CAST(lemma_id AS VARCHAR) AS key, round(sum(c / n_lemmas), 4) AS count FROM b JOIN (SELECT DISTINCT form, lemma_id, n_lemmas FROM amb) USING (form) GROUP BY ALL
UNION ALL SELECT 'words', '', '', round(sum(c), 4) FROM b WHERE form IN (SELECT form FROM amb)""")
def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches of whole files, one of them told twice: each is appended, and three are merged once they are there."""
    engine, _ = _loaded_engine(spark, sf_dir)
    engine.store.fan_in = 3
    words = engine.relevant(statistics.tokens_of(parts_of(spark, sf_dir).where("seq >= 0")))
    quarter = F.pmod(F.xxhash64("document_id"), F.lit(4))
    for number in (0, 1, 1, 2, 3):
        engine.add_tokens(words.where(quarter == number), ("files", number))
    documents = engine.store.read("document_frequencies").select(F.lit("document").alias("kind"), F.col("document_id").alias("of"), F.col("lemma_id").cast("string").alias("key"), F.round("weighted_frequency", 4).alias("count"))
    total = engine.store.read("morph_frequencies").where("feature_key = ''").select(F.lit("words"), F.lit(""), F.lit(""), F.round("count", 4))
    return documents.union(total)


def _of_engine(sql: str) -> str:
    """SQL over the derived lexicon, said of what the engine has loaded."""
    for a, b in (("FROM fm", "FROM fml"), ("JOIN known", "JOIN knownl"), ("FROM known", "FROM knownl"), ("JOIN lex l", "JOIN lexl l")):
        sql = sql.replace(a, b)
    return sql


SERVICE = f"""{LOADED},
fml AS MATERIALIZED (SELECT document_id, doc_id, 'lat' AS language_code, pos, token, form FROM fm),
lexl AS MATERIALIZED (
  SELECT 'lat' AS language_code, p.id, lemma_id, p.headword, p.sequence_number, loaded AS form, regexp_replace(loaded, '[()\\\\/*=|+\'\']', '', 'g') AS bare_form, lower(strip_accents(loaded)) AS form_normalized,
         grammatical_case, number, part_of_speech, tense, dedup_key FROM par p JOIN lem USING (headword, sequence_number)),
knownl AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY form) AS n_parses FROM lexl JOIN (SELECT form, count(DISTINCT lemma_id) AS n_lemmas FROM lexl GROUP BY form) USING (form)),
{_of_engine(", ".join((MORPH, BIGRAMS, PRIOR, DOCUMENT, REQUESTS, _tiers("cand", "word"), _tiers("before_cand", "prior_word"), EXCLUSIVE, SCORES)))},
total AS (SELECT c.request_id, c.id, c.lemma_id,
  word_score / nullif(sum(word_score) OVER w, 0) AS a, word_score IS NOT NULL AS ha, form_score / nullif(sum(form_score) OVER w, 0) AS b, form_score IS NOT NULL AS hb,
  prior_score / nullif(sum(prior_score) OVER w, 0) AS c, prior_score IS NOT NULL AS hc, min(c.id) OVER (PARTITION BY c.request_id, c.lemma_id) AS lemma_rank
  FROM cand c LEFT JOIN ws USING (request_id, id) LEFT JOIN fs USING (request_id, id) LEFT JOIN ps USING (request_id, id) WINDOW w AS (PARTITION BY request_id)),
won AS (SELECT request_id, id, lemma_rank, row_number() OVER (PARTITION BY request_id ORDER BY round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (ha::INT + hb::INT + hc::INT), 12) DESC, lemma_rank, id) = 1 AS is_winner FROM total),
named AS (SELECT *, headword || CASE WHEN sequence_number = -1 THEN '' ELSE CAST(sequence_number AS VARCHAR) END AS lexicon_key FROM cand)"""


@query(f"""
WITH {SERVICE}
SELECT r.request_id, r.word, CAST(dense_rank() OVER (PARTITION BY r.request_id ORDER BY lemma_rank) AS INTEGER) AS lemma_place, c.headword, c.sequence_number, CAST(row_number() OVER (PARTITION BY r.request_id, c.lemma_id ORDER BY c.id) AS INTEGER) AS parse_place,
       c.form, c.part_of_speech, c.number, c.tense, c.grammatical_case, is_winner, round(df.weighted_frequency, 4) AS document_frequency, 'see ' || lexicon_key AS short_definition,
       CASE WHEN length(c.headword) >= 5 THEN reverse(c.headword) || ';see ' || lexicon_key ELSE 'see ' || lexicon_key END AS definitions, CAST(CASE WHEN length(c.headword) >= 5 THEN 1 ELSE 0 END AS INTEGER) AS n_entries
FROM req r JOIN named c ON c.request_id = r.request_id JOIN won ON won.request_id = c.request_id AND won.id = c.id LEFT JOIN df ON df.document_id = r.document_id AND df.lemma_id = c.lemma_id
UNION ALL SELECT request_id, word, 0, NULL, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM req WHERE request_id NOT IN (SELECT request_id FROM cand)""")
def engine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service from end to end: records, lexica and a corpus in a store, then a request for each form of the corpus."""
    engine, _ = _loaded_engine(spark, sf_dir)
    words = _as_latin(D.tokens(spark, sf_dir))
    engine.add_tokens(words)
    lemmas = engine.store.read("lemmas").withColumn("key", X.lexicon_key(F.col("headword"), F.col("sequence_number")))
    none, long = F.lit("-1"), lemmas.where(F.char_length("headword") >= 5)
    shape = ["id", "entry_id", "sense_id", "lemma", "sense", "level", "definition", "document_id"]
    of = lambda rows, k, definition, name: rows.select((F.col("id") * 2 + k).alias("id"), none, none, F.concat(F.lit("entry="), "key"), F.lit(None).cast("string"), F.lit(-1), definition, F.lit(name)).toDF(*shape)
    engine.store.replace("senses", of(lemmas, 1, F.concat(F.lit("see "), "key"), "Logeion-Latin-Shortdef").union(of(long, 0, F.reverse("headword"), "lewis-short")), "document_id", ["Logeion-Latin-Shortdef", "lewis-short"])
    engine.store.replace("entries", long.select("key", F.lit("<orth/>").alias("text"), F.lit("lewis-short").alias("document_id")), "document_id", ["lewis-short"])
    asked = checkpointed(D.requests_of(words))
    out = engine.lookup(asked)
    lemma = out.select("request_id", "word", F.posexplode_outer("lemmas").alias("k", "lemma"))
    parse = lemma.select("*", F.posexplode_outer("lemma.parses").alias("j", "parse"))
    place = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).alias
    return parse.select(
        "request_id", "word", place("k")("lemma_place"), "lemma.headword", "lemma.sequence_number", place("j")("parse_place"), "parse.form", *(F.col(f"parse.{c}") for c in ("part_of_speech", "number", "tense", "grammatical_case", "is_winner")),
        F.round("lemma.document_frequency", 4).alias("document_frequency"), "lemma.short_definition", F.array_join(F.transform("lemma.senses", lambda s: s["definition"]), ";").alias("definitions"), F.coalesce(F.size("lemma.entries"), F.lit(0)).alias("n_entries"),
    )


#: Documents in a file of the written corpus.
A_FILE = 20


def write_corpus(spark: SparkSession, sf_dir: str) -> str:
    """All documents as TEI files in nested folders: names that come twice, files in another language, and broken ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null and text is not null")
    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", " ")
    body = F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = docs.select(F.floor(F.col("doc_id") / A_FILE).alias("k"), "doc_id", F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("p"))
    files = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "p"))), lambda x: x["p"]), "\n").alias("body"))
    name = F.concat(F.lit("w"), F.floor(F.col("k") / 2).cast("string"), F.when(F.col("k") % 10 == 3, "-eng1").otherwise("-lat1"), F.lit(".xml"))
    folder = F.concat_ws("/", F.when(F.col("k") % 2 == 0, "a").otherwise("b"), (F.col("k") % 7).cast("string"))
    xml = F.concat(F.lit("<TEI><text><note>no</note>"), "body", F.lit("</text>"), F.when(F.col("k") % 50 == 7, "").otherwise("</TEI>"))
    at = new_folder(spark, "corpus")

    def write(batches):
        from pyarrow import fs  # tasks write the files into the shared folder, whatever kind of store it is

        where, base = fs.FileSystem.from_uri(at)
        for batch in batches:
            for path, text in zip(batch["path"], batch["xml"], strict=True):
                where.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with where.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"written": [len(batch)]})

    files.select(F.concat_ws("/", folder, name).alias("path"), xml.alias("xml")).mapInPandas(write, "written long").agg(F.sum("written")).collect()
    return at


@query(f"""
WITH {LATIN},
f AS (SELECT *, doc_id // {A_FILE} AS k FROM fm),
read AS MATERIALIZED (SELECT * FROM f WHERE k % 10 <> 3 AND k % 50 <> 7),
big AS (SELECT before, form, count(*) AS c FROM (SELECT form, lag(form) OVER (PARTITION BY k ORDER BY doc_id, pos) AS before FROM read) WHERE before IS NOT NULL GROUP BY ALL),
files AS (SELECT DISTINCT doc_id // {A_FILE} AS k FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)
SELECT 'pair' AS kind, p.dedup_key AS a, k.dedup_key AS b, round(sum(c / k.n_parses), 4) AS count FROM big b JOIN amb k ON k.form = b.form JOIN amb p ON p.form = b.before GROUP BY ALL
UNION ALL SELECT 'document', 'w' || CAST(k // 2 AS VARCHAR) || '-lat1', CAST(lemma_id AS VARCHAR), round(sum(c / n_lemmas), 4) FROM (SELECT k, form, count(*) AS c FROM read GROUP BY ALL) JOIN (SELECT DISTINCT form, lemma_id, n_lemmas FROM amb) USING (form) GROUP BY k // 2, lemma_id
UNION ALL SELECT 'counter', 'files', '', count(*) FROM files WHERE k % 10 <> 3 UNION ALL SELECT 'counter', 'failed', '', count(*) FROM files WHERE k % 10 <> 3 AND k % 50 = 7
UNION ALL SELECT 'counter', 'tokens', '', count(*) FROM read""")
def corpus_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of files is found, read and added up: what the run tells, pairs within files, and documents of two files."""
    engine, _ = _loaded_engine(spark, sf_dir)
    told = engine.aggregate(write_corpus(spark, sf_dir))
    s, none = engine.store, F.lit("")
    pairs = s.read("prior_frequencies").select(F.lit("pair").alias("kind"), F.col("previous_feature_key").alias("a"), F.col("current_feature_key").alias("b"), F.round("count", 4).alias("count"))
    documents = s.read("document_frequencies").select(F.lit("document"), "document_id", F.col("lemma_id").cast("string"), F.round("weighted_frequency", 4))
    counters = spark.createDataFrame([(name, float(n)) for name, n in told.items()], "name string, n double").select(F.lit("counter"), "name", none, "n")
    return pairs.union(documents).union(counters)


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, length(t) // 3 AS n, t FROM d)
SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 0 WHEN doc_id % 5 = 2 THEN 7 ELSE 6 END AS n_elements, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE md5(substr(t, n + 1)) END AS within_md5,
       CASE WHEN doc_id % 7 = 3 OR length(t) = 0 THEN NULL WHEN doc_id % 5 = 2 THEN 'span/body/div/note' ELSE 'text/body/div/note' END AS above_the_last
FROM p""")
def element_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of every document as TEI, some without a root, some broken: what stands in a div, and above the last piece of text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.regexp_replace("text", "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]", "").alias("t"))
    n = F.floor(F.char_length("t") / 3).cast("int")
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    front, middle, last = (escaped(F.substring(F.col("t"), a, size)) for a, size in ((F.lit(1), n), (n + 1, n), (2 * n + 1, F.char_length("t"))))
    inner = F.concat(F.lit("<front n='&quot;'>"), front, F.lit("</front><body><div><p>"), middle, F.lit("</p><note>"), last, F.lit("</note></div></body>"))
    i = F.col("doc_id")
    xml = F.when(i % 7 == 3, F.concat(inner, F.lit("</broken>"))).when(i % 5 == 2, F.concat(inner, F.lit("<back/>"))).otherwise(F.concat(F.lit("<text>"), inner, F.lit("</text>")))
    found = checkpointed(tei_elements.elements(docs.select("doc_id", xml.alias("xml")), "xml").drop("xml"))
    within = tei_elements.text_within(found, "doc_id", "div").select("doc_id", F.md5(F.col("text").cast("binary")).alias("within_md5"))
    final = found.where("tag is null and depth > 0").groupBy("doc_id").agg(F.max("start").alias("at"))
    outer = found.where("tag is not null").select("doc_id", "start", "end", "tag").join(final, "doc_id").where("at between start and end")
    above = outer.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "tag"))), lambda x: x["tag"]), "/").alias("above_the_last"))
    sizes = found.groupBy("doc_id").agg(F.count("tag").cast("int").alias("n_elements"), F.max("depth").alias("deepest"))
    empty = F.when(F.col("deepest") > 0, F.md5(F.lit("").cast("binary")))
    return sizes.join(within, "doc_id", "left").join(above, "doc_id", "left").select("doc_id", "n_elements", F.coalesce("within_md5", empty).alias("within_md5"), "above_the_last")
