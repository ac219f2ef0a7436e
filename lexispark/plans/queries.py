"""One query an operator or group of operators, over whole tables, with its DuckDB twin beside it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import lookup, scoring, sieve, statistics
from lexispark.operators.ordering import first_wins, suffixed_repeats
from lexispark.operators.store import checkpointed, temporary
from lexispark.plans import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = "concat_ws('', grammatical_case, number, part_of_speech, tense)"

_rules = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in D.RULES)
TOKENS = r"""
docs AS (SELECT doc_id, lang AS language_code, regexp_extract_all(text, '[\p{L}\p{M}]+') AS w FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
tok AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, language_code, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos FROM docs),
fm AS MATERIALIZED (SELECT *, lower(token) AS form FROM tok)"""
LEXICON = rf"""{TOKENS},
rules(suffix, part_of_speech, number, tense, grammatical_case) AS (VALUES {_rules}),
lex AS MATERIALIZED (
  SELECT f.language_code, form, left(form, length(form) - length(suffix)) AS headword, grammatical_case, number, part_of_speech, tense, {KEY} AS dedup_key,
         f.language_code || ':' || left(form, length(form) - length(suffix)) AS lemma_id,
         concat_ws('|', f.language_code, left(form, length(form) - length(suffix)), form, {KEY}) AS id,
         regexp_replace(form, '[()\\/*=|+'']', '', 'g') AS bare_form, lower(strip_accents(form)) AS form_normalized
  FROM (SELECT DISTINCT language_code, form FROM fm WHERE length(form) >= 3) f JOIN rules ON ends_with(form, suffix) AND length(form) > length(suffix)),
known AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY language_code, form) AS n_parses, nl AS n_lemmas FROM lex JOIN (SELECT language_code, form, count(DISTINCT lemma_id) AS nl FROM lex GROUP BY ALL) USING (language_code, form))"""
MORPH = """
vec AS (SELECT language_code, grammatical_case, number, part_of_speech, tense, sum(c / n_parses) AS weight
        FROM (SELECT language_code, form, count(*) AS c FROM fm GROUP BY ALL) JOIN known USING (language_code, form) GROUP BY ALL),
sub AS (SELECT language_code, weight, m, CASE WHEN m & 1 = 1 THEN grammatical_case END AS grammatical_case, CASE WHEN m & 2 = 2 THEN number END AS number,
               CASE WHEN m & 4 = 4 THEN part_of_speech END AS part_of_speech, CASE WHEN m & 8 = 8 THEN tense END AS tense
        FROM vec, (SELECT unnest(range(16)) AS m)
        WHERE (m & 1 = 0 OR grammatical_case IS NOT NULL) AND (m & 2 = 0 OR number IS NOT NULL) AND (m & 4 = 0 OR part_of_speech IS NOT NULL) AND (m & 8 = 0 OR tense IS NOT NULL)),
morph AS MATERIALIZED (SELECT language_code, """ + KEY + """ AS feature_key, sum(weight) AS count FROM sub GROUP BY ALL)"""
BIGRAMS = """
lagged AS MATERIALIZED (SELECT document_id, doc_id, language_code, pos, token, form, lag(form) OVER (PARTITION BY doc_id, language_code ORDER BY pos) AS before FROM fm),
big AS (SELECT language_code, before, form, count(*) AS c FROM lagged WHERE before IS NOT NULL GROUP BY ALL)"""
PRIOR = """
prior AS MATERIALIZED (SELECT b.language_code, p.dedup_key AS previous_feature_key, k.dedup_key AS current_feature_key, sum(c / k.n_parses) AS count
          FROM big b JOIN known k ON k.language_code = b.language_code AND k.form = b.form JOIN known p ON p.language_code = b.language_code AND p.form = b.before GROUP BY ALL)"""
DOCUMENT = """
df AS (SELECT document_id, lemma_id, sum(c / n_lemmas) AS weighted_frequency
       FROM (SELECT document_id, language_code, form, count(*) AS c FROM fm GROUP BY ALL) JOIN (SELECT DISTINCT language_code, form, lemma_id, n_lemmas FROM known) USING (language_code, form) GROUP BY ALL)"""
REQUESTS = """
req AS MATERIALIZED (SELECT language_code || ':' || form AS request_id, language_code, form, document_id, before AS prior_word,
               CASE length(form) % 4 WHEN 1 THEN '''' || form WHEN 2 THEN translate(form, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 3 THEN lower(strip_accents(form)) ELSE form END AS word
        FROM (SELECT *, row_number() OVER (PARTITION BY language_code, form ORDER BY doc_id, pos) AS k FROM lagged) WHERE k = 1)"""


def _tiers(name: str, word: str) -> str:
    """CTE of every request's candidates from its first tier that has any."""
    bare = rf"regexp_replace({word}, '[()\\/*=|+'']', '', 'g')"
    return f"""
{name} AS MATERIALIZED (SELECT request_id, tier, l.* FROM (
  SELECT *, min(tier) OVER (PARTITION BY request_id) AS first FROM (
    SELECT request_id, 1 AS tier, l.id FROM req r JOIN lex l ON l.language_code = r.language_code AND l.form = lower({word})
    UNION ALL SELECT request_id, 2, l.id FROM req r JOIN lex l ON l.language_code = r.language_code AND l.bare_form = {bare}
    UNION ALL SELECT request_id, 3, l.id FROM req r JOIN lex l ON l.language_code = r.language_code AND l.form_normalized = lower(strip_accents({word})))) c
  JOIN lex l ON l.id = c.id WHERE tier = first)"""


EXCLUSIVE = """
grp AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, """ + ", ".join(f"count(*) OVER (PARTITION BY request_id, {c}) AS n_{c}" for c in D.FEATURES) + """ FROM cand),
exc AS (SELECT request_id, id, language_code, lemma_id, dedup_key, """ + ", ".join(f"CASE WHEN n_{c} < n THEN {c} END AS x_{c}" for c in D.FEATURES) + """ FROM grp),
excl AS (SELECT request_id, id, language_code, lemma_id, dedup_key, CASE WHEN coalesce(""" + ", ".join(f"x_{c}" for c in D.FEATURES) + ") IS NULL THEN dedup_key ELSE concat_ws('', " + ", ".join(f"x_{c}" for c in D.FEATURES) + """) END AS exclusive_key FROM exc)"""
SCORES = """
fs AS (SELECT request_id, id, coalesce(count, 0) AS form_score FROM excl LEFT JOIN morph ON morph.language_code = excl.language_code AND feature_key = exclusive_key),
ps AS (SELECT c.request_id, c.id, coalesce(sum(p.count), 0) AS prior_score FROM cand c JOIN (SELECT DISTINCT request_id, dedup_key AS pk FROM before_cand) b USING (request_id)
       LEFT JOIN prior p ON p.language_code = c.language_code AND p.previous_feature_key = b.pk AND p.current_feature_key = c.dedup_key GROUP BY ALL),
ws AS (SELECT c.request_id, c.id, coalesce(weighted_frequency, 0) AS word_score FROM cand c JOIN req r USING (request_id)
       JOIN (SELECT request_id FROM cand GROUP BY request_id HAVING count(DISTINCT lemma_id) > 1) USING (request_id)
       LEFT JOIN df ON df.document_id = r.document_id AND df.lemma_id = c.lemma_id)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOKENS} SELECT document_id, language_code, count(*) AS n_tokens, count(DISTINCT lower(token)) AS n_forms, max(pos) AS last_pos FROM tok GROUP BY ALL")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.forms_of(D.tokens(spark, sf_dir))
    return rows.groupBy("document_id", "language_code").agg(F.count("*").alias("n_tokens"), F.countDistinct("form").alias("n_forms"), F.max("pos").alias("last_pos"))


@query(f"WITH {TOKENS} SELECT DISTINCT language_code, form, lower(strip_accents(form)) AS normalized FROM fm")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = statistics.forms_of(D.tokens(spark, sf_dir)).select("language_code", "form").distinct()
    return forms.withColumn("normalized", X.normalize_unicode(F.col("form")))


@query(r"SELECT event_id, regexp_replace(props || '(a)\b*c/=|+''', '[()\\/*=|+'']', '', 'g') AS bare FROM events")
def bare_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", X.bare_form(F.concat("props", F.lit("(a)\\b*c/=|+'"))).alias("bare"))


@query(r"""
WITH t AS (SELECT doc_id, replace(CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'pre-' || source WHEN 2 THEN 'a#' || source ELSE source || 'b' END, '#', '') AS s FROM documents),
h AS (SELECT doc_id, CASE WHEN regexp_full_match(s, '.+-(.+)') THEN regexp_extract(s, '^.+-(.+)$', 1) ELSE s END AS s FROM t)
SELECT doc_id, CASE WHEN regexp_full_match(s, '\D+\d+') THEN regexp_extract(s, '^(\D+)(\d+)$', 1) ELSE s END AS headword,
       CASE WHEN regexp_full_match(s, '\D+\d+') THEN CAST(regexp_extract(s, '^(\D+)(\d+)$', 2) AS INTEGER) ELSE -1 END AS sequence_number FROM h""")
def parse_lemma_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    k, s = F.col("doc_id") % 4, F.col("source")
    s = F.when(k == 0, s).when(k == 1, F.concat(F.lit("pre-"), s)).when(k == 2, F.concat(F.lit("a#"), s)).otherwise(F.concat(s, F.lit("b")))
    return docs.select("doc_id", X.lemma_parts(s).alias("p")).select("doc_id", "p.*")


@query(r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad-' || doc_id ELSE 'n' || doc_id || 'a.' || (doc_id % 7) END AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_full_match(s, 'n\d+[a-zA-Z]*\.\d+[a-zA-Z]*') THEN regexp_extract(s, '^n(\d+[a-zA-Z]*)\.', 1) ELSE '-1' END AS entry_id,
       CASE WHEN regexp_full_match(s, 'n\d+[a-zA-Z]*\.\d+[a-zA-Z]*') THEN regexp_extract(s, '\.(\d+[a-zA-Z]*)$', 1) ELSE '-1' END AS sense_id FROM t""")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    s = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("bad-"), i)).otherwise(F.concat(F.lit("n"), i, F.lit("a."), (F.col("doc_id") % 7).cast("string")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.sense_ids(s).alias("p")).select("doc_id", "p.*")


@query("""
SELECT item_id, CASE WHEN c IN (57, 58, 72, 73) THEN 'g' WHEN c IN (59, 60) THEN 'l' ELSE 'i' END AS tag FROM (SELECT item_id, 50 + item_id % 25 AS c FROM benchmark)""")
def meaning_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("lexicon:text:1999.04.00"), (50 + F.col("item_id") % 25).cast("string"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", X.meaning_tag(code).alias("tag"))


@query(f"WITH {LEXICON} SELECT id, {KEY} AS feature_key, concat_ws(' · ', nullif(grammatical_case, ''), nullif(number, ''), nullif(tense, '')) AS details FROM lex")
def fold_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.concat_ws(" · ", *(F.nullif(F.col(c), F.lit("")) for c in X.DETAIL_ORDER if c in D.FEATURES))
    return D.parses(spark, sf_dir).select("id", X.fold_key(*(F.col(c) for c in D.FEATURES)).alias("feature_key"), details.alias("details"))


@query(f"""
WITH {LEXICON}, raw AS (SELECT language_code, form, headword, dedup_key, form || '+' AS expanded_form, 2 AS line FROM lex UNION ALL SELECT language_code, form, headword, dedup_key, form, 1 FROM lex WHERE length(form) % 2 = 0)
SELECT language_code, form, headword, dedup_key, expanded_form FROM (SELECT *, row_number() OVER (PARTITION BY language_code, headword, form, dedup_key ORDER BY line) AS k FROM raw) WHERE k = 1""")
def lexicon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.parses(spark, sf_dir)
    late = found.select("language_code", "form", "headword", "dedup_key", F.concat("form", F.lit("+")).alias("expanded_form"), F.lit(2).alias("line"))
    early = found.where(F.char_length("form") % 2 == 0).select("language_code", "form", "headword", "dedup_key", "form", F.lit(1))
    return first_wins(late.union(early), ["language_code", "headword", "form", "dedup_key"], "line").drop("line")


@query(f"WITH {LEXICON} SELECT language_code, form, count(*) AS n_parses, count(DISTINCT lemma_id) AS n_lemmas FROM lex GROUP BY ALL")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.ambiguity(D.parses(spark, sf_dir))


@query(f"WITH {LEXICON}, {MORPH} SELECT language_code, feature_key, round(count, 4) AS count FROM morph")
def morph_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.tokens(spark, sf_dir)
    return statistics.morph_counts(words, D.parses_of(words), D.FEATURES).select("language_code", "feature_key", F.round("count", 4).alias("count"))


@query(f"WITH {LEXICON}, {BIGRAMS}, {PRIOR} SELECT language_code, previous_feature_key, current_feature_key, round(count, 4) AS count FROM prior")
def prior_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = checkpointed(D.tokens(spark, sf_dir).select("language_code", "token", "before"))
    out = statistics.prior_counts(words, checkpointed(D.parses_of(words)), D.FEATURES)
    return out.select("language_code", "previous_feature_key", "current_feature_key", F.round("count", 4).alias("count"))


@query(f"WITH {LEXICON}, {DOCUMENT} SELECT document_id, lemma_id, round(weighted_frequency, 4) AS weighted_frequency FROM df")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = checkpointed(D.tokens(spark, sf_dir))
    counts = statistics.document_counts(words, checkpointed(D.parses_of(words)))
    return counts.select("document_id", "lemma_id", F.round("weighted_frequency", 4).alias("weighted_frequency"))


@query(f"WITH {LEXICON}, {MORPH} SELECT language_code, feature_key, round(2 * count, 4) AS count FROM morph")
def upsert_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' counts added to themselves, each a merge of the counts of two halves of the documents."""
    words = checkpointed(D.tokens(spark, sf_dir))
    known = checkpointed(D.parses_of(words))
    late = F.col("document_id").cast("long") % 2 == 1
    halves = [statistics.morph_counts(words.where(w), known, D.FEATURES) for w in (~late, late)]
    once = statistics.upsert(halves[0], halves[1], ["language_code", "feature_key"], "count")
    twice = statistics.upsert(once, once, ["language_code", "feature_key"], "count")
    return twice.select("language_code", "feature_key", F.round("count", 4).alias("count"))


@query(f"""
WITH {LEXICON} SELECT id, lemma_id, language_code, form AS form FROM lex WHERE language_code <> 'fr' UNION ALL SELECT id, lemma_id, language_code, upper(form) FROM lex WHERE language_code = 'fr'""")
def replace_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.operators.store import replaced

    old = D.parses(spark, sf_dir).select("id", "lemma_id", "language_code", "form")
    return replaced(old, old.where("language_code = 'fr'").withColumn("form", X.upper_letters(F.col("form"))), "language_code", ["fr"])


@query(f"WITH {LEXICON}, {BIGRAMS}, {REQUESTS}, {_tiers('cand', 'word')} SELECT request_id, tier, id FROM cand")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("request_id", "tier", "id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's candidates; documents are split into words once, for the lexicon and the requests."""
    words = checkpointed(D.tokens(spark, sf_dir))
    return lookup.lookup(D.requests_of(words), checkpointed(D.parses_of(words)))


@query(f"WITH {LEXICON}, {BIGRAMS}, {REQUESTS}, {_tiers('cand', 'word')}, {EXCLUSIVE} SELECT request_id, id, exclusive_key FROM excl")
def exclusive_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.exclusive(_candidates(spark, sf_dir), D.FEATURES).select("request_id", "id", "exclusive_key")


SCORE_NAMES = ("word_score", "form_score", "prior_score")


def scores_of(words: DataFrame, names: Sequence[str] = SCORE_NAMES) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Parses, requests, their candidates and the named scores, each from its own inputs; what several read is written once.

    Documents are split into words twice: for their forms, and for the words that have parses.
    """
    with temporary(words.sparkSession):
        firsts = checkpointed(D.firsts_of(words))
        known, asked = checkpointed(D.parses_of(firsts), keep=True), checkpointed(D.requests_of_firsts(firsts), keep=True)
        words = checkpointed(sieve.relevant(words, known))
        columns = ("word", "prior_word") if "prior_score" in names else ("word",)
        shown = known.select("id", "lemma_id", "language_code", "form", "bare_form", "form_normalized", *D.FEATURES)
        matched = checkpointed(lookup.matches(lookup.probes(lookup.words_of(asked, *columns)), lookup.spelled(shown)).drop("bare_form", "form_normalized"))
        found = lookup.of_requests(asked, matched)
        if "word_score" in names:
            found = checkpointed(lookup.with_documents(found, asked))
            counts = checkpointed(sieve.document_counts_of(found.select("document_id", "lemma_id"), words, known))
            found = lookup.with_frequency(found, counts)
        found = checkpointed(found, keep=True)
        makers = {
            "word_score": lambda: scoring.word_scores(found),
            "form_score": lambda: scoring.form_scores(found, checkpointed(statistics.morph_counts(words, known, D.FEATURES)), D.FEATURES),
            "prior_score": lambda: scoring.prior_scores(found, lookup.of_requests(asked, matched, "prior_word"), checkpointed(statistics.prior_counts(words, known, D.FEATURES)), D.FEATURES),
        }
        return known, asked, found, {name: checkpointed(makers[name](), keep=True) for name in names}


ALL = f"{LEXICON}, {MORPH}, {BIGRAMS}, {PRIOR}, {DOCUMENT}, {REQUESTS}, {_tiers('cand', 'word')}, {_tiers('before_cand', 'prior_word')}, {EXCLUSIVE}, {SCORES}"


def _score_query(name: str, short: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scores_of(D.tokens(spark, sf_dir), [name])[3][name].select("request_id", "id", F.round(name, 4).alias(name))

    run.__name__ = name
    query(f"WITH {ALL} SELECT request_id, id, round({name}, 4) AS {name} FROM {short}")(run)


for _name, _short in (("form_score", "fs"), ("prior_score", "ps"), ("word_score", "ws")):
    _score_query(_name, _short)


@query(f"""
WITH {ALL},
total AS (SELECT c.request_id, c.id, c.lemma_id,
  word_score / nullif(sum(word_score) OVER w, 0) AS a, word_score IS NOT NULL AS ha, form_score / nullif(sum(form_score) OVER w, 0) AS b, form_score IS NOT NULL AS hb,
  prior_score / nullif(sum(prior_score) OVER w, 0) AS c, prior_score IS NOT NULL AS hc, min(c.id) OVER (PARTITION BY c.request_id, c.lemma_id) AS lemma_rank
  FROM cand c LEFT JOIN ws USING (request_id, id) LEFT JOIN fs USING (request_id, id) LEFT JOIN ps USING (request_id, id) WINDOW w AS (PARTITION BY request_id))
SELECT request_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (ha::INT + hb::INT + hc::INT), 12) DESC, lemma_rank, id) AS k FROM total) WHERE k = 1""")
def winning_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, found, scores = scores_of(D.tokens(spark, sf_dir))
    return scoring.winners(found, *scores.values()).where("is_winner").select("request_id", "id")


@query(f"WITH {LEXICON} SELECT DISTINCT lemma_id, 'see ' || headword AS short_definition, CAST(CASE WHEN length(headword) >= 5 THEN 2 ELSE 1 END AS BIGINT) AS n_senses, CAST(CASE WHEN length(headword) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS n_entries FROM lex")
def lexicon_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.parses(spark, sf_dir)
    out = lookup.attached(D.lemmas(known), D.senses(known), D.entries(known), D.registry(spark))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("lemma_id", "short_definition", size(F.col("senses")).alias("n_senses"), F.when(F.col("entries").isNull(), F.lit(0)).otherwise(F.size("entries")).cast("long").alias("n_entries"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT doc_id, CASE WHEN k > 1 THEN source || k ELSE source END AS key FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)""")
def key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixed_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("key")), "key", "doc_id")


@query(f"""
WITH {ALL} SELECT r.request_id, CAST(count(DISTINCT lemma_id) AS BIGINT) AS n_lemmas, CAST(count(id) AS BIGINT) AS n_parses, CAST(count(DISTINCT lemma_id) FILTER (length(headword) >= 5) AS BIGINT) AS n_entries
FROM req r LEFT JOIN cand c ON c.request_id = r.request_id GROUP BY r.request_id""")
def response_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested response of every request, summed up by its shape."""
    known, asked, found, scores = scores_of(D.tokens(spark, sf_dir))
    won = scoring.winners(found, *scores.values())
    lemmas = lookup.attached(D.lemmas(known), D.senses(known), D.entries(known), D.registry(spark))
    out = scoring.respond(asked, found, won, lemmas.drop("language_code"), D.FEATURES)
    total = lambda f: F.aggregate("lemmas", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return out.select("request_id", F.size("lemmas").cast("long").alias("n_lemmas"), total(lambda x: F.size(x["parses"])).alias("n_parses"), total(lambda x: F.coalesce(F.when(x["entries"].isNull(), 0).otherwise(F.size(x["entries"])), F.lit(0))).alias("n_entries"))
