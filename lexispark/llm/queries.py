"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import fold, new_path, table

QUALITY_LEAST = 0.7


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import language_id

    docs = table(spark, sf_dir, "documents", ("doc_id", "text", "lang"))
    model = language_id.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import site_style

    out = site_style.extract(table(spark, sf_dir, "pages", ("page_id", "url", "html")))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def quality_model(spark: SparkSession, sf_dir: str):
    from lexispark.llm import quality

    def training(name: str, *columns: str) -> DataFrame:
        return table(spark, sf_dir, name, ("doc_id", *columns)).where(fold(F.col("doc_id"), 4) != 2)

    return quality.train(training("documents", "text"), training("labels", "quality"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import quality

    out = quality.scored(table(spark, sf_dir, "documents", ("doc_id", "text")), quality_model(spark, sf_dir))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import additive_search

    return additive_search.search(table(spark, sf_dir, "embeddings", ("vec_id", "embedding")), F.pmod("vec_id", F.lit(20)) == 0)


# Exact search.
OP4_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
size AS (SELECT len(v) AS d FROM good GROUP BY d ORDER BY count(*) DESC, d DESC LIMIT 1),
ok AS (SELECT vec_id, v FROM good, size WHERE len(v) = d),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM near) WHERE k <= 20
"""


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import curve_packing

    return curve_packing.pack(table(spark, sf_dir, "documents", ("doc_id", "text")), tokenizer_path(), end_id=2)


# The rules of the query's contract.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import url_filter

    pages = table(spark, sf_dir, "pages", ("page_id", "url"))
    return url_filter.judge(pages, url_filter.rules_table(pages, [url_filter.Rule(*r) for r in URL_RULES]))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule_verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS k
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path AND f.k = 1
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import decontamination

    return decontamination.judge(table(spark, sf_dir, "documents", ("doc_id", "text")), table(spark, sf_dir, "benchmark", ("item_id", "text")))


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM asked),
met AS MATERIALIZED (
  SELECT r, k, n, item_id FROM (
    SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS words FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)) JOIN asked USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM met)) GROUP BY r),
found AS (SELECT r, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import secret_scan

    docs = table(spark, sf_dir, "documents", ("doc_id", "text"))
    return secret_scan.report(docs, secret_scan.train(words=secret_scan.frequent_words(docs)))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import token_store

    path = new_path(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents", ("doc_id", "text")), path, tokenizer_path(), end_id=1)
    return token_store.read(spark, path, tokenizer_path())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import near_dedup

    return near_dedup.duplicates(table(spark, sf_dir, "documents", ("doc_id", "text")), near_dedup.Settings(shingle=2))


# Exact sets, all pairs of them, and what each reaches.
OP10_SQL = rf"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, hash(array_to_string(w[k : k + 1], ' ')) AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS k FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n, bit_xor(s) AS x, sum(s) AS y FROM shingles GROUP BY r),
same AS MATERIALIZED (SELECT r, n, min(r) OVER (PARTITION BY n, x, y) AS node FROM sizes),
nodes AS MATERIALIZED (SELECT node, any_value(n) AS n FROM same GROUP BY node),
sets AS MATERIALIZED (SELECT r AS node, s FROM shingles JOIN nodes ON r = node),
pairs AS MATERIALIZED (
  SELECT a, b FROM (SELECT p.node AS a, q.node AS b, count(*) AS shared FROM sets p JOIN sets q ON p.s = q.s AND p.node < q.node GROUP BY ALL)
  JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs UNION ALL SELECT node, node FROM nodes),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT b AS node, min(d) AS component_id FROM reach JOIN (SELECT node, min(doc_id) AS d FROM same JOIN docs USING (r) GROUP BY node) ON node = a GROUP BY b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM docs LEFT JOIN same USING (r) LEFT JOIN least USING (node)
"""


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import piece_encoding

    return piece_encoding.digested(table(spark, sf_dir, "documents", ("doc_id", "text")), piece_model_path()).drop("text")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import fill_in_middle

    out = fill_in_middle.transform(table(spark, sf_dir, "documents", ("doc_id", "text")))
    size = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    return out.select("doc_id", "n", "form", size("prefix"), size("middle"), digest(F.col("output"), "output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form")), "restored_sha256"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(d, k, 8) AS BIGINT)) AS h FROM t),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 : n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm import lexical_search

    return lexical_search.rank(table(spark, sf_dir, "documents", ("doc_id", "text")), table(spark, sf_dir, "benchmark", ("item_id", "text")))


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM docs WHERE len(w) > 0),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
post AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
sized AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * N) // L) AS m FROM docs, total WHERE len(w) > 0),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS s FROM post JOIN sized USING (r) JOIN weights USING (term)),
scored AS (SELECT item_id, r, doc_id, CAST(sum(q * s) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0) WHERE k <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_html_extraction, op3_quality_classifier, op4_additive_search, op5_curve_packing, op6_url_filter, op7_decontamination,
        op8_secret_scan, op9_token_store, op10_near_dedup, op11_piece_encoding, op12_fill_in_middle, op13_lexical_search,
    )
}
ORACLES: dict[str, str] = {
    "op4_additive_search": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_decontamination": OP7_SQL, "op10_near_dedup": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_lexical_search": OP13_SQL,
}
