"""Documents with odd letters and large vocabularies, through queries and their DuckDB twins."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.operators import sieve, statistics
from lexispark.operators.store import checkpointed, shared_folder
from lexispark.plans import derived as D
from lexispark.plans.queries import ORACLES, QUERIES
from tests.test_queries import rows

#: Queries that don't keep all words of the documents in a table.
LEAVE_FEW = ("winning_parse", "response_nested", "response_contents", "upsert_document", "engine_prior_frequencies", "engine_lookup", "store_batches", "delete_language")


def same(spark, folder, name: str) -> int:
    """A query equals its twin over a folder's documents; returns the number of its rows."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    ran = con.execute(ORACLES[name])
    names, want = [d[0] for d in ran.description], ran.fetchall()
    out = QUERIES[name](spark, str(folder))
    assert rows(out.columns, out.collect()) == rows(names, want)
    return len(want)


def documents(spark, folder, texts) -> None:
    spark.createDataFrame([(k, lang, text) for k, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")


def test_capitals_letter_by_letter(spark):
    words = spark.createDataFrame([("straße ŉ ΐ ﬁ ᾳ éa",)], "w string")
    assert words.select(X.upper_letters(F.col("w"))).first()[0] == "STRAẞE ŉ ΐ ﬁ ᾼ ÉA"


def test_a_replaced_language_keeps_the_letters_of_its_forms(spark, tmp_path):
    documents(spark, tmp_path, [("fr", "enerßge Straßen ießver"), ("en", "enerßge things"), ("fr", "éalise")])
    assert same(spark, tmp_path, "replace_language") == 8


def repeating(spark, folder) -> int:
    """Documents that say few words often; returns the number of their words."""
    words = ["things", "and", "von", "sun", "Other", "moon", "état", "o", "sol"]
    texts = [("fr" if k % 2 else "en", " ".join(words[(k + j * j) % 9] for j in range(400))) for k in range(12)]
    documents(spark, folder, texts)
    return 12 * 400


def held(spark) -> list[Path]:
    at = Path(shared_folder(spark).removeprefix("file://"))
    return sorted(p for p in at.iterdir() if any(p.rglob("*.parquet"))) if at.exists() else []


@pytest.mark.parametrize("name", LEAVE_FEW)
def test_no_table_of_all_words_is_left(spark, tmp_path, name):
    tokens, before = repeating(spark, tmp_path), held(spark)
    same(spark, tmp_path, name)
    left = [p for p in held(spark) if p not in before and p.name.startswith("held-")]
    assert left == [] or max(spark.read.parquet(str(p)).count() for p in left) < tokens / 2


def test_relevant_tokens_give_the_same_statistics(spark, tmp_path):
    repeating(spark, tmp_path)
    tokens = D.tokens(spark, str(tmp_path)).unionByName(spark.createDataFrame([("0", "en", None, "things", "sea"), ("0", "en", None, "o", "sea")], "document_id string, language_code string, pos long, token string, before string"))
    known = checkpointed(D.parses_of(tokens).where("form != 'other'"))
    few = checkpointed(sieve.relevant(tokens, known))
    assert few.count() < tokens.count() and few.where("token = 'o'").count() == 0
    shown = lambda df: sorted((*(str(x) for x in r[:-1]), round(r[-1], 6)) for r in df.collect())
    for counted in (statistics.morph_counts, statistics.prior_counts):
        assert shown(counted(few, known, D.FEATURES)) == shown(counted(tokens, known, D.FEATURES)) != []
    documented = statistics.document_counts(tokens, known)
    assert shown(statistics.document_counts(few, known)) == shown(documented)
    wanted = checkpointed(documented.where("document_id = '3' and lemma_id = 'fr:thing' or document_id = '5'").select("document_id", "lemma_id"))
    some = sieve.document_counts_of(wanted, few, known).join(wanted, ["document_id", "lemma_id"], "left_semi")
    assert shown(some.select(*documented.columns)) == shown(documented.join(wanted, ["document_id", "lemma_id"], "left_semi").select(*documented.columns)) != []
