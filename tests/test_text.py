from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.sources.lexica import tag_of
from lexispark.sources.morph import language_of_file


def values(spark, words, f, kind="string"):
    rows = spark.createDataFrame([(k, w) for k, w in enumerate(words)], f"k int, w {kind}")
    return [r.v for r in rows.select("k", f(F.col("w")).alias("v")).orderBy("k").collect()]


def test_bare_form(spark):
    assert values(spark, ["'kh/pou", "*)ori/wn", "'a", None], X.bare_form) == ["khpou", "oriwn", "a", None]


def test_lower_case(spark):
    load = lambda code: lambda c: X.load_form(F.lit(code), c)
    assert values(spark, ["*)ori/wn", "a", "'Κήπου"], load("grc")) == [")ori/wn", "a", "'κήπου"]
    assert values(spark, ["REDEUNTES"], load("lat")) == ["redeuntes"]
    assert values(spark, ["ABC"], load("ara")) == ["ABC"]
    query = lambda code: lambda c: X.query_form(F.lit(code), c)
    assert values(spark, ["'Κήπου", "Κῆπος", "*a", ""], query("grc")) == ["'Κήπου", "κῆπος", "a", ""]


def test_normalize_unicode(spark):
    assert values(spark, ["Ὠρίων", "ωριων", None, ""], X.normalize_unicode) == ["ωριων", "ωριων", None, ""]


def test_lemma_parts(spark):
    got = values(spark, ["rego", "rego2", "re#go2", "per-rego1", "12", "a1b2"], X.lemma_parts)
    assert [tuple(r) for r in got] == [("rego", -1), ("rego", 2), ("rego", 2), ("rego", 1), ("12", -1), ("a1b2", -1)]


def test_ids_tags_levels(spark):
    assert [tuple(r) for r in values(spark, ["n1.1", "bad-id", "n208c.7d", None], X.sense_ids)] == [("1", "1"), ("-1", "-1"), ("208c", "7d"), ("-1", "-1")]
    ids = ["any:text:1999.04.0073", "any:text:1999.04.0060", "other"]
    assert values(spark, ids, X.meaning_tag) == ["g", "l", "i"] == [tag_of(x) for x in ids]
    assert values(spark, ["2", None], X.stored_level) == [2, -1]
    assert values(spark, [-1, 3], X.shown_level, "int") == [None, 3]


def test_languages():
    assert [language_of_file(x) for x in ("a/greek.morph.jsonl", "latin.morph.jsonl", "xyz.jsonl")] == ["grc", "lat", "xyz"]


@pytest.mark.parametrize(("beta", "greek"), [("khpw/n", "κηπών"), ("*)ori/wn", "Ὀρίων"), ("ka/pros", "κάπρος"), ("a)/rktos", "ἄρκτος"), ("kh/pw|", "κήπῳ"), ("κάπρος", "κάπρος"), (None, None), ("", "")])
def test_beta_code(beta, greek):
    assert X.beta_to_greek(beta) == greek
