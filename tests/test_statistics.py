from __future__ import annotations

import random
from collections import defaultdict

from lexispark.functions.powerset import present, subsets
from lexispark.operators import statistics
from lexispark.schemas import FEATURES, PARSES


def parse_rows(spark, rows):
    """rows: (id, lemma_id, form, features)"""
    out = [
        (i, lemma, form, form, form, form, *(f.get(c) for c in FEATURES), "".join(f.get(c, "") for c in FEATURES), "grc") for i, lemma, form, f in rows
    ]
    return spark.createDataFrame(out, PARSES)


def token_rows(spark, documents):
    rows = [(d, "grc", k, t) for d, words in documents.items() for k, t in enumerate(words)]
    return spark.createDataFrame(rows, "document_id string, language_code string, pos long, token string")


def model(documents, parses):
    """The token fold, literally."""
    morph, prior, doc = defaultdict(float), defaultdict(float), defaultdict(float)
    key = lambda f: "".join(f.get(c, "") for c in FEATURES)
    for d, words in documents.items():
        before = []
        for w in words:
            now = [p for p in parses if p[2] == w]
            for _, _, _, f in now:
                items = sorted(f.items())
                for m in range(1 << len(items)):
                    morph[key(dict(x for k, x in enumerate(items) if m >> k & 1))] += 1 / len(now)
            for p in before:
                for q in now:
                    prior[key(p[3]), key(q[3])] += 1 / len(now)
            lemmas = {p[1] for p in now}
            for x in lemmas:
                doc[d, x] += 1 / len(lemmas)
            before = now
    return morph, prior, doc


def test_subsets(spark):
    rows = spark.createDataFrame([("genitive", None, "noun"), (None, None, None)], "grammatical_case string, number string, part_of_speech string")
    got = [[tuple((p.name, p.value) for p in s) for s in r.s] for r in rows.select(subsets(present(("grammatical_case", "number", "part_of_speech"))).alias("s")).collect()]
    assert sorted(map(len, got)) == [1, 4] and all(len(set(g)) == len(g) for g in got)


def test_against_the_fold(spark):
    r = random.Random(4)
    forms = [f"w{k}" for k in range(12)]
    parses, n = [], 0
    for form in forms[:9]:
        for _ in range(r.randint(1, 3)):
            n += 1
            f = {c: r.choice("xyz") for c in r.sample(FEATURES, r.randint(0, 4))}
            parses.append((n, r.randint(1, 5), form, f))
    documents = {f"d{k}": [r.choice(forms) for _ in range(60)] for k in range(4)}
    morph, prior, doc = model(documents, parses)
    tokens, known = token_rows(spark, documents), parse_rows(spark, parses)
    got = {x.feature_key: x["count"] for x in statistics.morph_counts(tokens, known).collect()}
    assert got.keys() == morph.keys() and all(abs(got[k] - morph[k]) < 1e-9 for k in got)
    got = {(x.previous_feature_key, x.current_feature_key): x["count"] for x in statistics.prior_counts(tokens, known).collect()}
    assert got.keys() == prior.keys() and all(abs(got[k] - prior[k]) < 1e-9 for k in got)
    got = {(x.document_id, x.lemma_id): x.weighted_frequency for x in statistics.document_counts(tokens, known).collect()}
    assert got.keys() == doc.keys() and all(abs(got[k] - doc[k]) < 1e-9 for k in got)
    assert abs(sum(v for (d, _), v in doc.items()) - morph[""]) < 1e-9


def test_unknown_word_breaks_the_chain(spark):
    known = parse_rows(spark, [(1, 1, "noun", {"part_of_speech": "noun"}), (2, 2, "verb", {"part_of_speech": "verb"})])
    assert statistics.prior_counts(token_rows(spark, {"d": ["noun", "nothing", "noun"]}), known).count() == 0
    got = statistics.prior_counts(token_rows(spark, {"d": ["noun", "verb"]}), known).collect()
    assert [(x.previous_feature_key, x.current_feature_key, x["count"]) for x in got] == [("noun", "verb", 1.0)]


def test_upsert_adds_up(spark):
    known = parse_rows(spark, [(1, 1, "noun", {"part_of_speech": "noun", "grammatical_case": "genitive"})])
    two, one = (statistics.morph_counts(token_rows(spark, {"d": ["noun"] * n}), known) for n in (2, 1))
    got = {x.feature_key: x["count"] for x in statistics.upsert(two, one, ["language_code", "feature_key"], "count").collect()}
    assert got == {"": 3.0, "genitive": 3.0, "noun": 3.0, "genitivenoun": 3.0}


def test_subsets_some_features_at_a_time(spark):
    """All subsets come out with their weights, through fewer rows than of every vector at once."""
    r = random.Random(6)
    rows = [("lat", *("x" if r.random() < 0.7 else None for _ in FEATURES), 1.0) for _ in range(80)]
    vectors = spark.createDataFrame(rows, ", ".join(["language_code string", *(f"{c} string" for c in FEATURES), "weight double"]))
    want = defaultdict(float)
    for row in rows:
        there = [k for k, v in enumerate(row[1:-1]) if v]
        for m in range(1 << len(there)):
            want[tuple(v if k in there and m >> there.index(k) & 1 else None for k, v in enumerate(row[1:-1]))] += 1.0
    out = statistics.subset_rows(vectors, FEATURES)
    got = {tuple(x[c] for c in FEATURES): x["w"] for x in out.groupBy(*FEATURES).agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    assert got == want
    assert out.count() < sum(1 << sum(v is not None for v in row[1:-1]) for row in rows) / 2
