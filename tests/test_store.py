"""The store's runs, their compaction, the index of spellings, versions, and chains across parts of files."""

from __future__ import annotations

import json
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexispark.operators import lookup, migrations, statistics
from lexispark.operators.store import VERSION, Store
from lexispark.plans.engine import Engine
from lexispark.schemas import PARTS, TABLES
from lexispark.streaming.corpus import follow
from tests.test_statistics import model


def counts(spark, rows):
    features = [f.name for f in TABLES["morph_frequencies"][0].fields if f.name not in ("language_code", "feature_key", "count")]
    df = spark.createDataFrame(rows, "language_code string, feature_key string, count double")
    return {"morph_frequencies": df.select("language_code", *(F.lit(None).cast("string").alias(c) for c in features), "feature_key", "count")}


def size(path) -> int:
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_batches_are_appended_and_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), fan_in=3)
    want = defaultdict(float)
    r = random.Random(1)
    levels = []
    for number in range(11):
        rows = [("lat", f"k{r.randint(0, 30)}", float(r.randint(1, 9))) for _ in range(20)]
        rows = [(a, k, sum(c for _, x, c in rows if x == k)) for a, k in {(a, k) for a, k, _ in rows}]
        for _ in range(2):  # told twice, counted once
            store.accumulate(counts(spark, rows), ("b", number))
        for _, k, c in rows:
            want[k] += c
        assert {x.feature_key: x["count"] for x in store.read("morph_frequencies").collect()} == want
        levels.append(sorted(x["level"] for x in store.runs("morph_frequencies")))
    assert levels[2] == [1] and levels[3] == [0, 1] and levels[8] == [2] and levels[10] == [0, 0, 2]


def test_a_batch_writes_what_it_holds(spark, tmp_path):
    """A small batch into a large table writes little, whatever lies there."""
    store = Store(spark, str(tmp_path / "s"))
    r = random.Random(3)
    store.accumulate(counts(spark, [("lat", f"key number {k} {r.random()}" if k != 7 else "key number 7", 1.0) for k in range(20_000)]))
    before = size(tmp_path / "s")
    store.accumulate(counts(spark, [("lat", "key number 7", 1.0)]))
    assert size(tmp_path / "s") - before < before / 20
    assert store.read("morph_frequencies").where("feature_key = 'key number 7'").first()["count"] == 2.0


def test_loading_a_language_leaves_the_others_where_they_are(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    for name, form in (("greek", "λόγος"), ("latin", "verbum")):
        (tmp_path / f"{name}.morph.jsonl").write_text(json.dumps({"form": form, "lemma": form, "pos": "noun"}))
        engine.load_morph(str(tmp_path / f"{name}.morph.jsonl"))
    greek = engine.store.runs("parses", ["grc"])
    engine.load_morph(str(tmp_path / "latin.morph.jsonl"))
    assert engine.store.runs("parses", ["grc"]) == greek
    assert sorted(r.form for r in engine.store.read("parses").collect()) == ["verbum", "λόγος"]


@pytest.fixture
def large(spark, tmp_path):
    lines = [json.dumps({"form": f"Verbum{k}", "lemma": f"verb{k % 977}um", "pos": "noun" if k % 3 else "verb", "number": "singular"}) for k in range(5000)]
    (tmp_path / "latin.morph.jsonl").write_text("\n".join(lines))
    engine = Engine(spark, str(tmp_path / "s"))
    engine.load_morph(str(tmp_path / "latin.morph.jsonl"))
    return engine


def asked(spark, words):
    return spark.createDataFrame([(k, w, "lat", None, None) for k, w in enumerate(words)], "request_id long, word string, language_code string, document_id string, prior_word string")


def test_few_spellings_read_few_buckets(spark, large):
    few = large.candidates(asked(spark, ["verbum17", "VERBUM4"]))
    plan = few._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan or "SelectedBucketsCount: 2 out of 8" in plan
    assert sorted((r.word, r.tier, r.form) for r in few.collect()) == [("VERBUM4", 1, "verbum4"), ("verbum17", 1, "verbum17")]


def test_many_spellings_do_not_shuffle_the_index(spark, large):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = large.candidates(asked(spark, [f"verbum{k}" for k in range(3000)]))
        plan = many._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("Join") :]
        scans = [line for line in join.splitlines() if "spark_catalog.default.lexispark" in line or "Exchange" in line]
        assert sum("Exchange" in line for line in scans) == 1 and any("lexispark" in line for line in scans)
        assert many.count() == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_index_is_found_by_another_session(spark, large):
    other = Engine(spark, large.store.path)
    for run in other.store.runs("spellings"):
        spark.sql(f"DROP TABLE IF EXISTS {run['table']}")
    got = other.lookup(asked(spark, ["verbum17", "nothing"])).orderBy("request_id").collect()
    assert [x.headword for x in got[0].lemmas] == ["verb17um"] and got[1].lemmas == []
    assert got[0].lemmas[0].senses == [] and got[0].lemmas[0].entries == []
    assert "senses" in json.loads(other.lookup(asked(spark, ["verbum17"])).toJSON().first())["lemmas"][0]


def test_index_equals_plain_look_up(spark, large):
    words = ["Verbum3", "VERBUM9", "verbum12", "verbúm3", "x", ""]
    requests = asked(spark, words)
    plain = lookup.lookup(requests, large.store.read("parses"))
    indexed = lookup.of_requests(requests, large.candidates(requests))
    shown = lambda df: sorted((r.request_id, r.tier, r.id) for r in df.collect())
    assert shown(plain) == shown(indexed) and len(shown(plain)) == 4


def test_versions(spark, large):
    """Back to the first layout and up again: the rows stay; a step taken before changes nothing."""
    store = large.store
    large.add_tokens(spark.createDataFrame([("d", "lat", 0, "Verbum3"), ("d", "lat", 1, "verbum4")], "document_id string, language_code string, pos long, token string"))
    store.replace("senses", spark.createDataFrame([(1, "1", "1", "entry=a", None, -1, "x", "Lewis & Short: 1/2")], TABLES["senses"][0]), "document_id", ["Lewis & Short: 1/2"])
    names = [n for n in TABLES if n != "spellings"]
    rows = lambda: {n: sorted(map(str, store.read(n).collect())) for n in names}
    before = rows()
    assert migrations.migrate(store, 1) == [3, 2, 1]
    assert all(isinstance(path, str) for path in store.state()["tables"].values()) and "spellings" not in store.state()["tables"]
    again = Engine(spark, store.path)  # opening it takes the steps
    assert store.state()["version"] == VERSION and rows() == before
    state = store.state()
    assert migrations.migrate(store) == [] and store.state() == state
    assert again.lookup(asked(spark, ["verbum17"])).first().lemmas[0].headword == "verb17um"


def fold(files, parses):
    """The token fold over files: each a chain, counts of one document's files added up."""
    out = [defaultdict(float), defaultdict(float), defaultdict(float)]
    for document, words in files:
        for total, one in zip(out, model({document: words}, parses), strict=True):
            for k, v in one.items():
                total[k] += v
    return out


PARSES = [(1, 1, "aa", {"part_of_speech": "noun"}), (2, 2, "bb", {"part_of_speech": "verb"}), (3, 3, "cc", {"part_of_speech": "adj"}), (4, 4, "dd", {"part_of_speech": "adv"}), (5, 5, "bb", {"part_of_speech": "noun"})]


def loaded(spark, tmp_path) -> Engine:
    lines = [json.dumps({"form": form, "lemma": f"l{chr(96 + lemma)}", "pos": f["part_of_speech"]}) for _, lemma, form, f in PARSES]
    (tmp_path / "latin.morph.jsonl").write_text("\n".join(lines))
    engine = Engine(spark, str(tmp_path / "store"))
    engine.load_morph(str(tmp_path / "latin.morph.jsonl"))
    return engine


def stored(engine):
    s = engine.store
    prior = {(r.previous_feature_key, r.current_feature_key): r["count"] for r in s.read("prior_frequencies").collect()}
    return {r.feature_key: r["count"] for r in s.read("morph_frequencies").collect()}, prior, {(r.document_id, r.lemma_id): r.weighted_frequency for r in s.read("document_frequencies").collect()}


def test_two_files_of_one_name_are_two_chains(spark, tmp_path):
    engine = loaded(spark, tmp_path)
    files = [("x-lat1", "aa bb aa".split()), ("x-lat1", "cc dd cc".split()), ("y-lat2", "bb zz cc".split())]
    for folder, (name, words) in zip("abc", files, strict=True):
        (tmp_path / "corpus" / folder).mkdir(parents=True)
        (tmp_path / "corpus" / folder / f"{name}.xml").write_text(f"<t>{' '.join(words)}</t>")
    (tmp_path / "corpus" / "broken-lat1.xml").write_text("<t>aa")
    assert engine.aggregate(str(tmp_path / "corpus")) == {"files": 4, "failed": 1, "tokens": 9}
    assert [got == want for got, want in zip(stored(engine), fold(files, PARSES), strict=True)] == [True] * 3


@pytest.mark.parametrize("seed", range(2))
def test_parts_of_files_in_several_batches(spark, tmp_path, seed):
    """Parts, some without words, come in any order and batch; rows without a file are texts of their own."""
    engine, r = loaded(spark, tmp_path), random.Random(seed)
    files, rows = [], []
    for k in range(8):
        words = [r.choice(["aa", "bb", "cc", "dd", "zz"]) for _ in range(r.randint(0, 12))]
        cuts = sorted(r.randint(0, len(words)) for _ in range(r.randint(0, 4)))
        files.append((f"doc{k // 2}", words))
        for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(words)])):
            rows.append((f"doc{k // 2}", "lat", f"file{k}", seq, " ".join(words[a:b]) if b > a or k % 2 else None))
    for k in range(3):
        files.append(("doc0", ["aa", "cc"]))
        rows.append(("doc0", "lat", None, None, "aa cc"))
    r.shuffle(rows)
    want = fold(files, PARSES)
    whole = statistics.tokens_of(spark.createDataFrame(rows, PARTS))
    pairs = statistics.prior_counts(whole, engine.store.read("parses")).collect()
    assert {(x.previous_feature_key, x.current_feature_key): pytest.approx(x["count"]) for x in pairs} == want[1]
    for number in range(3):
        spark.createDataFrame(rows[number::3], PARTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
        if number != 1:  # two files' batches go together
            follow(engine, str(tmp_path / "stream"), str(tmp_path / "checkpoint")).awaitTermination(200)
    for got, expected in zip(stored(engine), want, strict=True):
        assert got == pytest.approx(expected)
