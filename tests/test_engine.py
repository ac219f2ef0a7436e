from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexispark.cli import main
from lexispark.operators import statistics
from lexispark.plans.engine import Engine
from lexispark.streaming.corpus import follow, follow_corpus

GREEK = [
    {"form": "κῆπον", "lemma": "κῆπος", "pos": "noun", "case": "accusative"},
    {"form": "τέμνε", "lemma": "τέμνω", "pos": "verb", "mood": "imperative"},
    {"form": "τέμνε", "lemma": "τέμνω", "pos": "verb", "mood": "indicative"},
    {"form": "τέμνε", "lemma": "τομή", "pos": "noun"},
    {"form": "Ὀρίων", "lemma": "Ὀρίων", "pos": "noun"},
    {"form": "Ὀρίων"},
]


def store(spark, tmp_path) -> Engine:
    records = tmp_path / "greek.morph.jsonl"
    records.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in GREEK))
    (tmp_path / "latin.morph.jsonl").write_text('{"form": "res", "lemma": "res", "pos": "noun"}')
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "one-grc1.xml").write_text("<t>κῆπον τέμνε</t>")
    (corpus / "two-grc1.xml").write_text("<t>κῆπον</t>")
    short = tmp_path / "short.tsv"
    short.write_text("τέμνω to cut\nκῆπος garden\n")
    full = tmp_path / "full.xml"
    full.write_text('<x><entry key="τέμνω"><sense id="n1.1" n="1">cut</sense></entry></x>')
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.load_morph(str(records)) == {"analyses": 6, "parses": 5}
    engine.load_morph(str(tmp_path / "latin.morph.jsonl"))
    assert engine.aggregate(str(corpus)) == {"files": 2, "failed": 0, "tokens": 3}
    assert engine.ingest_lexicon("Logeion-Greek-Shortdef", str(short)) == {"senses": 2, "entries": 0}
    engine.ingest_lexicon("LSJ", str(full))
    return engine


def test_end_to_end(spark, tmp_path):
    engine = store(spark, tmp_path)
    morph = {r.feature_key: r["count"] for r in engine.store.read("morph_frequencies").collect()}
    assert abs(morph[""] - 3) < 1e-9 and abs(morph["noun"] - (2 + 1 / 3)) < 1e-9
    asked = spark.createDataFrame([(1, "Τέμνε", "grc", "one-grc1", "κῆπον"), (2, "ori/wn", "grc", None, None), (3, "ΟΡΊΩΝ", "grc", "", None), (4, "nothing", "grc", None, None)], "request_id long, word string, language_code string, document_id string, prior_word string")
    got = {r.request_id: r for r in engine.lookup(asked).collect()}
    first = got[1].lemmas
    assert [(x.headword, x.document_frequency, x.short_definition) for x in first] == [("τέμνω", 0.5, "to cut"), ("τομή", 0.5, None)]
    assert sum(p.is_winner for x in first for p in x.parses) == 1
    assert [s.document_id for s in first[0].senses] == ["Logeion-Greek-Shortdef", "LSJ"] and first[0].entries[0].text.startswith("<sense")
    assert got[2].lemmas[0].headword == got[3].lemmas[0].headword == "Ὀρίων" and got[2].lemmas[0].parses[0].is_winner
    assert got[3].lemmas[0].document_frequency is None and got[4].lemmas == []
    out = json.loads(main(["-d", str(tmp_path / "store"), "lookup", "κῆπον"], spark))
    assert out["word"] == "κῆπον" and out["lemmas"][0]["headword"] == "κῆπος"


def test_replacing(spark, tmp_path):
    engine = store(spark, tmp_path)
    s = engine.store
    count = lambda name, column, value: s.read(name).where(f"{column} = '{value}'").count()
    before = s.read("morph_frequencies").count()
    engine.load_morph(str(tmp_path / "greek.morph.jsonl"), replace=False)
    assert count("parses", "language_code", "grc") == 5
    s.delete_language("grc")
    assert (count("lemmas", "language_code", "grc"), count("parses", "language_code", "grc"), s.read("document_frequencies").count()) == (0, 0, 0)
    assert count("lemmas", "language_code", "lat") == 1 and s.read("morph_frequencies").count() == before
    s.clear_lexicon("LSJ")
    assert s.read("entries").count() == 0 and s.read("senses").count() == 2


def test_streaming(spark, tmp_path):
    engine = store(spark, tmp_path)
    folder = tmp_path / "stream"
    rows = spark.createDataFrame([("s1", "grc", "κῆπον τέμνε"), ("s2", "grc", "κῆπον")], "document_id string, language_code string, text string")
    rows.write.parquet(str(folder))
    for _ in range(2):  # the second run finds nothing new
        follow(engine, str(folder), str(tmp_path / "stream-checkpoint")).awaitTermination(120)
    assert abs({r.feature_key: r["count"] for r in engine.store.read("morph_frequencies").collect()}[""] - 6) < 1e-9


def test_a_failed_batch_leaves_the_statistics_as_they_were(spark, tmp_path, monkeypatch):
    """A crash between the three statistics, and a retry, count the batch once."""
    engine = store(spark, tmp_path)
    s, words = engine.store, spark.createDataFrame([("d", "grc", 0, "κῆπον")], "document_id string, language_code string, pos long, token string")
    total = lambda: {r.feature_key: r["count"] for r in s.read("morph_frequencies").collect()}[""]
    before, documents = total(), s.read("document_frequencies").count()
    whole = statistics.document_counts

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(statistics, "document_counts", broken)
    with pytest.raises(RuntimeError):
        engine.add_tokens(words, ("stream", 3))
    failing = whole(words, s.read("parses")).withColumn("weighted_frequency", F.raise_error(F.lit("executor lost")).cast("double"))
    monkeypatch.setattr(statistics, "document_counts", lambda *_: failing)
    with pytest.raises(Exception, match="executor lost"):  # the other statistics' files are written by then
        engine.add_tokens(words, ("stream", 3))
    assert total() == before and s.read("document_frequencies").count() == documents
    monkeypatch.setattr(statistics, "document_counts", whole)
    for _ in range(2):
        engine.add_tokens(words, ("stream", 3))
    assert abs(total() - before - 1) < 1e-9 and s.read("document_frequencies").count() == documents + 1
    assert len(s._states()) == 2  # older states are tidied away


def test_a_corpus_is_followed(spark, tmp_path):
    """Files found by a run count in it alone; broken ones and those of other languages don't."""
    engine = store(spark, tmp_path)
    total = lambda: {r.feature_key: r["count"] for r in engine.store.read("morph_frequencies").collect()}[""]
    before, folder = total(), tmp_path / "growing" / "sub"
    folder.mkdir(parents=True)
    (folder / "x-grc1.xml").write_text("<t>κῆπον τέμνε</t>")
    (folder / "y-eng1.xml").write_text("<t>κῆπον</t>")
    (folder / "z-grc1.xml").write_text("<t>κῆπον")
    def counted() -> float:
        follow_corpus(engine, str(tmp_path / "growing"), str(tmp_path / "corpus-checkpoint")).awaitTermination(200)
        return total() - before

    assert counted() == pytest.approx(2) and counted() == pytest.approx(2)
    (folder / "w-grc1.xml").write_text("<t>κῆπον</t>")
    assert counted() == pytest.approx(3)


def test_commands(spark, tmp_path, capsys):
    """load, ingest and aggregate by the command line tell what the engine tells."""
    (tmp_path / "greek.morph.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in GREEK))
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "one-grc1.xml").write_text("<t>κῆπον τέμνε</t>")
    (tmp_path / "short.tsv").write_text("τέμνω to cut\nκῆπος garden\n")
    db = ["-d", str(tmp_path / "store")]
    assert json.loads(main([*db, "load", str(tmp_path / "greek.morph.jsonl")], spark)) == {"analyses": 6, "parses": 5}
    assert json.loads(main([*db, "load", "-n", "-l", "grc", str(tmp_path / "greek.morph.jsonl")], spark)) == {"analyses": 6, "parses": 5}
    assert json.loads(main([*db, "ingest", "Logeion-Greek-Shortdef", str(tmp_path / "short.tsv")], spark)) == {"senses": 2, "entries": 0}
    assert json.loads(main([*db, "aggregate", str(tmp_path / "corpus")], spark)) == {"files": 1, "failed": 0, "tokens": 2}
    got = json.loads(main([*db, "lookup", "--document", "one-grc1", "--prior", "κῆπον", "te/mne"], spark))
    assert got["lemmas"][0]["short_definition"] == "to cut" and got["lemmas"][0]["document_frequency"] == 0.5 and got["lemmas"][0]["entries"] == []
    with pytest.raises(SystemExit) as stopped:
        main(["--help"], spark)
    assert stopped.value.code == 0 and "aggregate" in capsys.readouterr().out
