from __future__ import annotations

import pytest

from lexispark.operators.ordering import numbered, suffixed_repeats
from lexispark.sources import lexica, morph, tei, tei_elements, tei_lexicon

CORPUS = "<TEI><text><body><l n='4'>κῆπος θάλλει <note>gloss <bibl>x</bibl></note>καλῶς</l></body></text></TEI>"


@pytest.mark.parametrize(
    ("xml", "words"),
    [
        (CORPUS, ["κῆπος", "θάλλει", "καλῶς"]),
        ("<scene><head>IV</head><figure>map</figure><p>cras redibo domum</p></scene>", ["cras", "redibo", "domum"]),
        ("<p>cras<gap>lost</gap>redibo</p>", ["cras", "redibo"]),
        ("<p><hi>cras</hi><hi>tinus</hi></p>", ["crastinus"]),
        ('<!DOCTYPE p SYSTEM "http://nowhere.invalid/none.dtd"><p>cras</p>', ["cras"]),
    ],
)
def test_corpus_text(xml, words):
    assert tei.text_of(xml).split() == words


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.b.c-grc2.xml", CORPUS), ("sub/d.e.f-lat1.xml", "<p>cras redibo</p>"), ("g-eng3.xml", "<l>no</l>"), ("h-grc1.xml", "<l>broken"), ("__cts__.xml", "<l/>")):
        (tmp_path / name).write_text(body)
    rows = {r.document_id: r for r in tei.corpus(spark, str(tmp_path)).collect()}
    assert {k: r.language_code for k, r in rows.items()} == {"a.b.c-grc2": "grc", "d.e.f-lat1": "lat", "h-grc1": "grc"}
    assert rows["h-grc1"].text is None and rows["h-grc1"].error
    got = [(r.document_id, r.pos, r.token) for r in tei.corpus_tokens(spark, str(tmp_path)).orderBy("document_id", "pos").collect()]
    assert got == [("a.b.c-grc2", 0, "κῆπος"), ("a.b.c-grc2", 1, "θάλλει"), ("a.b.c-grc2", 2, "καλῶς"), ("d.e.f-lat1", 0, "cras"), ("d.e.f-lat1", 1, "redibo")]


LEXICON = """<TEI><body><entryFree key="khpos"><orth>k</orth><sense id="n1.1" n="1" level="1">garden, <tr>orchard</tr> <cit n="b" a="&quot;"><bibl>x &amp; y</bibl></cit></sense>
<sense id="bad" n="2"/><sense id="n1.2"><sense id="n1.3">inner</sense></sense></entryFree><entry key="b"><sense>two</sense></entry></body></TEI>"""


def test_lexicon_rows():
    rows = list(tei_lexicon.lexicon_rows(LEXICON.encode(), "g"))
    assert [(r["kind"], r["key"], r["xml_id"]) for r in rows] == [("sense", "khpos", "n1.1"), ("sense", "khpos", "bad"), ("sense", "khpos", "n1.2"), ("sense", "khpos", "n1.3"), ("entry", "khpos", None), ("sense", "b", None), ("entry", "b", None)]
    assert rows[0]["text"] == 'garden, <g>orchard</g><cit a="&quot;" n="b"><bibl>x &amp; y</bibl></cit>'
    assert rows[1]["text"] == rows[2]["text"] == tei_lexicon.NO_MEANING and rows[3]["text"] == "inner"
    assert rows[4]["text"].startswith('<orth>k</orth><sense id="n1.1" level="1" n="1">garden, <tr>orchard</tr>')


def test_lexicon_tables(spark, tmp_path):
    (tmp_path / "b.xml").write_text(LEXICON)
    (tmp_path / "a.tsv").write_text("lemma\tdef\nfoo  first thing \n\nbare\nbar\tsecond\n")
    senses, entries = lexica.tables(spark, "X:text:1999.04.0057", str(tmp_path))
    got = [(r.lemma, r.entry_id, r.sense_id, r.level, r.definition[:12]) for r in senses.orderBy("id").collect()]
    assert got[:3] == [("entry=foo", "-1", "-1", None, "first thing"), ("entry=bar", "-1", "-1", None, "second"), ("entry=khpos", "1", "1", 1, "garden, <g>o")]
    assert got[3][1:4] == ("-1", "-1", -1) and entries.count() == 2
    (tmp_path / "c.xml").write_text("<x><entry key='b'/></x>")
    with pytest.raises(ValueError, match="'b'"):
        lexica.tables(spark, "X", str(tmp_path))


def test_repeated_keys_are_numbered(spark, tmp_path):
    """Through files in order of their names, nested entries among them; senses go with their entries."""
    (tmp_path / "2.xml").write_text('<r><entry key="a"><sense id="n1.4">d</sense></entry><entry key="c"/></r>')
    (tmp_path / "1.xml").write_text('<r><entry key="a"><sense id="n1.1">a</sense><entry key="a"><sense id="n1.2">b</sense></entry></entry><entry key="b"><sense id="n1.3">c</sense></entry></r>')
    senses, entries = lexica.tables(spark, "X", str(tmp_path), number_repeats=True)
    assert [(r.lemma, r.definition) for r in senses.orderBy("id").collect()] == [("entry=a", "a"), ("entry=a", "b"), ("entry=a2", "b"), ("entry=b", "c"), ("entry=a3", "d")]
    assert sorted(r.key for r in entries.collect()) == ["a", "a2", "a3", "b", "c"]
    (tmp_path / "3.xml").write_text('<r><entry key="a2"/></r>')
    with pytest.raises(ValueError, match="'a2'"):
        lexica.tables(spark, "X", str(tmp_path), number_repeats=True)


def test_repeats_with_null_and_hot_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "hot" if k % 3 else f"k{k % 4}") for k in range(400)], "n int, key string").repartition(7)
    seen, expected = {}, []
    for n, key in sorted((r.n, r.key) for r in rows.collect() if r.key is not None):
        seen[key] = seen.get(key, 0) + 1
        expected.append((n, key if seen[key] == 1 else f"{key}{seen[key]}"))
    got = suffixed_repeats(rows, "key", "n")
    assert got.columns == ["n", "key"] and got.where("key is null").count() == 80
    assert sorted((r.n, r.key) for r in got.collect() if r.key is not None) == expected


def test_morph_records(spark, tmp_path):
    path = tmp_path / "latin.morph.jsonl"
    path.write_text('{"form": "Rexi", "lemma": "rego2", "pos": "verb", "orth": "rēxī"}\n\n{"lemma": "x"}\n{"form": "rexi", "lemma": "rego2", "pos": "verb"}\n{"form": "res", "lemma": "res", "pos": "noun", "case": "nominative", "zzz": 1}\n')
    lemmas, parses = morph.tables(morph.records(spark, str(path)))
    assert [(r.id, r.headword, r.sequence_number, r.language_code) for r in lemmas.orderBy("id").collect()] == [(1, "rego", 2, "lat"), (2, "res", -1, "lat")]
    assert [(r.id, r.lemma_id, r.form, r.expanded_form, r.dedup_key) for r in parses.orderBy("id").collect()] == [(1, 1, "rexi", "rēxī", "verb"), (2, 2, "res", "res", "nominativenoun")]
    with pytest.raises(ValueError, match="unknown language"):
        morph.tables(morph.records(spark, str(path), "xx"))
    path.write_text('{"form": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        morph.records(spark, str(path)).collect()


def test_analysis_xml(spark, tmp_path):
    path = tmp_path / "greek.xml"
    path.write_text("<r><analysis><form>ka/pros</form><lemma>ka/pros</lemma><pos>noun</pos></analysis></r>")
    assert [(r.form, r.lemma, r.pos) for r in morph.from_xml(spark, str(path), greek=True).collect()] == [("κάπρος", "κάπρος", "noun")]


def test_numbering(spark):
    rows = spark.createDataFrame([(k * 7 % 101, f"k{k % 3}") for k in range(101)], "a int, key string")
    assert [r.id for r in numbered(rows, ["a"]).orderBy("a").collect()] == list(range(1, 102))
    got = [r.key for r in suffixed_repeats(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "n int, key string"), "key", "n").orderBy("n").collect()]
    assert got == ["a", "a2", "b", "a3"]


FIDELITY = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a > b <entry key="no"> -->
<!DOCTYPE TEI SYSTEM "nowhere.dtd" [ <!ENTITY own "an own > one"> ]>
<TEI xmlns:x="u"><body><![CDATA[ <entry key="no"> ]]><?pi > <entry> ?>
<entryFree key="a > b" id='q"e'><orth xml:lang="la">w</orth><sense xml:id="n9.9" n="1">one &mdash; <foreign xml:lang="greek">two</foreign> &own; > three</sense><entry key="in"><sense id="n1.2">inner</sense></entry></entryFree>
<div0 n="B"><x:entry key="other"/><ENTRY key="c"/><entry key="d"><sense level="2" id="n4.5"><!-- <entry> > --><hi rend="a>b">kept</hi><![CDATA[ <entry> ]]></sense></entry></div0>
</body></TEI>
"""


def test_lexicon_names_and_entities():
    rows = list(tei_lexicon.lexicon_rows(FIDELITY.encode(), "g", chunk=7))
    assert [(r["kind"], r["entry"], r["ordinal"], r["key"], r["xml_id"]) for r in rows] == [
        ("sense", 0, 0, "a > b", None), ("sense", 0, 1, "a > b", "n1.2"), ("entry", 0, -1, "a > b", None), ("sense", 0, 2, "in", "n1.2"), ("entry", 0, -1, "in", None),
        ("entry", 1, -1, "c", None), ("sense", 2, 0, "d", "n4.5"), ("entry", 2, -1, "d", None),
    ]
    assert rows[0]["text"] == 'one  <foreign xml:lang="greek">two</foreign> an own > one > three'
    assert rows[2]["text"].startswith('<orth xml:lang="la">w</orth><sense n="1" xml:id="n9.9">one  <foreign')
    assert rows[6]["text"] == "<g>kept</g> <entry> "
    with pytest.raises(Exception, match="undefined entity"):
        list(tei_lexicon.lexicon_rows(b"<x><entry>&mdash;</entry></x>", "g"))


@pytest.mark.parametrize("bytes_a_split", [40, 150, 1 << 20])
def test_lexicon_splits(spark, tmp_path, bytes_a_split):
    """Files read in splits of any size give the rows of files read whole."""
    (tmp_path / "a.xml").write_text(FIDELITY)
    many = "".join(f'<entry key="k{k}" n="a>b"><sense n="{k}">{"é" * (k % 7)} <!-- > --> text {k}</sense></entry>\n' for k in range(60))
    (tmp_path / "b.xml").write_text(f"<x>{many}</x>")
    (tmp_path / "c.xml").write_text("<x><entry key='only'/></x>\n<!-- end -->\n")
    paths = [str(tmp_path / f"{n}.xml") for n in "abc"]
    want = [{"file": f"file:{p}", **r} for p in paths for r in tei_lexicon.lexicon_rows(open(p, "rb").read(), "g")]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, str(bytes_a_split))
    try:
        df = tei_lexicon.lexicon(spark, paths, "g")
        if bytes_a_split == 40:
            assert tei_lexicon._pieces(spark, paths).rdd.getNumPartitions() > 50
        shown = lambda rows: sorted(str(sorted(r.items())) for r in rows)
        assert shown(r.asDict() for r in df.collect()) == shown(want)
        for bad in ("<x><entry key='a'><sense>x</entry></x>", "<x><entry key='a'/>", "<x><entry key='a'/></y>", "<x><entry key='a'>", '<?xml version="1.0" encoding="latin1"?><x/>'):
            (tmp_path / "bad.xml").write_text(bad)
            with pytest.raises(Exception):  # noqa: B017
                tei_lexicon.lexicon(spark, [str(tmp_path / "bad.xml")], "g").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_element_list(spark):
    shown = lambda text: [(r[0], r[1], r[2], r[3], r[5]) for r in tei_elements.element_list(text)]
    assert shown("<a>x<b k='1'>y</b><!-- no -->z<c/></a>") == [(0, 5, 0, "a", None), (1, 1, 1, None, "x"), (2, 3, 1, "b", None), (3, 3, 2, None, "y"), (4, 4, 1, None, "z"), (5, 5, 1, "c", None)]
    assert shown("x <b>y</b>") == [(0, 3, 0, "span", None), (1, 1, 1, None, "x "), (2, 3, 1, "b", None), (3, 3, 2, None, "y")]
    assert shown("x < y") == [(0, 0, 0, None, "x < y")] and shown("") == [(0, 0, 0, "span", None)]
    docs = spark.createDataFrame([(1, "<a>x<b>y<b>z</b></b><b>w</b></a>"), (2, None), (3, "plain")], "id long, t string")
    found = tei_elements.elements(docs, "t")
    assert {r.id: r.n for r in found.groupBy("id").count().withColumnRenamed("count", "n").collect()} == {1: 8, 3: 2}
    assert [(r.id, r.text) for r in tei_elements.text_within(found, "id", "b").collect()] == [(1, "yzw")]
    assert found.where("tag = 'b'").first().attributes == {}
