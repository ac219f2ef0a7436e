from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import additive_search, site_style, url_filter
from lexispark.llm.queries import ORACLES, QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><div id=cookie-notice>accept</div>
<article><header><h1>Head &amp; line</h1></header><p><b>One  two<br>three<p>Fr&eacute;d&#233;ric &copy<ul><li>x<li>y</ul><aside>side</aside><form>mail <input></form></article>
<section class="comments"><article class="comment"><p>first!</p></article></section><footer>&copy; end"""


def test_main_text():
    assert site_style.main_text(PAGE, frozenset()) == "Head & line\nOne two three\nFrédéric ©\nx\ny"
    assert site_style.main_text("<p>plain</p>tail &amp", frozenset()) == "plain\ntail &"
    assert site_style.main_text("a < b", frozenset()) == "a < b"
    for odd in (None, "", "<!--", "<p", "</p></b>", "<script>x", "<p>" * 3000):
        assert site_style.main_text(odd, frozenset()) == ""


@pytest.mark.parametrize("attribute", ["class=userComments", "class=respond", "class='x newsletterBox'", "class=byline-share", "id=relatedPosts class=relatedLinks", "class=reader_comments"])
def test_names_inside_an_article(attribute):
    assert site_style.main_text(f"<article><p>own</p><div {attribute}><p>other</p></div><p>end</p></article>") == "own\nend"


def test_names_that_only_look_like_boilerplate():
    for name in ("commentary", "userGuide", "adverbs", "shareholders", "navigationalChart", "researchFindings", "byline", "readers"):
        assert site_style.main_text(f"<article class={name}><p>own</p><div class={name}><p>more</p></div></article>") == "own\nmore"
    assert site_style.main_text("<article><p>own</p></article><article class=teaser><p>another</p></article>") == "own"


def test_style_tree_removes_what_a_site_repeats(spark):
    page = lambda k: f"<html><body><div class=x1><span>Welcome to our site</span></div><div class=body><p>own text {k} {k * 7}</p></div></body></html>"
    rows = [(k, "http://a.example/p", page(k), 1) for k in range(12)] + [(90, None, None, 1), (91, "http://b.example/", page(5), 1), (91, "http://b.example/", page(5), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = site_style.extract(pages)
    assert out.columns == ["page_id", "url", "html", "text", "_text"]
    got = [(r.page_id, r["_text"]) for r in out.collect()]
    assert sorted(got)[:12] == [(k, f"own text {k} {k * 7}") for k in range(12)]
    assert (90, "") in got and got.count((91, "Welcome to our site\nown text 5 35")) == 2
    assert site_style.extract(pages.limit(0)).count() == 0


def test_copies_of_an_article_are_no_boilerplate(spark):
    article = "<html><body><div class=x1><span>Welcome to our site</span></div><div class=body><h1>One article</h1><p>copied at many addresses</p></div></body></html>"
    page = lambda k: article.replace("One article", f"Title {k}").replace("copied at many addresses", f"own text {k} {k * 7}")
    rows = [(k, f"http://alone.example/a?utm={k}", article) for k in range(10)]
    rows += [(100 + k, f"http://beside.example/{k}", article) for k in range(80)] + [(200 + k, f"http://beside.example/u{k}", page(k)) for k in range(20)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(10)} == {"Welcome to our site\nOne article\ncopied at many addresses"}
    assert {got[100 + k] for k in range(80)} == {"One article\ncopied at many addresses"}
    assert all(got[200 + k] == f"Title {k}\nown text {k} {k * 7}" for k in range(20))


def test_url_filter(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{Path(data) / 'pages.parquet'}')")
    want = sorted(map(str, con.execute(ORACLES["op6_url_filter"]).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES["op6_url_filter"](spark, data).collect()) == want


def test_url_filter_odd(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net/de/", "http://net", "http://x.net/", "http://notexample.com/de/", "http://m.example.com/de/1?q", "x", "", None, "ftp://u.org/fr/#a", "http://a/b://c.net/", "http://net:80/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    rules = url_filter.rules_table(pages, [url_filter.Rule(*r) for r in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == got[12] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2] == ("net", "", None, "allow") and got[3][2:] == ("net/", "block") and got[4][2:] == (None, "allow") and got[5] == ("m.example.com", "/de/1", "example.com/de/", "block")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9] == ("u.org", "/fr/", "org/fr/", "allow") and got[10] == ("a", "/b://c.net/", None, "allow") and got[11][2] is None
    assert url_filter.judge(pages, rules.limit(0)).where("verdict != 'allow' or rule is not null").count() == 0
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_additive_search(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 16))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    x[100:300] = x[0]  # a hot vector
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(600)]
    rows += [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [1.0] * 15 + [float("nan")], 1), (1060, [1.0] * 15 + [None], 1), (1080, [1.0] * 3, 1), (None, [1.0] * 16, 1), rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    s = additive_search.Settings(codebooks=8, codewords=32, run=64, share=64, sample_rows=200)
    got = {}
    for q in additive_search.search(table, F.col("vec_id") % 20 == 0, settings=s).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(600), -scores)) if k != q][:20]
        hit += len({*order} & {k for k, _ in found})
        assert len(found) == 20 and all(abs(score - scores[k]) < 1e-12 for k, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit >= 0.9 * 20 * len(got)
    assert [k for k, _ in got[100][:3]] == [0, 101, 102]
    few = additive_search.search(table.where("vec_id in (0, 5, 7)"), F.col("vec_id") % 20 == 0, settings=s).collect()
    assert len(few) == 2
    assert additive_search.search(table.where("vec_id = 1000"), F.col("vec_id") % 20 == 0).count() == 0


def test_additive_search_takes_as_many_jobs_for_more_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    answers, jobs = [], []
    for group in (1, 7, 600):
        s = additive_search.Settings(codebooks=4, codewords=16, query_group=group, run=16, block_bytes=4000, share=64, sample_rows=200)
        spark.sparkContext.setJobGroup(f"groups-of-{group}", "")
        answers.append(additive_search.search(table, F.col("vec_id") % 2 == 0, 5, s).orderBy("query_id", "rank").collect())
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-of-{group}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 1500
    assert jobs[0] > 0 and max(jobs) - min(jobs) <= 2, jobs


def test_additive_search_among_near_copies(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(1500, 16))
    x[::3] = x[0] + 0.05 * r.normal(size=(500, 16))  # a third lie within the quantisation error of each other
    table = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(1500)], "vec_id long, embedding array<double>")
    s = additive_search.Settings(codebooks=4, codewords=16, query_group=20, run=64, share=64, sample_rows=200)
    got = {}
    for q in additive_search.search(table, F.col("vec_id") % 20 == 0, settings=s).orderBy("query_id", "rank").collect():
        got.setdefault(q.query_id, []).append(q.vec_id)
    for q in range(0, 1500, 20):
        scores = (x * x[q]).sum(axis=1)
        assert got[q] == [k for k in np.lexsort((np.arange(1500), -scores)) if k != q][:20]


@pytest.mark.parametrize("bits", [4])
def test_quantiser_gets_closer_with_more_codebooks(bits):
    x = np.random.default_rng(3).normal(size=(500, 8))
    errors = []
    for books in (2, 6):
        q = additive_search.fit(x, additive_search.Settings(codebooks=books, codewords=1 << bits))
        errors.append(((x - q.decode(q.encode(x))) ** 2).mean())
    assert errors[1] < errors[0] / 2
