"""Operators on pages, and the pipeline as a whole."""

import os
import random
import re

import pytest
from conftest import lower_ascii

from riskpanel.llm import langid, queries, urlfilter

URLS = ["https://www.example.com/en/1", "http://example.com/en/", "http://EXAMPLE.com/EN/", "http://a.b.example.com/en/x?y#z", "http://x.net/es/1",
        "http://x.net/fr", "http://net/fr/", "http://notexample.com/en/a", "http://a.com", "http://a.com?/en/", "http://com/", "ftp://com./",
        "mailto:x@a.com", None, "", "://", "://a.com/", "http:///en/", "http://x.org/en/", "a#b://x.com/p", "http://É.com/en/\n", "x\ny://a.net/es/?q://b.com/",
        "http://www.example.com/en/1", "http://.com/", "http://..net/es/"]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host, path = lower_ascii(m[1]), m[2]
    fit = [(len(h + p), h + p, a) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r"), (None, URLS[1], None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string").repartition(2)
    rules = spark.createDataFrame(queries.URL_RULES + [("block", None, "/"), (None, "a.com", "/"), ("block", "com", "/")], "action string, host string, path string")
    got = sorted([tuple(r) for r in urlfilter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()], key=repr)
    assert got == sorted([(r[0], *brute(r[1], queries.URL_RULES)) for r in rows], key=repr)
    assert urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    none = urlfilter.filter_urls(pages, rules.limit(0), default="block").collect()
    assert len(none) == len(rows) and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_url_filter_long_hosts(spark):
    """A megabyte of labels, or of path, is one row like any other."""
    import time
    urls = ["http://" + "a." * 500_000 + "net/es/x", "http://" + "b" * 1_000_000 + ".com/", "http://x.net/es/" + "p/" * 500_000, "x" * 1_000_000 + "://" * 3]
    rows = list(enumerate(urls))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    began = time.time()
    got = sorted([tuple(r) for r in urlfilter.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()])
    assert got == [(i, *brute(u, queries.URL_RULES)) for i, u in rows] and time.time() - began < 20


def test_visible_is_one_scan():
    import time
    cases = {b'a<b lang="x">c</b>d<html data-lang="no" class=q lang=EN-us>e': (b"a c d e", "en"),
             b"<!-- <html lang=de> --><HTML xml:lang='Fr'>x<script>if (a<b) lang</script >y<STYLE>p</style>z": (b"  x y z", "fr"),
             b"a<!--b>c<!--d": (b"a c<!--d", None), b"<script>a<b>c": (b" a c", None), b"1 < 2": (b"1 < 2", None),
             b"<html><html lang=es>": (b"  ", "es"), b"": (b"", None), b"<scripty>t</scripty>": (b" t ", None), b"<html lang=": (b"<html lang=", None)}
    for page, exp in cases.items():
        assert langid.visible(page) == exp, page
    for part in (b"<script ", b"<!--", b"<html ", b"<style>", b"<html lang", b"</script", b"<", b"<html lang>"):
        began = time.time()
        langid.visible(part * (1_000_000 // len(part)))
        assert time.time() - began < 10, part


def test_language_id_posterior(spark):
    """The posterior of every page against a plain computation from the same text scores."""
    import math
    from collections import Counter
    texts = {"aa": "the rain and the sun over the hills ", "bb": "der regen und die sonne zwischen ", "cc": "la lluvia y el sol sobre "}
    docs = spark.createDataFrame([(i, texts[k], k) for i, k in enumerate("aa bb cc".split())], "doc_id bigint, text string, lang string")
    r = random.Random(3)
    rows = []
    for i in range(60):
        k = r.choice(list(texts))
        body = " ".join(r.choice(texts[k].split()) for _ in range(r.choice([0, 1, 3, 9])))
        rows.append((i, r.choice([f"http://h{r.randint(0, 2)}.x.{k}/", f"http://y.{k}/", None]), f"<html lang={r.choice(['aa', 'bb', 'zz'])}>{body}"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    langs, logp = langid.train(docs)
    scored = {x.page_id: x for x in langid.text_scores(pages, langs, logp).select("page_id", "url", "declared", "__text", "__grams").collect()}
    host = {i: brute(x.url, [])[0] for i, x in scored.items()}
    best = {i: x["__text"].index(max(x["__text"])) for i, x in scored.items() if x["__grams"] > 0}
    said = {i: langs.index(x.declared) + 1 if x.declared in langs else 0 for i, x in scored.items()}
    total = Counter(best.values())
    world = [(total[c] + 1) / (len(best) + 3) for c in range(3)]
    table = [[1 + sum(1 for i, c in best.items() if c == b and said[i] == a) for b in range(3)] for a in range(4)]
    table = [[table[a][b] / sum(table[x][b] for x in range(4)) for b in range(3)] for a in range(4)]

    def smooth(key, of, i, above):
        own = [sum(1 for j, c in best.items() if c == b and of(j) == key and j != i) for b in range(3)]
        return [(own[b] + langid.STRENGTH * above[b]) / (sum(own) + langid.STRENGTH) for b in range(3)]

    got = {x.page_id: x for x in langid.identify(pages, docs).collect()}
    for i, x in scored.items():
        domain = smooth(".".join(host[i].split(".")[-2:]), lambda j: ".".join(host[j].split(".")[-2:]), i, world)
        prior = smooth(host[i], lambda j: host[j], i, domain)
        suffix = smooth(host[i].split(".")[-1], lambda j: host[j].split(".")[-1], i, world)
        post = [x["__text"][b] + math.log(table[said[i]][b]) + math.log(prior[b]) + math.log(suffix[b] / world[b]) for b in range(3)]
        top = max(post)
        share = 1 / sum(math.exp(p - top) for p in post)
        assert got[i].lang == langs[post.index(top)] and abs(got[i].confidence - share) < 1e-6


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    plan = urlfilter.filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan and "NestedLoop" not in plan


def test_language_id(spark):
    texts = {"aa": "the rain and the sun over the hills of the land ", "bb": "der regen und die sonne zwischen den feldern ist "}
    docs = spark.createDataFrame([(i, texts[k] * 3, k) for i, k in enumerate(["aa", "bb"] * 20)] + [(99, None, "aa"), (98, "x", None), (None, "y", "bb")],
                                 "doc_id bigint, text string, lang string")
    page = '<html lang="%s"><head><script>the the the</script></head><body><!-- sonne --><p>%s</p></body></html>'
    rows = [(i, f"http://h{i % 3}.x.com/{i}", page % (k, texts[k])) for i, k in enumerate(["aa", "bb"] * 12)]
    # no text: the host and the declared language decide
    rows += [(100, "http://only.bb.net/1", page % ("bb", texts["bb"])) for _ in range(6)]
    rows += [(200, "http://only.bb.net/2", "<html><p></p></html>"), (201, "http://h0.x.com/z", '<html lang="BB">'), (202, None, None), (None, "", ""),
             (203, "http://h1.x.com/q", page % ("zz", texts["aa"]))]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, html string, lang string")
    got = {}
    for r in langid.identify(pages, docs).collect():
        got.setdefault(r.page_id, r)
        assert 0 < r.confidence <= 1 + 1e-9
    assert all(got[i].lang == k for i, k in enumerate(["aa", "bb"] * 12))
    assert got[200].lang == "bb" and got[200].text_lang is None and got[200].declared is None
    assert got[201].lang == "bb" and got[201].declared == "bb" and got[203].lang == "aa" and got[203].declared == "zz"
    assert got[202].host == "" and got[None].host == ""
    assert langid.identify(pages.limit(0), docs).count() == 0
    none = langid.identify(pages, docs.limit(0))
    assert none.count() == len(rows) and none.where("lang is not null").count() == 0


def test_language_id_declared_late(spark):
    """The declaration counts wherever it stands in the page."""
    docs = spark.createDataFrame([(1, "the rain and the sun", "aa"), (2, "der regen und die sonne", "bb")], "doc_id bigint, text string, lang string")
    page = "<!-- " + "licence " * 2000 + "-->" + "\n" * 5000 + '<html lang="BB"><p></p></html>'
    pages = spark.createDataFrame([(1, "http://a.org/", page)], "page_id bigint, url string, html string")
    assert langid.identify(pages, docs).first().declared == "bb"
    assert langid.identify(pages, docs.limit(0)).first().declared == "bb"


def test_language_id_many_languages(spark):
    """More than 64 languages, one of them with a single document."""
    names = ["l" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    word = {k: " ".join("".join(random.Random(100 * i + j).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(12)) for i, k in enumerate(names)}
    docs = spark.createDataFrame([(i, word[k], k) for i, k in enumerate(names)] + [(1000 + i, word[k], k) for i, k in enumerate(names[:69])],
                                 "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", f'<html lang="{k}"><p>{word[k]}</p></html>') for i, k in enumerate(names)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert langid.train(docs)[0] == sorted(names)
    assert [got[i].lang for i in range(70)] == names


def test_pipeline_stages(spark, docs, empty, labels, tmp_path):
    """Each stage keeps the columns of documents, and an empty table passes through all of them."""
    import corpus_pipeline
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage in any of these documents at all")], "item_id bigint, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, empty):
        cur = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, cur, str(tmp_path))
            path = str(tmp_path / f"{start.count()}-{k}")
            out.write.parquet(path)
            cur = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert cur.columns == docs.columns, name
        assert set(docs.columns) <= set(cur.columns)
    assert len(corpus_pipeline.STAGES) == 5


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, res.fetchall()))
