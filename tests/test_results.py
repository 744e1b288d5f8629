"""Result lists, source answers, lists of domains, streams and the entry points."""

import importlib
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from sluiceway.operators import lists, search
from sluiceway.sources import harvest, parsers
from sluiceway.streaming import pipelines

ROOT = Path(__file__).resolve().parent.parent


def test_relevance(spark):
    df = spark.createDataFrame([("old bridge", "The BRIDGE", None, "u"), ("x", "a", "b", "http://x.test"), ("q", "a", "b", "c"), ("  ", "a", None, None)], "q string, t string, d string, u string")
    assert [r[0] for r in df.select(search.relevant(F.col("q"), F.col("t"), F.col("d"), F.col("u"))).collect()] == [True, True, False, True]


def test_interleaving_is_a_permutation_with_the_first_four_up_front(spark):
    rng = random.Random(6)
    rows = [(q, s, r) for q in (1, 2) for s in "abc" for r in range(1, rng.randint(2, 9))]
    df = spark.createDataFrame(rows, "query_id int, source string, rank int")
    out = search.interleave(df, "query_id", "source", ["rank"]).collect()
    assert sorted((r["query_id"], r["source"], r["rank"]) for r in out) == sorted(rows)
    for q in (1, 2):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["position"])
        want = sorted((x for x in rows if x[0] == q), key=lambda x: (x[2] > 4, x[1], x[2]))
        assert [(r["source"], r["rank"]) for r in mine] == [x[1:] for x in want]
        assert [r["side"] for r in mine] == ["left" if i % 2 == 0 else "right" for i in range(len(mine))]


def test_fusion(spark):
    rows = [(1, 0, "a", 1, "https://www.x.test/"), (1, 0, "a", 2, "http://y.test"), (1, 1, "b", 3, "http://x.test"), (1, 1, "b", 4, "http://X.test/"), (1, 1, "b", 5, None)]
    df = spark.createDataFrame(rows, "q int, source_idx int, source string, rank int, url string").withColumns({"title": F.lit("t"), "description": F.lit("d")})
    out = {r["dedup_key"]: (r["mean_rank"], r["n_ranks"], r["url"], r["sources"]) for r in search.fuse(df, ["q"]).collect()}
    assert out == {"x.test": ((1 + 3 + 4) / 3, 3, "https://www.x.test/", ["a", "b"]), "y.test": (2.0, 1, "http://y.test", ["a"])}
    seen = spark.createDataFrame([("x.test",)], "dedup_key string")
    assert [r["dedup_key"] for r in search.fuse(df, ["q"], seen, lambda r: r * 2).collect()] == ["y.test"]


def test_feed_search_and_zip(spark):
    df = spark.createDataFrame([("Big cat", "a cat."), ("dog", None), (None, None)], "title string, summary string")
    assert [r["score"] for r in search.feed_search(df, F.lit("cat CAT big?")).collect()] == [2]
    assert search.feed_search(df, F.lit("  ")).count() == 0
    df = spark.createDataFrame([([1, 2, 3], [4, 5], [6, 7, 8]), ([], [1], [2])], "a array<int>, b array<int>, c array<int>")
    got = [[tuple(z) for z in r[0]] for r in df.select(search.zip_shortest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [[(1, 4, 6), (2, 5, 7)], []]


def test_rendering(spark):
    df = spark.createDataFrame([("<t>", "u?a&b", 'd"', ["brave", "x y"], "http://i", "")], "t string, u string, d string, s array<string>, i string, e string")
    card = df.select(search.render(*[F.col(c) for c in "tudsie"])).first()[0]
    assert card.startswith('<div class="result"><img class="result-img result-img-square" src="http://i"') and "&lt;t&gt;" in card and 'class="source-x-y">x y<' in card and "u?a&amp;b" in card
    head, tail = search.page_parts("[{{QUERY}}|{{STATUS}}|{{RESULTS}}]", F.lit("a<b"))
    assert tuple(spark.range(1).select(head, tail).first()) == ('[a&lt;b|<a href="https://search.brave.com/images?q=a%3Cb">images</a>|', "]")
    assert search.empty_page("{{QUERY}}x{{RESULTS}}") == "x"


# ---------------------------------------------------------------- lists


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n Bad.TEST \n\nworse.test")
    lines = lists.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "missing.txt")])
    block = lists.blocklist(lines)
    assert {r[0] for r in block.collect()} == {"bad.test", "worse.test"}
    assert lists.read_lines(spark, [str(tmp_path / "missing.txt")]).count() == 0
    df = spark.createDataFrame([(1, "http://bad.test/x"), (2, "https://sub.bad.test"), (3, "https://notbad.test"), (4, None), (5, "https://www.worse.test:80"), (5, "https://www.worse.test:80")], "id int, url string")
    assert sorted(r["id"] for r in lists.without_blocked(df, "url", block).collect()) == [3, 4]
    assert sorted(r["id"] for r in lists.blocked(df, "url", block).collect()) == [1, 2, 5, 5]
    assert {r[0] for r in lists.allowed(spark.createDataFrame([("x.bad.test",), ("ok.test",)], "d string"), block).collect()} == {"ok.test"}
    both = lists.union_domains(block, spark.createDataFrame([("a.test",), ("bad.test",), ("",)], "d string"))
    assert [r[0] for r in both.collect()] == ["a.test", "bad.test", "worse.test"]
    lists.write_domains(block, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ["bad.test", "worse.test"]


def test_large_block_lists_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lists, "BROADCAST_ROWS", 1)
    block = spark.createDataFrame([("a.test",), ("b.test",)], "domain string")
    df = spark.createDataFrame([("http://x.a.test",), ("http://c.test",)], "url string")
    assert [r[0] for r in lists.without_blocked(df, "url", block).collect()] == ["http://c.test"]


# ---------------------------------------------------------------- source answers


def answers(spark, *bodies, status=200, at="2024-01-10 00:00:00"):
    return spark.createDataFrame([("s", "q", status, b) for b in bodies], "source string, query string, status int, body string").withColumn("fetched_at", F.to_timestamp(F.lit(at)))


def test_json_sources(spark):
    a = answers(spark, '[{"Title":"t","URL":"u"},{"Title":"t"},{"URL":"u","Title":"w","Snippet":"s"}]', "no json", "[]")
    assert [(r["rank"], r["title"], r["description"]) for r in parsers.wiby(a).collect()] == [(1, "t", ""), (2, "w", "s")]
    b = answers(spark, '{"results":[{"url":"u","title":"t"}]}', '{"results":[{"url":"u","title":"t"},{"url":"v"}]}', "{}", "x")
    assert [r["url"] for r in parsers.marginalia(b).collect()] == ["u"]
    c = answers(spark, '{"data":{"children":[{"data":{"title":"t","permalink":"/r","thumbnail":"http://i?a&amp;b"}},{"data":{"title":"w","permalink":"/s","thumbnail":"self"}}]}}', '{"data":{"children":[{"data":{"title":"t"}}]}}')
    assert [(r["url"], r["image"]) for r in parsers.reddit(c).collect()] == [("https://old.reddit.com/r", "http://i?a&b"), ("https://old.reddit.com/s", None)]
    assert parsers.ok_body(answers(spark, "x", status=500)).count() == 0


def test_headless_body_is_the_fallback(spark):
    df = answers(spark, "plain", None, "").withColumn("headless_body", F.lit("headless"))
    assert [r["body"] for r in parsers.ok_body(df).collect()] == ["plain", "headless", "headless"]


def test_markup_sources(spark):
    web = "<div class='snippet' data-type='web'><a class=l1 href='u'><div class=title> T </div></a></div><div class=snippet data-type=news><a class=l1 href=n><div class=title>N</div></a></div><div class=snippet data-type=web><a class=l1><div class=title>no</div></a></div>"
    assert [r["url"] for r in parsers.brave(answers(spark, web)).collect()] == ["u"]
    assert [r["title"] for r in parsers.brave_news(answers(spark, web)).collect()] == ["N"]
    m = "<input name=url value=1><input name=url><input name=url value=2><input name=title value=a><input name=extract value=x><input name=extract value=y>"
    assert [(r["url"], r["title"], r["description"]) for r in parsers.mwmbl(answers(spark, m)).collect()] == [("1", "a", "x")]
    s = "<div class=search-result><a class=result-title href=u>Link</a><p id=result-hightlight>a\n b</p></div><div class=search-result><a class=result-title>x</a></div>"
    assert [(r["title"], r["description"]) for r in parsers.searchmysite(answers(spark, s)).collect()] == [("Link", "a b")]
    k = "<li class='RESULT-1'><a href='/t'>T</a><div>d</div></li><li class=other><a href=x>y</a></li>"
    assert [r["url"] for r in parsers.britannica(answers(spark, k)).collect()] == ["https://www.britannica.com/t"]
    ms = int(datetime(2024, 1, 5).timestamp() * 1000)
    p = "".join(f"<div class=PagePromo data-posted-date-timestamp='{t}'><div class=PagePromo-title><a class=Link href='{i}'></a></div></div>" for i, t in enumerate((ms, ms - 9 * 86_400_000, "x")))
    assert [(r["url"], r["rank"]) for r in parsers.apnews(answers(spark, p)).collect()] == [("0", 1)]


def test_feeds(spark):
    x = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title> T </title><link href='u'/><content>&lt;p&gt;a  b&lt;/p&gt;</content><summary>s</summary></entry><entry><title>no link</title></entry></feed>"
    got = parsers.feed_entries(answers(spark, x, "<broken", None)).collect()
    assert [(r["title"], r["url"], r["summary"]) for r in got] == [("T", "u", "a b")]


def test_all_sources_by_name(spark):
    raw = answers(spark, '[{"Title":"t","URL":"u"}]').withColumn("source", F.lit("wiby"))
    assert [(r["source"], r["sources"]) for r in parsers.parse_all(raw).collect()] == [("wiby", ["wiby"])]


# ---------------------------------------------------------------- streams


def test_index_stream(spark, tmp_path):
    body = "This sentence is long enough, with commas, to be counted as the text of an article, and then some more words follow."
    src = tmp_path / "in"
    spark.createDataFrame([("https://a.test/x", f"<article>{body}</article>"), ("https://b.test/", "<p>x</p>"), ("https://c.test/", "")], "url string, html string").write.parquet(str(src))
    seen = []
    stream = spark.readStream.schema("url string, html string").parquet(str(src))
    q = pipelines.index_stream(stream, str(tmp_path / "ix"), str(tmp_path / "cp"), every=None, on_batch=lambda *a: seen.append(a))
    q.awaitTermination(60)
    docs = spark.read.parquet(str(tmp_path / "ix" / "batch=*" / "docs")).withColumn("batch", F.lit(0))
    assert seen == [(0, 1, 1)] and [r["url"] for r in pipelines.newest_documents(docs).collect()] == ["https://a.test/x"]


def test_snapshot(spark):
    t0 = datetime(2024, 1, 1, 12)
    rows = [("a", t0, True), ("a", t0 + timedelta(minutes=30), False), ("b", t0 - timedelta(hours=2), True), ("c", t0, False), ("d", t0 + timedelta(hours=2), True)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, ok boolean")
    got = {r["k"]: r["state"] for r in pipelines.snapshot(df, "k", "ts", F.col("ok"), F.lit(t0 + timedelta(minutes=45))).collect()}
    assert got == {"a": "fresh", "b": "stale", "c": "missing"}


def test_windowed_counts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "x") for m in (1, 2, 11)], "ts timestamp, kind string")
    assert sorted(r["n"] for r in pipelines.windowed_counts(df, "ts", "kind").collect()) == [1, 2]


# ---------------------------------------------------------------- entry points


def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_imports_without_the_llm_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('sluiceway.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not any(n.startswith('p') for n in q) and set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for f in (ROOT / "sluiceway").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm import" not in f.read_text() and "import llm" not in f.read_text(), f


# ---------------------------------------------------------------- harvesting


def test_harvesting(spark):
    pages = spark.createDataFrame([("<a href='https://A.test:1/x?y'>1</a><a href=/rel>2</a><a href='https://api.smallweb.cc/db/visit/b.test/f'>3</a><a class='title outbound' href='http://c.test/z'>4</a>",), (None,), ("",)], "html string")
    one = lambda df: [r[0] for r in df.collect()]
    assert one(harvest.anchor_hosts(pages)) == ["A.test:1", "api.smallweb.cc", "c.test"]
    assert one(harvest.visit_hosts(pages)) == ["b.test"] and one(harvest.listing_hosts(pages)) == ["c.test"]
    text = harvest.literal(["see [x](https://d.test/p) or http://e.test", "nothing"], spark)
    assert one(harvest.text_hosts(text)) == ["d.test", "e.test"]
    js = harvest.literal(['{"a":{"b":["https://f.test/x","g.test/y"]}}', '{"a":{"b":"h.test"}}', "no json", "{}"], spark)
    assert one(harvest.json_hosts(js, "$.a.b")) == ["f.test", "g.test", "h.test"]
    assert one(harvest.loose_hosts(harvest.literal(["x.test/1", "https://x.test/2"], spark))) == ["x.test", "x.test"]
    assert [tuple(r) for r in harvest.numbered(spark, "https://n.test/?p={}&x", 2, 3).collect()] == [(2, "https://n.test/?p=2&x"), (3, "https://n.test/?p=3&x")]
    assert one(harvest.harvest(harvest.visit_hosts(pages), harvest.text_hosts(text), harvest.visit_hosts(pages))) == ["b.test", "d.test", "e.test"]


def test_following_next_links(spark):
    site = {f"http://l.test/{i}": f"<a class='title outbound' href='http://o{i}.test'></a>" + (f"<span class=next-button><a href='/{i + 1}'></a></span>" if i < 5 else "") for i in range(6)}
    assert [u for u, _ in harvest.follow("http://l.test/0", 99, site.get)] == list(site)
    assert len(list(harvest.follow("http://l.test/0", 2, site.get))) == 2 and list(harvest.follow("http://none.test", 9, site.get)) == []
    loop = {"http://l.test/": "<span class=next-button><a href='/'></a></span>"}
    assert len(list(harvest.follow("http://l.test/", 9, loop.get))) == 1
    spark.dataSource.register(harvest.CursorSource)
    rows = spark.read.format("cursor_pages").option("urls", "data:text/html,<p>one</p>").option("delay", "0").load().collect()
    assert [r["html"] for r in rows] == ["<p>one</p>"]


def test_a_page_in_pieces(spark):
    df = spark.createDataFrame([(0, 2, "[b]"), (0, 1, "[a]"), (1, 1, "[c]")], "column_no int, position int, card string")
    page = "".join(search.stream_page(df, "<{{QUERY}}{{STATUS}}|{{RESULTS}}>", "q"))
    assert page.index("[a]") < page.index("[b]") < page.index("Discovery") < page.index("[c]") and page.endswith(">") and page.count("<div") == page.count("</div>")
    assert "Discovery" in "".join(search.stream_page(df.limit(0), "{{RESULTS}}", "q"))
