"""Reading markup, scores, the main element, index and crawl."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import crawl, index, readability
from sluiceway.sources.html import Selector, hrefs, read_frames, tree

LONG = "This sentence is long enough, with commas, to be counted as the text of an article, and then some more words follow. "


def frames(html):
    return read_frames(html)[3]


def main(spark, html, url="https://h.test/p/"):
    df = spark.createDataFrame([(html, url)], "html string, url string")
    return readability.extract(df).first()


PAGES = {
    "by id": (f"<body><div id='sidebar'>{LONG * 2}</div><div id='main'>{LONG}</div></body>", "main"),
    "semantic tag": (f"<body><div>{LONG}x</div><article>{LONG}y</article></body>", "article"),
    "links lose": (f"<body><div><a href=1>{LONG * 3}</a></div><section><p>{LONG}</p></section></body>", "section"),
    "unlikely class": (f"<body><div class=share-box>{LONG * 9}</div><div>{LONG}z</div></body>", None),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_element(spark, name):
    html, _ = PAGES[name]
    row = main(spark, html)
    assert row["error"] is None and row["content"].startswith("This sentence")
    if name == "links lose":
        assert row["content"].count("This sentence") == 1


def test_errors_are_rows(spark):
    for html in ("", "<p>short</p>", None, "<<<>>>", "<ul><li>x</ul>"):
        row = main(spark, html)
        assert row["content"] is None and row["error"] == "no main content"
    assert main(spark, f"<p>{LONG}</p>", "not a url")["error"] == "url cannot be parsed"


def test_skipped_containers_and_titles(spark):
    html = f"<head><title> A &amp; B </title><style>p{{}}</style></head><body><script>var x='<p>';</script><main><p>{LONG}</p><form>{LONG}no</form><noscript>no</noscript></main><svg><title>C</title></svg></body>"
    row = main(spark, html)
    assert row["title"] == "A & B C" and "no" not in row["content"].split() and row["final_url"] == "https://h.test/p"


def test_canonical_last_non_empty_wins(spark):
    html = f"<link rel=canonical href='/a'><link rel=canonical href=''><link rel='canonical' href='/b/'><article>{LONG}</article>"
    assert main(spark, html)["final_url"] == "https://h.test/b"


def test_text_is_normalised_and_counted_in_bytes():
    title, canonical, chunks, fr = read_frames("<div>ä  b,<a>c, d</a>\n<b>e</b></div>")
    assert chunks == ["ä b,", "c, d", "e"] and canonical is None and title == ""
    tag, ident, cls, start, n, size, links, commas = fr[-1]
    assert (tag, start, n, size, links, commas) == ("div", 0, 3, 5 + 4 + 1, 4, 2)


def test_unclosed_elements_give_no_frame_and_ancestors_close_them():
    assert frames("<div><p>a") == []
    assert [f[0] for f in frames("<div><p>a<b>b</div>")] == ["b", "p", "div"]
    assert [f[0] for f in frames("<p>a</b></p>")] == ["p"]
    assert frames("<embed><div>x</div>")[0][0] == "div" and frames("<svg/><div>x</div>")[0][5] == 1


def test_leaf_text_goes_to_the_frame_around_it():
    assert read_frames("<div>a<button>b</button></div>")[2] == ["a", "b"]


def test_depth_limit():
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert len(frames(deep)) == 256 and frames(deep)[0][5] == 1


def test_slices_hold_the_text_below_an_element():
    rng = random.Random(2)
    for _ in range(30):
        html, open_ = "<div>", ["div"]
        for _ in range(40):
            x = rng.random()
            if x < 0.4:
                html += f" w{rng.randrange(9)} "
            elif x < 0.7:
                open_.append(rng.choice(["div", "p", "span"]))
                html += f"<{open_[-1]}>"
            elif len(open_) > 1:
                html += f"</{open_.pop()}>"
        html += "".join(f"</{t}>" for t in reversed(open_))
        _, _, chunks, fr = read_frames(html)
        root = fr[-1]
        assert " ".join(chunks[root[3] : root[3] + root[4]]) == " ".join(tree(html).text().split())
        assert all(sum(len(c) for c in chunks[f[3] : f[3] + f[4]]) == f[5] for f in fr)


def score(spark, base, n, links, commas):
    df = spark.createDataFrame([(base, n, links, commas)], "b float, n bigint, l bigint, c bigint")
    return df.select(readability.final_score(F.col("b"), F.col("n"), F.col("l"), F.col("c"))).first()[0]


def test_scores(spark):
    assert score(spark, 5.0, 100, 0, 3) == 18.0
    assert score(spark, 5.0, 100, 40, 3) == 18.0
    assert score(spark, 5.0, 100, 100, 3) == 0.0
    assert score(spark, 5.0, 0, 0, 0) == 5.0
    assert abs(score(spark, 5.0, 100, 80, 0) - 5.0) < 0.001
    df = spark.createDataFrame([("div", "main", None), ("ul", None, "nav"), ("h2", None, None), ("article", "x", "x"), ("b", "expand share", "post footer")], "t string, i string, c string")
    assert [r[0] for r in df.select(readability.base_score(F.col("t"), F.col("i"), F.col("c"))).collect()] == [30.0, -28.0, -5.0, 30.0, 25.0]
    df = spark.createDataFrame([("div", 99), ("div", 100), ("h1", 500), ("ul", 500), ("td", 100)], "t string, n bigint")
    assert [r[0] for r in df.select(readability.viable(F.col("t"), F.col("n"))).collect()] == [False, True, False, False, True]


def test_element_frames_table(spark):
    df = spark.createDataFrame([(1, "<div>a<a>b</a></div>"), (2, None)], "page_id bigint, html string")
    rows = readability.element_frames(df, "page_id").collect()
    assert [(r["page_id"], r["tag_type"], r["char_count"], r["link_char_count"], r["extracted_text"]) for r in rows] == [(1, "div", 2, 1, "a b")]


def test_selectors():
    root = tree("<div class='a b' data-t='w'><p id=x>1<br>2</p><span class=c>3</span></div><div class=a><li class='k RESULT-9'><a href=1>z</a></li></div>")
    found = lambda s: [n.text() for n in Selector(s).all(root)]
    assert found("div.a.b") == ["123"] and found("p#x") == ["12"] and found("div[data-t='w'] span.c") == ["3"] and found('li[class*="RESULT-"] a') == ["z"]
    assert found("div.a p") == ["12"] and found("ul a") == [] and found("*[href]") == ["z"] and found("div[data-t=w]") == ["123"]
    assert hrefs("<a href=1><a name=x><a href='2'>") == ["1", "2"] and hrefs(None) == []


# ---------------------------------------------------------------- index and crawl


def test_index_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.test/x", "The Running", "Cats run. A cat ran!"), ("https://b.test/", None, None)], "url string, title string, content string")
    index.write(pages, str(tmp_path / "ix"))
    docs, post = index.open_index(spark, str(tmp_path / "ix"))
    assert index.doc_count(docs) == 2
    got = {(r["field"], r["term"]): (r["tf"], list(r["positions"])) for r in post.collect() if r["field"] != "url"}
    assert got["body", "cat"] == (2, [0, 3]) and got["title", "running"] == (1, [1]) and ("body", "cats") not in got
    top = index.bm25(post, docs, ["cat"]).collect()
    assert [r["url"] for r in top] == ["https://a.test/x"]
    spark.range(1).write.parquet(str(tmp_path / "no" / "docs"))
    spark.range(1).write.parquet(str(tmp_path / "no" / "postings"))
    with pytest.raises(ValueError, match="lacks"):
        index.open_index(spark, str(tmp_path / "no"))


def test_upsert_keeps_one_row_a_url(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "url string, n int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "url string, n int")
    assert {tuple(r) for r in index.upsert(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    seq = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "url string, n int")
    assert {tuple(r) for r in index.latest_pages(seq, "n").collect()} == {("a", 3), ("b", 2)}


def brute_bfs(edges, start, exclude):
    home = "https://h.test/"
    seen, queue = {start}, [start]
    while queue:
        u = queue.pop(0)
        if u.startswith(home) and not any(u.startswith(p) for p in exclude):
            for s, t in edges:
                if s == u and t not in seen:
                    seen.add(t)
                    queue.append(t)
    return seen


def test_discovery_equals_breadth_first_search(spark):
    rng = random.Random(4)
    node = lambda n: f"https://{'h' if n % 4 else 'far'}.test/{n}"
    edges = [(node(rng.randrange(60)), node(rng.randrange(60))) for _ in range(120)]
    df = spark.createDataFrame(edges, "src_url string, dst_url string")
    visited, domains = crawl.discover(df, node(1), ["https://h.test/1"], cut_every=2)
    assert {r["url"] for r in visited.collect()} == brute_bfs(edges, node(1), ["https://h.test/1"]) == {node(1)}
    visited, domains = crawl.discover(df, node(2), ["https://h.test/1"], cut_every=2)
    want = brute_bfs(edges, node(2), ["https://h.test/1"])
    assert {r["url"] for r in visited.collect()} == want
    assert {r["domain"] for r in domains.collect()} == {u.split("/")[2] for u in want}


def test_links_and_outcomes(spark):
    df = spark.createDataFrame([("https://h.test/a/", "<a href='b#c'>x</a><a href='/d'>y</a><a>z</a>")], "url string, html string")
    assert sorted(r["dst_url"] for r in crawl.links(df).collect()) == ["https://h.test/a/b", "https://h.test/d"]
    df = spark.createDataFrame([("https://h.test/", f"<p>{LONG}</p>"), ("https://h.test/", "<p>x</p>"), ("https://h.test/", ""), ("https://h.test/", None)], "url string, html string")
    assert tuple(crawl.outcomes(readability.extract(df)).first()) == (1, 1, 2)


def test_live_source_reads_data_urls(spark):
    spark.dataSource.register(crawl.PoliteSource)
    rows = spark.read.format("polite_pages").option("urls", "data:text/html,<p>hi</p> https://nowhere.invalid/x https://skip.test/").option("exclude", "https://skip").option("timeout", "1").load().collect()
    by = {r["url"][:10]: r["html"] for r in rows}
    assert by["data:text/"] == "<p>hi</p>" and by["https://no"] == "" and len(rows) == 2


def test_json_shape_of_structs():
    assert json.loads(json.dumps({"k": 1})) == {"k": 1}
