"""Url and text functions against cases written out by hand and against plain Python."""

import random
import string
import unicodedata
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.functions import text, urls
from sluiceway.functions.stemmer import stem


def column(spark, values, expr, name="x", kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    return [r[0] for r in df.select("i", expr(F.col(name)).alias("y")).orderBy("i").select("y").collect()]


def plain_host(url):
    s = url.split("://", 1)[1] if "://" in url else url
    s = s.split("/")[0].split("?")[0]
    head, sep, tail = s.rpartition(":")
    if sep and all(c in string.digits for c in tail):
        s = head
    return s.removeprefix("www.").lower()


URLS = [
    "https://www.Example.test/a", "http://example.test:8080/x?y", "example.test", "https://user:pw@host.test/p", "https://host.test:/", "https://host.test#frag", "WWW.host.test/x", "https://WWW.host.test/",
    "ftp://a.b://c", "", "https://", "//x.test/y", "https://host.test?u=http://other.test/", "https://[::1]:80/x",
]


def test_url_host_follows_the_rules(spark):
    assert column(spark, URLS, urls.url_host) == [plain_host(u) for u in URLS]
    assert column(spark, [None], urls.url_host) == [None]


def test_dedup_key(spark):
    cases = {
        "https://www.A.test/B/": "a.test/b", "http://a.test": "a.test", "https://old.reddit.com/r/x/": "reddit.com/r/x", "https://a.test///": "a.test", "ftp://a.test/": "ftp://a.test", "https://https://a.test": "https://a.test", "/": "",
    }
    assert column(spark, list(cases), urls.dedup_key) == list(cases.values())
    keys = column(spark, list(cases), lambda c: urls.dedup_key(urls.dedup_key(c)))
    assert keys[:3] == list(cases.values())[:3]


def test_hosts_by_pattern_field_and_location(spark):
    u = ["https://A.test:1/x?y", "http://a.test?q", "a.test/x", "mailto:x"]
    assert column(spark, u, urls.pattern_host) == ["A.test:1", "a.test", "", ""]
    assert column(spark, u, lambda c: urls.pattern_host(c, False)) == ["A.test:1", "a.test?q", "", ""]
    assert column(spark, [*u, "http:", "https://"], urls.field_host) == ["A.test:1", "a.test?q", "a.test", "mailto:x", "", ""]
    assert column(spark, ["https://me@A.test:1/x", "x.test/y", "ftp://h/"], urls.netloc) == ["me@A.test:1", "", "h"]
    assert column(spark, ["https://api.smallweb.cc/db/visit/x.test/feed", "https://x.test"], urls.visit_host) == ["x.test", ""]
    assert column(spark, ["see https://a.test/x (http://b.test) end"], urls.text_urls) == [["https://a.test", "http://b.test"]]


def test_suffixes_and_prefixes(spark):
    assert column(spark, ["a.b.c", "c", ""], urls.suffixes) == [["a.b.c", "b.c", "c"], ["c"], [""]]
    assert column(spark, ["https://x/a", "https://y"], lambda c: urls.excluded(c, ["https://x/"])) == [True, False]
    assert column(spark, ["https://x/a"], lambda c: urls.excluded(c, [])) == [False]


def test_encoding_equals_the_standard_library(spark):
    values = ["a b", "ä*~+/?", "x&y=z", "", "100%", "日本"]
    assert column(spark, values, urls.encode_query) == [quote(v, safe="") for v in values]
    assert column(spark, ["a b"], lambda c: urls.request_url(F.lit("brave"), c)) == ["https://search.brave.com/search?q=a%20b"]
    assert column(spark, ["a b"], lambda c: urls.request_url(F.lit("nobody"), c)) == [None]


def test_seed_urls(spark):
    assert column(spark, [" a.test ", "", "   ", "a b", "münchen.test", "x.test/p"], urls.seed_url) == ["https://a.test", None, None, None, "https://münchen.test", "https://x.test/p"]


RESOLVE = [
    ("https://Host.TEST:443/a/../b/", None, "https://host.test/b"), ("https://h.test", None, "https://h.test/"), ("https://h.test/", None, "https://h.test/"), ("https://h.test/a/", None, "https://h.test/a"),
    ("https://h.test/a?q=/", None, "https://h.test/a?q="), ("https://h.test/a", "/c/", "https://h.test/c"), ("https://h.test/a/b", "c", "https://h.test/a/c"), ("https://h.test/a", "https://o.test/X/", "https://o.test/X"),
    ("no url", None, None), ("https://h.test/a//", None, "https://h.test/a/"), (None, None, None), ("https://bücher.test/", None, "https://xn--bcher-kva.test/"),
]


def test_resolved_urls(spark):
    df = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(RESOLVE)], "i int, b string, c string")
    got = [r[0] for r in df.select("i", urls.resolve_url(F.col("b"), F.col("c")).alias("y")).orderBy("i").select("y").collect()]
    assert got == [w for _, _, w in RESOLVE]


def test_join_link_equals_urljoin_on_either_path(spark):
    hrefs = ["/a", "b", "../c#x", "https://o.test/p#q", "//n.test/x", "?z=1", "#top", "", "/x/../y", "https://o.test/a/./b", "mailto:x@y", "/a.b/c"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = [r[0] for r in df.select("i", urls.join_link(F.lit("https://s.test/d/e"), F.col("h")).alias("y")).orderBy("i").select("y").collect()]
    assert got == [urls._join("https://s.test/d/e", h) for h in hrefs]


def test_white_space_and_tokens(spark):
    s = ["  a\u00a0 b\n\tc ", "", "\u2003x\u3000"]
    assert column(spark, s, text.squeeze) == ["a b c", "", "x"]
    assert column(spark, ["Das Haus-Boot, 2x!", "", "..."], text.tokens) == [["das", "haus", "boot", "2x"], [], []]
    assert column(spark, ["  Foo  BAR foo", " "], text.query_words) == [["foo", "bar", "foo"], []]
    assert column(spark, ["a" * 39 + " " + "b" * 40 + " ü" + "c" * 38], text.index_tokens) == [["a" * 39]]


def test_markup_text(spark):
    assert column(spark, ['a & b < c > "d" \'e\''], text.html_escape) == ["a &amp; b &lt; c &gt; &quot;d&quot; 'e'"]
    assert column(spark, ["a &amp; b&nbsp;c", "plain", None], text.unescape) == ["a & b\u00a0c", "plain", None]
    assert column(spark, ["<p>a<b>b</b>\n c</p><script>x<y</script>d &lt; e"], text.strip_html) == ["ab cd < e"]
    assert column(spark, ["ﬁne ①"], text.nfkc) == ["fine 1"]


def test_small_fields(spark):
    assert column(spark, ["1700000000999", "x", None, "-5", ""], text.seconds) == [1700000000, 0, 0, 0, 0]
    assert column(spark, ["http://x", "data:x", None], text.http_only) == ["http://x", None, None]
    assert column(spark, ["brave news"], text.source_class) == ["brave-news"]
    assert column(spark, ["q"], lambda c: text.fill("<{{A}}|{{B}}>", A=c, B=F.lit("z"))) == ["<q|z>"]


STEMS = "consigned:consign consistency:consist knightly:knight running:run happily:happili generously:generous relational:relat hopping:hop hoping:hope ties:tie cries:cri national:nation sensibility:sensibl adjustment:adjust electricity:electr skies:sky agreed:agre falling:fall adoption:adopt kiss:kiss gas:gas gaps:gap by:by say:say dying:die news:news proceed:proceed"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split(":")
    assert stem(word) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'’éY", max_size=20))
def test_stems_never_fail_or_grow_much(word):
    assert len(stem(word)) <= len(word) + 1


def test_stems_of_arrays(spark):
    df = spark.createDataFrame([(["running", "cats"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(text.stems("w")).collect()] == [["run", "cat"], None, []]


def test_squeeze_agrees_with_python_on_random_text(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice(" \t\n\u00a0\u2009abc") for _ in range(20)) for _ in range(50)]
    assert column(spark, values, text.squeeze) == [" ".join(v.split()) for v in values]
    assert unicodedata.normalize("NFKC", "x") == "x"
