"""Queries over markup, the index, discovery and source answers, with their SQL.

The data has no markup, so pages are rendered from page_data, and source answers from search_result,
by column expressions; reading them back must give what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import crawl, index, readability
from ..session import table
from ..sources import harvest, parsers
from ..streaming import pipelines

AS_OF = "2024-01-05 00:00:00"
ATTRIBUTES = [
    "article", "main-content", "sidebar", "share", "share-column", "expand", "nav", "post nav", "com-box", "footer", "Header", "SPONSOR", "popup", "popup shadow", "widget", "tags", "x", "", "contentSub", "toc", "story", "ad-break",
    "adbreak", "blog-roll", "remark-able", "community", "community and more", "hidden", "skyscraper", "hentry", "pagination", "jump-to", "siteSub", "text", "extra", "outbrain", "related", "masthead", "disqus_thread", "rss",
]
TAGS = "div p h1 h3 h6 ul ol dl li article main section span table head script form br img title button a nav svg embed input option".split()


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, url, title, content, html``: every distinct page as markup, with a menu, a headline and a footer."""
    e = text.html_escape
    title = text.or_empty(F.col("title"))
    lines = F.filter(F.split(text.or_empty(F.col("content")), "\n"), lambda x: text.squeeze(x) != "")
    paragraphs = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), e(x), F.lit("</p>"))), "\n")
    canonical = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<link rel="canonical" href="/c/'), F.col("page_id").cast("string"), F.lit('/">'))).otherwise("")
    html = F.concat(
        F.lit("<!doctype html><html><head><title>"), e(title), F.lit("</title>"), canonical, F.lit('<script>var a = "<p>no</p>";</script></head><body><nav class="menu"><a href="/about">About</a> <a href="next#top">Next</a></nav><article class="post"><h1>'),
        e(title), F.lit("</h1>\n"), paragraphs, F.lit('</article><form><p>Search</p></form><footer class="footer">End</footer></body></html>'),
    )
    return table(spark, d, "page_data").select("page_id", "url", "title", "content").distinct().withColumn("html", html)


def best_elements(spark: SparkSession, d: str) -> DataFrame:
    """The main element of every page by its kind, counts and score."""
    scored = html_pages(spark, d).select("page_id", readability.scored(readability.frames_of(F.col("html"))["frames"]).alias("frames"))
    good = F.filter("frames", lambda f: f["viable"] & (f["score"] > 0))
    best = F.array_max(F.transform(good, lambda f: F.struct(f["score"].alias("score"), (-f["seq"]).alias("o"), f["tag"].alias("tag"), f["bytes"].alias("bytes"), f["link_bytes"].alias("link_bytes"), f["commas"].alias("commas"))))
    out = scored.select("page_id", best.alias("b")).filter("b IS NOT NULL")
    return out.select("page_id", "b.tag", "b.bytes", "b.link_bytes", "b.commas", F.round(F.col("b.score").cast("double"), 2).alias("score"))


def element_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Closed elements of all pages by kind, with their text's bytes."""
    frames = readability.element_frames(html_pages(spark, d), "page_id")
    return frames.groupBy("tag_type").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("bytes"), F.sum("link_char_count").alias("link_bytes"), F.sum("comma_count").alias("commas"))


def main_content(spark: SparkSession, d: str) -> DataFrame:
    """Main text, title and url of every page."""
    return readability.extract(html_pages(spark, d).drop("title", "content")).select("page_id", "title", "final_url", "content", "error")


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles as read from the markup, white space inside kept."""
    return html_pages(spark, d).select("page_id", readability.frames_of(F.col("html"))["title"].alias("title"))


def page_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return crawl.outcomes(readability.extract(html_pages(spark, d).drop("title", "content")))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = crawl.links(html_pages(spark, d).withColumn("url", F.concat(F.lit("https://host"), (F.col("page_id") % 7).cast("string"), F.lit(".example/a/b"))))
    return links.groupBy("dst_url").agg(F.count(F.lit(1)).alias("n"))


def attribute_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(a,) for a in ATTRIBUTES], "attr string")
    return rows.select("attr", readability.attribute_score(F.col("attr")).cast("double").alias("score"))


def tag_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    return rows.select("tag", readability.tag_kind(F.col("tag")).alias("kind"), readability.tag_category(F.col("tag")).alias("category"))


def frame_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score formula over the stored frames."""
    f = table(spark, d, "element_frame").filter("link_char_count IS NOT NULL").select("page_id", "frame_no", "base_score", "char_count", "link_char_count", "comma_count").distinct()
    score = readability.final_score(F.col("base_score"), F.col("char_count"), F.col("link_char_count"), F.col("comma_count"))
    return f.select("page_id", "frame_no", (F.round(score.cast("double"), 3) + 0.0).alias("score"), readability.viable(F.lit("div"), F.col("char_count")).alias("viable"))


def stripped(spark: SparkSession, d: str) -> DataFrame:
    """The text of markup made of each result's title and description."""
    m = F.concat(F.lit("<b>"), text.html_escape(text.or_empty(F.col("title"))), F.lit("</b>\n<i class='x'>"), text.html_escape(text.or_empty(F.col("description"))), F.lit("</i>"))
    return table(spark, d, "search_result").select("result_id", text.strip_html(m).alias("plain"))


def normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfkc(F.col("text")).alias("text"))


# ------------------------------------------------------------------ index


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return index.latest_pages(table(spark, d, "page_data").select("page_id", "url", "title", "content").distinct(), "page_id")


def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("url", "page_id")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Odd pages over even ones: one row a url, the new one where both have it."""
    pages = table(spark, d, "page_data").select("page_id", "url").distinct()
    pick = lambda odd: index.latest_pages(pages.filter(F.col("page_id") % 2 == odd), "page_id")
    return index.upsert(pick(0), pick(1))


def field_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of urls and titles with the documents and places that hold them."""
    p = index.postings(_latest(spark, d), stemmed=False).filter(F.col("field") != "body")
    return p.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_places"))


def body_terms(spark: SparkSession, d: str) -> DataFrame:
    """Plain body terms of each url with their count and first place."""
    p = index.postings(_latest(spark, d).withColumn("title", F.lit("")), stemmed=False).filter("field = 'body'")
    ids = index.documents(_latest(spark, d)).select("doc_id", "url")
    return p.join(ids, "doc_id").select("url", "term", "tf", F.element_at("positions", 1).alias("first"))


def body_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of all bodies with their number of documents."""
    p = index.postings(_latest(spark, d)).filter("field = 'body'")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def index_search(spark: SparkSession, d: str) -> DataFrame:
    pages = _latest(spark, d)
    return index.bm25(index.postings(pages), index.documents(pages), ["greenhous", "council", "bridg"])


# ------------------------------------------------------------------ discovery


def _edges(spark: SparkSession, d: str) -> DataFrame:
    page = lambda n: F.concat(F.lit("https://site.example/p"), n.cast("string"))
    far = F.concat(F.lit("https://far"), F.col("l_suppkey").cast("string"), F.lit(".example/x"))
    return table(spark, d, "lineitem").select(page(F.col("l_partkey")).alias("src_url"), F.when(F.col("l_suppkey") % 5 == 0, far).otherwise(page(F.col("l_suppkey") * 7)).alias("dst_url"))


def discovered_urls(spark: SparkSession, d: str) -> DataFrame:
    return crawl.discover(_edges(spark, d), "https://site.example/p1", ["https://site.example/p3"])[0].select("url")


def discovered_domains(spark: SparkSession, d: str) -> DataFrame:
    return crawl.discover(_edges(spark, d), "https://site.example/p1", ["https://site.example/p3"])[1]


def cached_sources(spark: SparkSession, d: str) -> DataFrame:
    """What a one-hour cache serves for each source and query at one moment."""
    log = table(spark, d, "search_result").select(F.concat_ws(":", "source", "query_id").alias("key"), F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("url").isNotNull().alias("ok"))
    out = pipelines.snapshot(log, "key", "fetched_at", F.col("ok"), F.to_timestamp(F.lit(AS_OF)))
    return out.select("key", F.unix_micros("fetched_at").alias("fetched_micros"), "state")


def _linking(spark: SparkSession, d: str) -> DataFrame:
    """Markup that links to every result: plainly, through the visit service, and as a listing."""
    u = text.html_escape(F.lower(F.trim("url")))
    host = urls.url_host(F.lower(F.trim("url")))
    html = F.concat(F.lit('<a href="'), u, F.lit('">x</a><a href="/local">y</a><a href="https://api.smallweb.cc/db/visit/'), host, F.lit('/feed">z</a><a class="title may-blank outbound" href="'), u, F.lit('">t</a><span class="next-button"><a href="?after=1">next</a></span>'))
    return table(spark, d, "search_result").filter("url IS NOT NULL").select(html.alias("html"), F.lower(F.trim("url")).alias("u"))


def anchor_hosts(spark: SparkSession, d: str) -> DataFrame:
    return harvest.anchor_hosts(_linking(spark, d))


def visit_hosts(spark: SparkSession, d: str) -> DataFrame:
    return harvest.visit_hosts(_linking(spark, d))


def listing_hosts(spark: SparkSession, d: str) -> DataFrame:
    return harvest.listing_hosts(_linking(spark, d))


def markdown_hosts(spark: SparkSession, d: str) -> DataFrame:
    return harvest.text_hosts(_linking(spark, d).select(F.concat(F.lit("- [x]("), F.col("u"), F.lit(") and more")).alias("value")))


def json_hosts(spark: SparkSession, d: str) -> DataFrame:
    return harvest.json_hosts(_linking(spark, d).select(F.to_json(F.struct(F.array("u", F.concat(F.col("u"), F.lit("/x"))).alias("sites"))).alias("value")), "$.sites")


def harvested(spark: SparkSession, d: str) -> DataFrame:
    """All scans of one run as one list."""
    return harvest.harvest(*[f(spark, d) for f in (anchor_hosts, visit_hosts, listing_hosts, markdown_hosts, json_hosts)])


# ------------------------------------------------------------------ source answers


def _answers(spark: SparkSession, d: str, source: str, body: Column) -> DataFrame:
    rows = table(spark, d, "search_result")
    return rows.select(F.lit(source).alias("source"), F.col("result_id").cast("string").alias("query"), F.lit(200).alias("status"), F.col("fetched_at").cast("timestamp").alias("fetched_at"), body.alias("body"))


def _read(parse, answers: DataFrame) -> DataFrame:
    out = parse(parsers.ok_body(answers))
    return out.select(F.col("query").cast("bigint").alias("result_id"), "source", "rank", "title", "url", "description", "image")


def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Three JSON sources read back: a list, an object, and a nested listing."""
    t, u, x = F.col("title"), F.col("url"), F.col("description")
    a = _answers(spark, d, "wiby", F.to_json(F.array(F.struct(t.alias("Title"), u.alias("URL"), x.alias("Snippet")))))
    b = _answers(spark, d, "marginalia", F.to_json(F.struct(F.array(F.struct(u.alias("url"), t.alias("title"), x.alias("description"))).alias("results"))))
    child = F.struct(F.struct(t.alias("title"), F.concat(F.lit("/r/"), F.col("source")).alias("permalink"), x.alias("selftext"), F.col("image").alias("thumbnail")).alias("data"))
    c = _answers(spark, d, "reddit", F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data"))))
    return _read(parsers.wiby, a).unionByName(_read(parsers.marginalia, b)).unionByName(_read(parsers.reddit, c))


def markup_answers(spark: SparkSession, d: str) -> DataFrame:
    """Five markup sources read back."""
    e = text.html_escape
    t, u, x, i = (e(text.or_empty(F.col(c))) for c in ("title", "url", "description", "image"))
    box = lambda kind: F.concat(F.lit(f'<main><div class="snippet fdb" data-type="{kind}"><a class="l1 h" href="'), u, F.lit('"><div class="title x">'), t, F.lit('</div></a><div class="generic-snippet"><div class="content">'), x, F.lit('</div></div><a class="thumbnail"><img src="'), i, F.lit('"></a></div></main>'))
    fields = F.concat(F.lit('<form><input name="url" value="'), u, F.lit('"><input name="title" value="'), t, F.lit('"><input name="extract" value="'), x, F.lit('"></form>'))
    site = F.concat(F.lit('<div class="search-result"><a class="result-title" href="'), u, F.lit('"><span class="result-title-txt">'), t, F.lit('</span></a><p id="result-hightlight">'), x, F.lit("</p></div>"))
    known = F.concat(F.lit('<ul><li class="mb RESULT-3"><a href="/p">'), t, F.lit("</a><div>"), x, F.lit("</div></li></ul>"))
    ms = F.when(F.col("rank") > 2, (F.unix_seconds(F.col("fetched_at").cast("timestamp")) * 1000 - F.col("rank") * F.lit(86_400_000).cast("bigint")).cast("string")).otherwise("soon")
    promo = F.concat(F.lit('<div class="PagePromo" data-posted-date-timestamp="'), ms, F.lit('"><div class="PagePromo-title"><a class="Link" href="'), u, F.lit('"><span class="PagePromoContentIcons-text">'), t, F.lit('</span></a></div><div class="PagePromo-description"><span class="PagePromoContentIcons-text">'), x, F.lit("</span></div></div>"))
    parts = [
        _read(parsers.brave, _answers(spark, d, "brave", box("web"))), _read(parsers.brave_news, _answers(spark, d, "brave news", box("news"))), _read(parsers.mwmbl, _answers(spark, d, "mwmbl", fields)),
        _read(parsers.searchmysite, _answers(spark, d, "searchmysite", site)), _read(parsers.britannica, _answers(spark, d, "britannica", known)), _read(parsers.apnews, _answers(spark, d, "apnews", promo)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Feed entries read back from Atom documents."""
    e = text.html_escape
    t, u, x = (e(text.or_empty(F.col(c))) for c in ("title", "url", "description"))
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), t, F.lit('</title><link href="'), u, F.lit('"/><summary>&lt;b&gt;'), e(x), F.lit("&lt;/b&gt;</summary></entry></feed>"))
    got = parsers.feed_entries(_answers(spark, d, "smallweb news", xml).withColumn("fetched_at", F.col("query")))
    return got.select(F.col("fetched_at").cast("bigint").alias("result_id"), "title", "url", "summary")


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A number out of the events' JSON."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "q_" + f.__name__: f
    for f in (
        best_elements, element_kinds, main_content, page_titles, page_outcomes, page_links, attribute_scores, tag_classes, frame_scores, stripped, normalised, latest_pages, upserted, field_terms, body_terms, body_stems, index_search,
        discovered_urls, discovered_domains, cached_sources, anchor_hosts, visit_hosts, listing_hosts, markdown_hosts, json_hosts, harvested, json_answers, markup_answers, feed_entries, event_properties,
    )
}

_WS = r"[\s\p{Z}\x{85}\x0b]+"
_SQ = "trim(regexp_replace({}, '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_PAGE = f"""p AS (SELECT DISTINCT page_id, coalesce(title, '') AS title, list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: {_SQ.format('x')} <> '') AS lines FROM page_data),
s AS (SELECT page_id, title, len(lines) AS n_lines, strlen({_SQ.format('title')}) AS h, coalesce(list_sum(list_transform(lines, lambda x: strlen({_SQ.format('x')}))), 0) AS b,
  len(title) - len(replace(title, ',', '')) AS hc, coalesce(list_sum(list_transform(lines, lambda x: len(x) - len(replace(x, ',', '')))), 0) AS c FROM p)"""
_LATEST = "latest AS (SELECT * FROM (SELECT DISTINCT page_id, url, title, content FROM page_data) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)"
_TOK = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
_EDGES = """e AS (SELECT 'https://site.example/p' || l_partkey AS s, CASE WHEN l_suppkey % 5 = 0 THEN 'https://far' || l_suppkey || '.example/x' ELSE 'https://site.example/p' || (l_suppkey * 7) END AS t FROM lineitem),
v AS (SELECT 'https://site.example/p1' AS url UNION SELECT t FROM e JOIN v ON s = url WHERE starts_with(url, 'https://site.example/') AND NOT starts_with(url, 'https://site.example/p3'))"""
_T = r"regexp_replace(title, '^\s+|\s+$', '', 'g')"
_R = "SELECT result_id, '{}' AS source, 1 AS rank, {} AS title, {} AS url, {} AS description, {} AS image FROM search_result WHERE {}"

_U = "u AS (SELECT lower(trim(url)) AS u FROM search_result WHERE url IS NOT NULL)"
_AH = "SELECT regexp_extract(u, '^https?://([^/?]+)', 1) AS domain FROM u UNION ALL SELECT 'api.smallweb.cc'"
_VH = r"SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^(?s:.*?)://', ''), '(?s)[/?].*\z', ''), ':[0-9]*\z', ''), '^www\.', '') AS domain FROM u"
_LH = "SELECT regexp_extract(u, '^https?://([^/]+)', 1) AS domain FROM u"
_MH = "SELECT regexp_extract(unnest(regexp_extract_all('- [x](' || u || ') and more', 'https?://[^/ )]+')), '^https?://([^/]+)', 1) AS domain FROM u"
_JH = "SELECT CASE WHEN split_part(u, '/', 1) IN ('http:', 'https:') THEN split_part(u, '/', 3) ELSE split_part(u, '/', 1) END AS domain FROM u"

ORACLE = {
    "q_anchor_hosts": f"WITH {_U} SELECT DISTINCT domain FROM ({_AH}) WHERE domain <> ''",
    "q_visit_hosts": f"WITH {_U} SELECT DISTINCT domain FROM ({_VH}) WHERE domain <> ''",
    "q_listing_hosts": f"WITH {_U} SELECT DISTINCT domain FROM ({_LH}) WHERE domain <> ''",
    "q_markdown_hosts": f"WITH {_U} SELECT DISTINCT domain FROM ({_MH}) WHERE domain <> ''",
    "q_json_hosts": f"WITH {_U} SELECT DISTINCT domain FROM ({_JH}) WHERE domain <> ''",
    "q_harvested": f"WITH {_U} SELECT DISTINCT domain FROM ({_AH} UNION ALL {_VH} UNION ALL {_LH} UNION ALL {_MH} UNION ALL {_JH}) WHERE domain <> ''",
    "q_best_elements": f"""WITH {_PAGE} SELECT page_id, CASE WHEN h + b >= 100 THEN 'article' ELSE 'body' END AS tag, CASE WHEN h + b >= 100 THEN h + b ELSE h + b + 12 END::BIGINT AS bytes,
CASE WHEN h + b >= 100 THEN 0 ELSE 9 END::BIGINT AS link_bytes, (hc + c)::BIGINT AS commas,
round((CASE WHEN h + b >= 100 THEN (55 + sqrt((h + b)::FLOAT)::FLOAT)::FLOAT + (hc + c)::FLOAT ELSE sqrt((h + b + 12)::FLOAT)::FLOAT + (hc + c)::FLOAT END)::FLOAT::DOUBLE, 2) AS score FROM s WHERE h + b + 12 >= 100""",
    "q_element_kinds": f"""WITH {_PAGE} SELECT 'article' AS tag_type, count(*) AS n, sum(h + b)::BIGINT AS bytes, 0::BIGINT AS link_bytes, sum(hc + c)::BIGINT AS commas FROM s
UNION ALL SELECT 'header', count(*), sum(h)::BIGINT, 0, sum(hc)::BIGINT FROM s
UNION ALL SELECT 'p', sum(n_lines)::BIGINT, sum(b)::BIGINT, 0, sum(c)::BIGINT FROM s
UNION ALL SELECT 'other', 4 * count(*), (2 * sum(h + b + 12) + 12 * count(*))::BIGINT, 27 * count(*), 2 * sum(hc + c)::BIGINT FROM s""",
    "q_page_titles": f"SELECT DISTINCT page_id, regexp_replace(coalesce(title, ''), '^{_WS}|{_WS}$', '', 'g') AS title FROM (SELECT DISTINCT page_id, url, title, content FROM page_data)",
    "q_page_outcomes": f"WITH {_PAGE} SELECT count(*) FILTER (WHERE h + b + 12 >= 100) AS indexed, count(*) FILTER (WHERE h + b + 12 < 100) AS failed, 0::BIGINT AS skipped FROM s",
    "q_page_links": "WITH p AS (SELECT DISTINCT page_id, url, title, content FROM page_data), l AS (SELECT 'https://host' || (page_id % 7) || '.example' AS h FROM p) SELECT h || '/about' AS dst_url, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT h || '/a/next', count(*) FROM l GROUP BY 1",
    "q_attribute_scores": f"""WITH a AS (SELECT unnest({ATTRIBUTES!r}) AS attr) SELECT attr, CASE WHEN regexp_matches(attr, '(?i){readability.UNLIKELY}') AND NOT regexp_matches(attr, '(?i){readability.AMBIGUOUS}') THEN -50.0
WHEN regexp_matches(attr, '(?i){readability.POSITIVE}') THEN 25.0 WHEN regexp_matches(attr, '(?i){readability.NEGATIVE}') THEN -25.0 ELSE 0.0 END::DOUBLE AS score FROM a""",
    "q_tag_classes": f"""SELECT tag, CASE WHEN tag = 'div' THEN 'div' WHEN tag = 'p' THEN 'p' WHEN regexp_full_match(tag, 'h[1-6]') THEN 'header' WHEN tag IN ('ul', 'ol', 'dl') THEN 'list' WHEN tag IN ('article', 'main', 'section') THEN 'article' ELSE 'other' END AS kind,
CASE WHEN tag IN ('head', 'script', 'form', 'svg', 'embed') THEN 'container' WHEN tag IN ('br', 'img', 'input') THEN 'void' WHEN tag IN ('title', 'button', 'option') THEN 'leaf' ELSE 'content' END AS category FROM (SELECT unnest({TAGS!r}) AS tag)""",
    "q_frame_scores": """WITH f AS (SELECT DISTINCT page_id, frame_no, base_score::FLOAT AS b, char_count AS n, link_char_count AS l, comma_count AS c FROM element_frame WHERE link_char_count IS NOT NULL),
g AS (SELECT *, ((b + sqrt(n::FLOAT)::FLOAT)::FLOAT + c::FLOAT)::FLOAT AS raw, CASE WHEN n = 0 THEN 0::FLOAT ELSE (l::FLOAT / n::FLOAT)::FLOAT END AS d FROM f)
SELECT page_id, frame_no, round((raw * CASE WHEN d <= 0.4::FLOAT THEN 1::FLOAT ELSE greatest(0::FLOAT, least(1::FLOAT, (1::FLOAT - ((d - 0.4::FLOAT)::FLOAT / 0.6::FLOAT)::FLOAT)::FLOAT)) END)::FLOAT::DOUBLE, 3) + 0.0::DOUBLE AS score, n >= 100 AS viable FROM g""",
    "q_stripped": "SELECT result_id, " + _SQ.format("coalesce(title, '') || ' ' || coalesce(description, '')") + " AS plain FROM search_result",
    "q_latest_pages": f"WITH {_LATEST} SELECT url, page_id FROM latest",
    "q_upserted": "WITH n AS (SELECT url, max(page_id) AS page_id FROM page_data WHERE page_id % 2 = 1 GROUP BY 1), o AS (SELECT url, max(page_id) AS page_id FROM page_data WHERE page_id % 2 = 0 GROUP BY 1) SELECT page_id, url FROM n UNION ALL SELECT page_id, url FROM o WHERE url NOT IN (SELECT url FROM n)",
    "q_field_terms": f"""WITH {_LATEST}, t AS (SELECT url AS doc, 'url' AS field, unnest({_TOK.format('url')}) AS term FROM latest UNION ALL SELECT url, 'title', unnest({_TOK.format('title')}) FROM latest)
SELECT field, term, count(DISTINCT doc) AS n_docs, count(*) AS n_places FROM t WHERE strlen(term) < 40 GROUP BY 1, 2""",
    "q_body_terms": f"""WITH {_LATEST}, w AS (SELECT url, {_TOK.format('content')} AS w FROM latest), t AS (SELECT url, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM w)
SELECT url, term, count(*) AS tf, min(pos)::INT AS first FROM t GROUP BY 1, 2""",
    "q_discovered_urls": f"WITH RECURSIVE {_EDGES} SELECT url FROM v",
    "q_discovered_domains": f"WITH RECURSIVE {_EDGES} SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM v",
    "q_cached_sources": f"""WITH l AS (SELECT source || ':' || query_id AS key, fetched_at AS ft, url IS NOT NULL AS ok FROM search_result WHERE fetched_at <= TIMESTAMP '{AS_OF}'),
m AS (SELECT key, max(ft) FILTER (WHERE ok) AS fetched_at FROM l GROUP BY 1) SELECT key, epoch_us(fetched_at) AS fetched_micros, CASE WHEN fetched_at IS NULL THEN 'missing' WHEN fetched_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 'fresh' ELSE 'stale' END AS state FROM m""",
    "q_json_answers": " UNION ALL ".join(
        (
            _R.format("wiby", "title", "url", "coalesce(description, '')", "NULL", "title IS NOT NULL AND url IS NOT NULL"),
            _R.format("marginalia", "title", "url", "coalesce(description, '')", "NULL", "title IS NOT NULL AND url IS NOT NULL"),
            _R.format("reddit", "title", "'https://old.reddit.com/r/' || source", "coalesce(description, '')", "CASE WHEN starts_with(image, 'http') THEN replace(image, '&amp;', '&') END", "title IS NOT NULL"),
        )
    ),
    "q_markup_answers": " UNION ALL ".join(
        (
            _R.format("brave", _T, "url", r"regexp_replace(description, '^\s+|\s+$', '', 'g')", "CASE WHEN starts_with(image, 'http') THEN image END", "url <> ''"),
            _R.format("brave news", _T, "url", r"regexp_replace(description, '^\s+|\s+$', '', 'g')", "CASE WHEN starts_with(image, 'http') THEN image END", "url <> ''"),
            _R.format("mwmbl", "coalesce(title, '')", "coalesce(url, '')", "coalesce(description, '')", "NULL", "true"),
            _R.format("searchmysite", _T, "coalesce(url, '')", _SQ.format("coalesce(description, '')"), "NULL", "true"),
            _R.format("britannica", _T, "'https://www.britannica.com/p'", _SQ.format("coalesce(description, '')"), "NULL", "true"),
            _R.format("apnews", _T, "coalesce(url, '')", r"regexp_replace(coalesce(description, ''), '^\s+|\s+$', '', 'g')", "NULL", "rank > 2 AND rank <= 7"),
        )
    ),
    "q_feed_entries": f"SELECT result_id, {_T} AS title, regexp_replace(url, '[\\t\\n\\r]', ' ', 'g') AS url, {_SQ.format("coalesce(description, '')")} AS summary FROM search_result WHERE url <> ''",
    "q_event_properties": "SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
