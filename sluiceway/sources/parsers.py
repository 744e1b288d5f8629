"""Answers of the federated sources as rows of one schema.

Input: ``source, query, status, fetched_at, body``; everything left of ``body`` is I/O, everything right
of it is here. Output: ``source, query, rank, title, url, description, sources, image``. A body that
cannot be decoded, or in which a required field of any row is missing, gives no rows for its source.
"""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrow import arrow_function
from .html import Selector, squeeze, tree

RESULT = "array<struct<title:string,url:string,description:string,image:string>>"
FIELDS = ("title", "url", "description", "image")


def ok_body(df: DataFrame) -> DataFrame:
    """Answers with a 2xx status and a body; of a plain and a headless fetch the first that has one."""
    got = F.when(F.col("status").between(200, 299), F.col("body"))
    if "headless_body" in df.columns:
        got = F.coalesce(F.nullif(got, F.lit("")), F.nullif(F.col("headless_body"), F.lit("")))
    return df.withColumn("body", got).filter("body IS NOT NULL")


def _rows(df: DataFrame, results: Column, name: str) -> DataFrame:
    flat = df.select("query", F.posexplode(results).alias("pos", "r"))
    return flat.select(
        F.lit(name).alias("source"), "query", (F.col("pos") + 1).alias("rank"), F.col("r.title").alias("title"), F.col("r.url").alias("url"),
        F.coalesce("r.description", F.lit("")).alias("description"), F.array(F.lit(name)).alias("sources"), F.col("r.image").alias("image"),
    )


def _struct(title: Column, url: Column, description: Column, image: Column | None = None) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), description.alias("description"), (image if image is not None else F.lit(None).cast("string")).alias("image"))


def wiby(df: DataFrame) -> DataFrame:
    """A JSON list; rows without title or url are dropped, the others stay."""
    rows = F.filter(F.from_json("body", "array<struct<Title:string,URL:string,Snippet:string>>"), lambda r: r["Title"].isNotNull() & r["URL"].isNotNull())
    return _rows(df, F.transform(rows, lambda r: _struct(r["Title"], r["URL"], F.coalesce(r["Snippet"], F.lit("")))), "wiby")


def marginalia(df: DataFrame) -> DataFrame:
    """A JSON object; one row without title or url voids the answer, missing results are none."""
    rows = F.from_json("body", "struct<results:array<struct<url:string,title:string,description:string>>>")["results"]
    whole = F.forall(rows, lambda r: r["url"].isNotNull() & r["title"].isNotNull())
    return _rows(df, F.when(whole, F.transform(rows, lambda r: _struct(r["title"], r["url"], F.coalesce(r["description"], F.lit(""))))), "marginalia")


def reddit(df: DataFrame) -> DataFrame:
    """A nested JSON listing; thumbnails that are urls become images, one row without title or permalink voids the answer."""
    child = "struct<data:struct<title:string,permalink:string,selftext:string,thumbnail:string>>"
    rows = F.from_json("body", f"struct<data:struct<children:array<{child}>>>")["data"]["children"]
    whole = F.forall(rows, lambda r: r["data"]["title"].isNotNull() & r["data"]["permalink"].isNotNull())
    one = lambda r: _struct(r["data"]["title"], F.concat(F.lit("https://old.reddit.com"), r["data"]["permalink"]), F.coalesce(r["data"]["selftext"], F.lit("")), text.plain_ampersands(text.http_only(r["data"]["thumbnail"])))
    return _rows(df, F.when(whole, F.transform(rows, one)), "reddit")


# ---------------------------------------------------------------- markup


def _text(node) -> str:
    return node.text() if node is not None else ""


def snippets(html: str, kind: str = "web") -> list[tuple]:
    box, link, title, desc, img = (Selector(s) for s in (f"div.snippet[data-type='{kind}']", "a.l1", "div.title", "div.generic-snippet div.content", "a.thumbnail img"))
    out = []
    for s in box.all(tree(html)):
        a, t = link.first(s), title.first(s)
        href = (a.attr("href") or "") if a is not None else ""
        if not href or t is None:
            continue
        i = img.first(s)
        src = i.attr("src") if i is not None else None
        out.append((t.text().strip(), href, _text(desc.first(s)).strip(), src if src and src.startswith("http") else None))
    return out


def zip_shortest(*lists: list) -> list[tuple]:
    return list(zip(*lists, strict=False))


def inputs(html: str) -> list[tuple]:
    root = tree(html)
    urls, titles, extracts = ([v for n in Selector(f"input[name='{f}']").all(root) if (v := n.attr("value")) is not None] for f in ("url", "title", "extract"))
    return [(t, u, d, None) for u, t, d in zip_shortest(urls, titles, extracts)]


def site_results(html: str) -> list[tuple]:
    box, link, title, desc = (Selector(s) for s in ("div.search-result", "a.result-title", "span.result-title-txt", "p#result-hightlight"))
    out = []
    for r in box.all(tree(html)):
        a = link.first(r)
        if a is None or a.attr("href") is None:
            continue
        t = title.first(r)
        out.append(((t if t is not None else a).text().strip(), a.attr("href"), squeeze(_text(desc.first(r))), None))
    return out


def encyclopedia(html: str) -> list[tuple]:
    box, link, desc = Selector('li[class*="RESULT-"]'), Selector("a"), Selector("div")
    out = []
    for r in box.all(tree(html)):
        a = link.first(r)
        if a is None or a.attr("href") is None:
            continue
        out.append((a.text().strip(), "https://www.britannica.com" + a.attr("href"), squeeze(_text(desc.first(r))), None))
    return out


def promos(html: str) -> list[tuple]:
    """As the others, with the posting time in milliseconds as text in place of the image."""
    box, link, title, desc = (Selector(s) for s in ("div.PagePromo", "div.PagePromo-title a.Link", "div.PagePromo-title span.PagePromoContentIcons-text", "div.PagePromo-description span.PagePromoContentIcons-text"))
    out = []
    for r in box.all(tree(html)):
        a = link.first(r)
        if a is None or a.attr("href") is None:
            continue
        out.append((_text(title.first(r)).strip(), a.attr("href"), _text(desc.first(r)).strip(), r.attr("data-posted-date-timestamp")))
    return out


def atom(xml: str) -> list[tuple]:
    """Entries of a feed that have a link: title, url, summary or content in document order; none if it is no XML."""
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return []
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = []
    for e in root.iter():
        if name(e) != "entry":
            continue
        inner = list(e.iter())
        first = lambda *names: next((x for x in inner if name(x) in names), None)  # noqa: B023, E731
        link, title, body = first("link"), first("title"), first("summary", "content")
        href = link.get("href", "") if link is not None else ""
        if href:
            out.append(((title.text or "").strip() if title is not None else "", href, squeeze(tree(body.text or "").text()) if body is not None else "", None))
    return out


def _udf(fn):
    def run(body: pd.Series) -> pd.Series:
        out = []
        for b in body:
            try:
                out.append(None if b is None else [dict(zip(FIELDS, r, strict=True)) for r in fn(b)])
            except Exception:  # noqa: BLE001 - an answer that cannot be read has no results
                out.append(None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"body": pd.Series, "return": pd.Series}
    return arrow_function(RESULT)(run)


def brave(df: DataFrame) -> DataFrame:
    return _rows(df, _udf(lambda b: snippets(b, "web"))(F.col("body")), "brave")


def brave_news(df: DataFrame) -> DataFrame:
    return _rows(df, _udf(lambda b: snippets(b, "news"))(F.col("body")), "brave news")


def mwmbl(df: DataFrame) -> DataFrame:
    return _rows(df, _udf(inputs)(F.col("body")), "mwmbl")


def searchmysite(df: DataFrame) -> DataFrame:
    return _rows(df, _udf(site_results)(F.col("body")), "searchmysite")


def britannica(df: DataFrame) -> DataFrame:
    return _rows(df, _udf(encyclopedia)(F.col("body")), "britannica")


def apnews(df: DataFrame, days: int = 7) -> DataFrame:
    """Promos posted at most ``days`` before the answer was fetched; those without a readable time are dropped."""
    got = df.select("query", "fetched_at", _udf(promos)(F.col("body")).alias("r"))
    since = F.unix_seconds("fetched_at") - days * 86400
    recent = F.filter("r", lambda x: text.seconds(x["image"]) >= since)
    return _rows(got, F.transform(recent, lambda x: _struct(x["title"], x["url"], x["description"])), "apnews")


def feed_entries(df: DataFrame) -> DataFrame:
    """``fetched_at, pos, title, url, summary`` of each feed body."""
    flat = df.select("fetched_at", F.posexplode(_udf(atom)(F.col("body"))).alias("pos", "r"))
    return flat.select("fetched_at", "pos", F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.description").alias("summary"))


PARSERS = {"brave": brave, "brave news": brave_news, "mwmbl": mwmbl, "britannica": britannica, "apnews": apnews, "wiby": wiby, "marginalia": marginalia, "searchmysite": searchmysite, "reddit": reddit}


def parse_all(raw: DataFrame) -> DataFrame:
    """Results of all sources' answers; sources without a parser give none."""
    good = ok_body(raw)
    return reduce(DataFrame.unionByName, [parse(good.filter(F.col("source") == name)) for name, parse in PARSERS.items()])
