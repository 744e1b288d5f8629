"""Harvesting domains out of pages, markdown, JSON and loose text; paged scans."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from ..functions.arrow import arrow_function
from .html import Selector, hrefs, tree


@arrow_function("array<string>")
def _anchors(html: pd.Series) -> pd.Series:
    return pd.Series([hrefs(h) for h in html], dtype=object)


def _sorted(hosts: DataFrame) -> DataFrame:
    return hosts.filter("domain <> ''").distinct().orderBy("domain")


def anchor_hosts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sorted distinct hosts of all absolute links of pages; case, port and user info stay."""
    flat = pages.select(F.explode(_anchors(F.col(html))).alias("href")).filter(urls.absolute(F.col("href")))
    return _sorted(flat.select(urls.pattern_host(F.col("href")).alias("domain")))


def visit_hosts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sorted distinct hosts behind the visit service's redirect links."""
    flat = pages.select(F.explode(_anchors(F.col(html))).alias("href"))
    return _sorted(flat.select(urls.visit_host(F.col("href")).alias("domain")))


def text_hosts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sorted distinct hosts of the urls in markdown or other text."""
    flat = lines.select(F.explode(urls.text_urls(F.col(column))).alias("url"))
    return _sorted(flat.select(urls.pattern_host(F.col("url"), False).alias("domain")))


def json_hosts(lines: DataFrame, path: str, column: str = "value") -> DataFrame:
    """Sorted distinct hosts of the urls (or bare hosts) at a JSON path; a list at the path counts with all its items."""
    got = F.get_json_object(column, path)
    items = F.coalesce(F.from_json(got, "array<string>"), F.array(got))
    return _sorted(lines.select(F.explode(items).alias("url")).select(urls.field_host(F.col("url")).alias("domain")))


def loose_hosts(lines: DataFrame, column: str = "value") -> DataFrame:
    """The host of each line of urls or bare hosts, in order, repeats and all."""
    return lines.select(urls.field_host(F.col(column)).alias("domain"))


def listing(html: str | None) -> tuple[list[str], str | None]:
    """Outbound title links of a listing page and the link to its next page."""
    if html is None:
        return [], None
    root = tree(html)
    nxt = Selector("span.next-button a").first(root)
    return [h for n in Selector("a.title.outbound").all(root) if (h := n.attr("href"))], nxt.attr("href") if nxt is not None else None


@arrow_function("array<string>")
def _outbound(html: pd.Series) -> pd.Series:
    return pd.Series([listing(h)[0] for h in html], dtype=object)


def listing_hosts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Sorted distinct hosts of the outbound links of listing pages."""
    flat = pages.select(F.explode(_outbound(F.col(html))).alias("href")).filter(urls.absolute(F.col("href")))
    return _sorted(flat.select(urls.pattern_host(F.col("href"), False).alias("domain")))


def numbered(spark: SparkSession, template: str, first: int, last: int) -> DataFrame:
    """``page, url`` of a numbered scan, both ends included; ``{}`` in the template is the number."""
    head, _, tail = template.partition("{}")
    return spark.range(first, last + 1).select(F.col("id").alias("page"), F.concat(F.lit(head), F.col("id").cast("string"), F.lit(tail)).alias("url"))


def harvest(*scans: DataFrame) -> DataFrame:
    """All scans as one sorted list of distinct domains."""
    return _sorted(reduce(DataFrame.unionByName, scans))


def fetch(url: str, agent: str = "Mozilla/5.0 (compatible; sluiceway)", timeout: float = 10.0) -> str | None:
    """Markup of a url, or None on any failure."""
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:  # noqa: S310
            return r.read().decode("utf-8", "ignore")
    except Exception:  # noqa: BLE001 - a page that cannot be fetched ends the scan
        return None


def follow(start: str, most: int, get: Callable[[str], str | None] = fetch, delay: float = 0.0) -> Iterator[tuple[str, str]]:
    """(url, markup) of a listing and the pages after it, until there is no next one, one fails, or ``most`` are read."""
    url, seen = start, set()
    for n in range(most):
        if n and delay:
            time.sleep(delay)
        html = get(url)
        if html is None:
            return
        yield url, html
        seen.add(url)
        nxt = listing(html)[1]
        if not nxt or (url := urljoin(url, nxt)) in seen:
            return


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _CursorReader(DataSourceReader):
    def __init__(self, options):
        self.starts = options.get("urls", "").split()
        self.most = int(options.get("pages", "10"))
        self.delay = float(options.get("delay", "2"))

    def partitions(self):
        return [_Start(u) for u in self.starts] or [_Start("")]

    def read(self, partition):
        if partition.url:
            yield from follow(partition.url, self.most, delay=self.delay)


class CursorSource(DataSource):
    """``spark.read.format("cursor_pages").option("urls", "...").option("pages", 10)``: listings followed by their next links, one task a listing."""

    @classmethod
    def name(cls):
        return "cursor_pages"

    def schema(self):
        return "url string, html string"

    def reader(self, schema):
        return _CursorReader(self.options)


def literal(values: list[str], spark: SparkSession) -> DataFrame:
    """A list of lines given in the program."""
    return spark.createDataFrame([(v,) for v in values], "value string")


def anchors(html: Column) -> Column:
    """Every ``href`` of every link of a page, in order."""
    return _anchors(html)
