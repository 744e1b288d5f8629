"""Crawling as tables: links, breadth-first discovery, outcomes, and a data source for live fetches."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from functools import reduce
from itertools import count
from urllib.parse import urlsplit
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from ..session import cut
from ..sources import harvest


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src_url, dst_url``: each page's links, resolved and without fragments; unreadable ones fall out."""
    flat = pages.select(F.col(url).alias("src_url"), F.explode(harvest.anchors(F.col(html))).alias("href"))
    return flat.select("src_url", urls.join_link(F.col("src_url"), F.col("href")).alias("dst_url")).filter("dst_url IS NOT NULL")


def readable(pages: DataFrame) -> DataFrame:
    """Answers that are markup at all, by their content type."""
    return pages.filter(F.contains("content_type", F.lit("text/html")))


def discover(edges: DataFrame, start: str, exclude: list[str] | None = None, rounds: int | None = None, cut_every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from ``start`` over ``src_url, dst_url``: (``url, depth`` visited, ``domain`` seen).

    Every linked url is visited once; only those of the start's own network location outside the
    excluded prefixes are followed. Each round is one equality join of the frontier with the edges
    and one anti join with what was visited; the edges that can be followed are kept once and the
    lineage is cut in the checkpoint folder. Rounds run until none finds a new url; where ``rounds``
    bounds them, a search that is not done by then is an error.
    """
    spark = edges.sparkSession
    home = urlsplit(start).netloc
    edges = edges.filter("src_url IS NOT NULL AND dst_url IS NOT NULL").select("src_url", "dst_url")
    inner = edges.filter((urls.netloc(F.col("src_url")) == home) & ~urls.excluded(F.col("src_url"), exclude or []))
    inner = cut(inner.distinct())  # read in every round
    frontier = spark.createDataFrame([(start, 0)], "url string, depth int")
    layers = [frontier]
    visited = frontier
    for depth in count(1):
        found = inner.join(frontier, F.col("src_url") == F.col("url"), "left_semi").select(F.col("dst_url").alias("url")).distinct()
        frontier = cut(found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if rounds is not None and depth > rounds:
            raise RuntimeError(f"the search is not done after {rounds} rounds")
        layers.append(frontier)
        visited = visited.unionByName(frontier)
        if depth % cut_every == 0:
            visited = cut(visited)
            layers = [visited]
    visited = reduce(DataFrame.unionByName, layers)
    domains = visited.select(urls.netloc(F.col("url")).alias("domain")).filter("domain <> ''").distinct()
    return visited, domains


def outcomes(extracted: DataFrame, html: str = "html") -> DataFrame:
    """``indexed, failed, skipped``: pages with main text, without, and without markup (which count as neither)."""
    has = F.coalesce(F.col(html) != "", F.lit(False))
    return extracted.agg(F.count_if(has & F.col("error").isNull()).alias("indexed"), F.count_if(has & F.col("error").isNotNull()).alias("failed"), F.count_if(~has).alias("skipped"))


def final_url(url: str = "url", redirect: str = "final_redirect"):
    """The url a page was at in the end."""
    return F.coalesce(F.col(redirect), F.col(url))


# ---------------------------------------------------------------- live fetches


class _Site(InputPartition):
    def __init__(self, urls_: list[str]):
        self.urls = urls_


class PoliteReader(DataSourceReader):
    """Reads the urls of one host one after the other with a delay, hosts in parallel."""

    def __init__(self, options):
        self.urls = [u for u in re.split(r"\s+", options.get("urls", "")) if u]
        self.delay = float(options.get("delay", "4"))
        self.timeout = float(options.get("timeout", "10"))
        self.agent = options.get("agent", "Mozilla/5.0 (compatible; sluiceway)")
        self.exclude = [p for p in options.get("exclude", "").split() if p]
        self.robots = options.get("robots", "true").lower() == "true"

    def partitions(self):
        by: dict[str, list[str]] = {}
        for u in self.urls:
            if not any(u.startswith(p) for p in self.exclude):
                by.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Site(v) for v in by.values()] or [_Site([])]

    def _rules(self, url: str) -> RobotFileParser | None:
        """A host's rules; None, which allows all, without any that can be read."""
        parts = urlsplit(url)
        if not self.robots or parts.scheme not in ("http", "https"):
            return None
        try:
            with urlopen(Request(f"{parts.scheme}://{parts.netloc}/robots.txt", headers={"User-Agent": self.agent}), timeout=self.timeout) as r:  # noqa: S310
                rules = RobotFileParser()
                rules.parse(r.read().decode("utf-8", "ignore").splitlines())
                return rules
        except Exception:  # noqa: BLE001
            return None

    def read(self, partition) -> Iterator[tuple]:
        rules = self._rules(partition.urls[0]) if partition.urls else None
        for n, url in enumerate(partition.urls):
            if rules is not None and not rules.can_fetch(self.agent, url):
                continue
            if n:
                time.sleep(self.delay)
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:  # noqa: S310
                    kind = r.headers.get("Content-Type", "")
                    body = r.read().decode("utf-8", "ignore") if "text/html" in kind or url.startswith("data:") else ""
                    yield url, r.geturl(), getattr(r, "status", 200) or 200, kind, body
            except Exception:  # noqa: BLE001 - a page that cannot be fetched is a row without markup
                yield url, None, None, None, ""


class PoliteSource(DataSource):
    """``spark.read.format("polite_pages").option("urls", "...")``: one row a fetched page."""

    @classmethod
    def name(cls):
        return "polite_pages"

    def schema(self):
        return "url string, final_redirect string, status int, content_type string, html string"

    def reader(self, schema):
        return PoliteReader(self.options)
