"""Domain lists: allow, block and harvested lists, and the filter by domain and parent domain."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls

#: Rows of a block list up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of text files; files that don't exist are left out. No file gives an empty table."""
    local = lambda p: p.removeprefix("file://")
    there = [p for p in paths if "://" in p and not p.startswith("file://") or os.path.exists(local(p))]
    return spark.read.text(there) if there else spark.createDataFrame([], "value string")


def seeds(lines: DataFrame) -> DataFrame:
    """Start urls of a domain list in order of its lines; unreadable lines fall out, repeats stay."""
    return lines.select(urls.seed_url(F.col("value")).alias("url")).filter("url IS NOT NULL")


def blocklist(lines: DataFrame) -> DataFrame:
    """Distinct domains of a list: trimmed, lower case, without blank lines and comments."""
    d = F.lower(text.strip(F.col("value")))
    return lines.select(d.alias("domain")).filter((F.col("domain") != "") & ~F.startswith("domain", F.lit("#"))).distinct()


def union_domains(*lists: DataFrame, column: str = "domain") -> DataFrame:
    """All lists as one sorted list of distinct domains; blanks and nulls fall out."""
    both = reduce(DataFrame.unionByName, [x.select(F.col(x.columns[0]).alias(column)) for x in lists])
    return both.filter(f"{column} <> ''").distinct().orderBy(column)


def _matching(df: DataFrame, host: Column, domains: DataFrame, keep: str) -> DataFrame:
    """Semi or anti join on the host or any of its parents, as an equality join over a host's suffixes.

    Hosts are made distinct first, so what is exploded and joined are hosts, not rows.
    """
    small = domains.select(F.col(domains.columns[0]).alias("domain")).distinct()
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    rows = df.withColumn("__host", host)
    hosts = rows.select("__host").filter("__host IS NOT NULL").distinct()
    hit = hosts.select("__host", F.explode(urls.suffixes(F.col("__host"))).alias("domain")).join(small, "domain", "left_semi").select("__host").distinct()
    return rows.join(hit, "__host", keep).drop("__host")


def without_blocked(df: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is neither in the list nor below one of its domains. Null urls stay."""
    return _matching(df, urls.url_host(F.col(url)), domains, "left_anti")


def blocked(df: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is in the list or below one of its domains."""
    return _matching(df, urls.url_host(F.col(url)), domains, "left_semi")


def allowed(allow: DataFrame, block: DataFrame) -> DataFrame:
    """Domains of the allow list that the block list doesn't cover."""
    return _matching(allow.select(F.col(allow.columns[0]).alias("domain")).distinct(), F.col("domain"), block, "left_anti")


def write_domains(domains: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A sorted list of distinct domains as text (``append`` adds lines without another look at the old ones)."""
    union_domains(domains).write.mode(mode).text(path)
