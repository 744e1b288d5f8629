"""Federated results: relevance, interleaving, fusion of sources, feed search, rendering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .skew import row_numbers


def relevant(query: Column, *parts: Column) -> Column:
    """Whether any word of the query is a substring of the joined parts, case aside; a query without words fits everything."""
    words = text.query_words(query)
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(whole, w))


def answerable(q: Column) -> Column:
    """Queries that are searched at all: present and not empty; blanks count as text."""
    return F.coalesce(q != "", F.lit(False))


def rank_in_source(results: DataFrame, keys: list[str], order: list[str], total_rows: int | None = None) -> DataFrame:
    """1-based place of each row within its source's list."""
    return row_numbers(results, keys, order, "place", total_rows)


def top_per_source(results: DataFrame, keys: list[str], order: list[str], first: int = 4) -> DataFrame:
    """The first rows of each source; the limit prunes each task's rows before they are shuffled."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= first)


def interleave(results: DataFrame, query: str, arrival: str, order: list[str], first: int = 4, total_rows: int | None = None) -> DataFrame:
    """Emission order per query: the first rows of each source as it arrives, then the rest.

    Adds ``place``, ``tier`` (0 or 1), ``position`` from 1, and ``side``: left and right take turns.
    ``order`` must make a source's rows unique. ``total_rows`` is an upper bound that saves a count.
    """
    placed = rank_in_source(results, [query, arrival], order, total_rows).withColumn("tier", F.when(F.col("place") <= first, 0).otherwise(1))
    placed = row_numbers(placed, [query], ["tier", arrival, "place"], "position", total_rows)
    return placed.withColumn("side", F.when((F.col("position") - 1) % 2 == 0, "left").otherwise("right"))


def fuse(results: DataFrame, keys: list[str], seen: DataFrame | None = None, adjust: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pages of all sources by mean rank: one row per deduplicated url.

    Input: the ``keys`` (the query), ``source_idx``, ``source``, ``rank``, ``url``, ``title``, ``description``.
    The first source's record stays; sources are named in the order they came. ``adjust`` changes a
    rank before it is averaged, keys in ``seen`` (``dedup_key``) are left out. Ties go by key. Two
    aggregations with partial sums, no list of results is ever held.
    """
    rank = adjust(F.col("rank").cast("double")) if adjust else F.col("rank").cast("double")
    rows = results.filter("url IS NOT NULL").withColumns({"dedup_key": urls.dedup_key(F.col("url")), "adjusted": rank})
    if seen is not None:
        rows = rows.join(seen.select("dedup_key").distinct(), "dedup_key", "left_anti")
    order = F.struct("source_idx", "rank", F.col("url").alias("u"))
    per = rows.groupBy(*keys, "dedup_key", "source").agg(
        F.sum("adjusted").alias("total"), F.count(F.lit(1)).alias("n"), F.min(order).alias("at"), F.min_by(F.struct("title", "url", "description"), order).alias("record")
    )
    out = per.groupBy(*keys, "dedup_key").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min_by("record", "at").alias("record"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"),
    )
    return out.select(*keys, "dedup_key", (F.col("total") / F.col("n")).alias("mean_rank"), F.col("n").alias("n_ranks"), F.col("record.title").alias("title"), F.col("record.url").alias("url"), F.col("record.description").alias("description"), "sources")


def in_order(fused: DataFrame, keys: list[str], total_rows: int | None = None) -> DataFrame:
    """The rows of ``fuse`` with ``position`` within their query, best mean rank first, ties by key; a hot query is numbered range by range."""
    return row_numbers(fused, keys, ["mean_rank", "dedup_key"], "position", total_rows)


def zip_shortest(*arrays: Column) -> Column:
    """Arrays zipped by position, as long as the shortest; null if any is null."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.arrays_zip(*[F.slice(a, 1, n) for a in arrays])


def feed_search(entries: DataFrame, query: Column, title: str = "title", summary: str = "summary") -> DataFrame:
    """Entries with any word of the query among their tokens, with ``score``: how many words, repeated words each time."""
    toks = text.tokens(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(summary), F.lit(""))))
    hit = entries.withColumn("__tokens", toks)
    score = F.size(F.filter(text.query_words(query), lambda w: F.array_contains("__tokens", w)))
    return hit.withColumn("score", score).drop("__tokens").filter("score > 0")


def best_first(found: DataFrame, tie: str) -> DataFrame:
    """Entries of ``feed_search`` with ``position``: most words first, ties by ``tie``."""
    rows = found.withColumns({"__all": F.lit(0), "__less": -F.col("score")})
    return row_numbers(rows, ["__all"], ["__less", tie], "position").drop("__all", "__less")


def recent(df: DataFrame, ts: str, as_of: Column, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``; a missing time counts as long ago."""
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def render(title: Column, url: Column, description: Column, sources: Column, image: Column, extra: Column) -> Column:
    """A result as a card of markup."""
    e = text.html_escape
    img_class = F.when(F.array_contains(sources, "brave"), "result-img result-img-square").otherwise("result-img")
    img = F.when(image.isNotNull(), F.concat(F.lit('<img class="'), img_class, F.lit('" src="'), e(image), F.lit('" alt="" loading="lazy" referrerpolicy="no-referrer">'))).otherwise("")
    spans = F.array_join(F.transform(sources, lambda s: F.concat(F.lit('<span class="source-'), e(text.source_class(s)), F.lit('">'), e(s), F.lit("</span>"))), " ")
    cls = F.when(extra == "", "result").otherwise(F.concat(F.lit("result "), extra))
    return F.concat(
        F.lit('<div class="'), cls, F.lit('">'), img, F.lit('<div class="result-source">'), spans, F.lit('</div><div class="result-title"><a href="'), e(url), F.lit('">'), e(title),
        F.lit('</a></div><div class="result-url">'), e(url), F.lit('</div><div class="result-desc">'), e(description), F.lit("</div></div>"),
    )


def page_parts(template: str, q: Column) -> tuple[Column, Column]:
    """Head and tail of a result page, around its ``{{RESULTS}}`` mark."""
    status = F.concat(F.lit('<a href="'), text.html_escape(F.concat(F.lit(urls.ENDPOINTS["images"]), urls.encode_query(q))), F.lit('">images</a>'))
    full = text.fill(template, QUERY=text.html_escape(q), STATUS=status)
    return F.split_part(full, F.lit("{{RESULTS}}"), F.lit(1)), F.regexp_extract(full, r"(?s)\{\{RESULTS\}\}(.*)$", 1)


def empty_page(template: str) -> str:
    for mark in ("QUERY", "STATUS", "RESULTS"):
        template = template.replace("{{" + mark + "}}", "")
    return template


def stream_page(results: DataFrame, template: str, q: str, columns: tuple[tuple[str, str], ...] = (("Web", "column-big"), ("Discovery", "column"))) -> Iterator[str]:
    """A result page piece by piece: head, each column's label and cards, tail.

    ``results`` has ``column_no, position, card``; rows arrive in order, one partition at a time in the
    driver, so the page is never held as a whole.
    """
    head, tail = (r for r in results.sparkSession.range(1).select(*page_parts(template, F.lit(q))).first())
    yield head
    yield '<div id="results">'
    at = -1
    for row in results.orderBy("column_no", "position").select("column_no", "card").toLocalIterator():
        while at < row["column_no"]:
            if at >= 0:
                yield "</div>"
            at += 1
            yield f'<div class="{columns[at][1]}"><div class="column-label">{columns[at][0]}</div>'
        yield row["card"]
    while at < len(columns) - 1:
        if at >= 0:
            yield "</div>"
        at += 1
        yield f'<div class="{columns[at][1]}"><div class="column-label">{columns[at][0]}</div>'
    yield "</div></div>"
    yield tail
