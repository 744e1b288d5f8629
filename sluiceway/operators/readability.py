"""Main text, title and url of pages.

One Arrow-batched pass turns markup into text chunks and element frames that point into them; scores
and the choice of the best element are column expressions over the frames, so a page's text is
copied once, at the end, and nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.arrow import arrow_function
from ..sources.html import CONTAINERS, LEAVES, VOID, read_frames

#: Bytes of text that a main element has at least.
LEAST_BYTES = 100

# Words in ids and classes.
UNLIKELY = "combx|community|disqus|extra|remark|rss|share|shoutbox|skyscraper|ad-break|agegate|popup"
AMBIGUOUS = "and|column|shadow"
POSITIVE = "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
NEGATIVE = (
    "hidden|banner|comment|com-|contact|foot|footer|footnote|header|masthead|media|meta|menu|nav|outbrain|promo|related|scroll|sidebar|sponsor|"
    "shopping|tags|tool|widget|namespace|action|catlinks|toc|printfooter|jump-to|siteSub|contentSub"
)
# Kinds of tags and what each is worth.
KINDS = {"div": ["div"], "p": ["p"], "header": ["h1", "h2", "h3", "h4", "h5", "h6"], "list": ["ul", "ol", "dl"], "article": ["article", "main", "section"]}
WORTH = {"article": 30.0, "div": 5.0, "p": 10.0, "header": -5.0, "list": -3.0}

_FRAME = "struct<tag:string,id:string,class:string,start:int,n:int,bytes:bigint,link_bytes:bigint,commas:bigint>"
SCHEMA = f"title string, canonical string, chunks array<string>, frames array<{_FRAME}>"


def _f(x: Column) -> Column:
    return x.cast("float")


def tag_kind(tag: Column) -> Column:
    """div, p, header, list, article or other."""
    out = F.lit("other")
    for kind, tags in KINDS.items():
        out = F.when(tag.isin(tags), F.lit(kind)).otherwise(out)
    return out


def tag_category(tag: Column) -> Column:
    """What reading does with a tag: container (left out with all inside), void, leaf, or content."""
    return F.when(tag.isin(sorted(CONTAINERS)), "container").when(tag.isin(sorted(VOID)), "void").when(tag.isin(sorted(LEAVES)), "leaf").otherwise("content")


def attribute_score(value: Column) -> Column:
    """-50 for unlikely and not ambiguous words, else 25 for positive, else -25 for negative ones, else 0; null is 0."""
    has = lambda words: value.rlike(f"(?i){words}")
    return _f(F.when(value.isNull(), 0.0).when(has(UNLIKELY) & ~has(AMBIGUOUS), -50.0).when(has(POSITIVE), 25.0).when(has(NEGATIVE), -25.0).otherwise(0.0))


def base_score(tag: Column, ident: Column, cls: Column) -> Column:
    kind = tag_kind(tag)
    worth = F.lit(0.0)
    for k, w in WORTH.items():
        worth = F.when(kind == k, F.lit(w)).otherwise(worth)
    return _f(_f(_f(worth) + attribute_score(ident)) + attribute_score(cls))


def link_multiplier(n: Column, links: Column) -> Column:
    """1 up to a link density of 0.4, falling to 0 at 1; 1 without text."""
    density = _f(_f(links) / _f(n))
    falling = _f(F.lit(1.0).cast("float") - _f(_f(density - F.lit(0.4).cast("float")) / F.lit(0.6).cast("float")))
    return _f(F.when((n == 0) | (density <= F.lit(0.4).cast("float")), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), falling))))


def final_score(base: Column, n: Column, links: Column, commas: Column) -> Column:
    """(base + root of the bytes + commas) times the link multiplier, in single precision."""
    return _f(_f(_f(_f(base) + _f(F.sqrt(_f(n)))) + _f(commas)) * link_multiplier(n, links))


def viable(tag: Column, n: Column) -> Column:
    """Whether an element can be the main one: no headline or list, and enough text."""
    return ~tag_kind(tag).isin("header", "list") & (n >= LEAST_BYTES)


@arrow_function(SCHEMA, once=True)
def frames_of(html: pd.Series) -> pd.DataFrame:
    """Title, canonical url, text chunks and element frames of pages; nulls for a null page."""
    rows = [read_frames(h) or (None, None, None, None) for h in html]
    names = ("tag", "id", "class", "start", "n", "bytes", "link_bytes", "commas")
    return pd.DataFrame(
        {
            "title": pd.Series([r[0] for r in rows], dtype=object),
            "canonical": pd.Series([r[1] for r in rows], dtype=object),
            "chunks": pd.Series([r[2] for r in rows], dtype=object),
            "frames": pd.Series([None if r[3] is None else [dict(zip(names, f, strict=True)) for f in r[3]] for r in rows], dtype=object),
        }
    )


def scored(frames: Column) -> Column:
    """Each frame with its score and whether it is viable, in closing order."""
    return F.transform(
        frames,
        lambda f, i: F.struct(
            f["tag"].alias("tag"), f["bytes"].alias("bytes"), f["link_bytes"].alias("link_bytes"), f["commas"].alias("commas"), f["start"].alias("start"), f["n"].alias("n"),
            final_score(base_score(f["tag"], f["id"], f["class"]), f["bytes"], f["link_bytes"], f["commas"]).alias("score"), viable(f["tag"], f["bytes"]).alias("viable"), i.alias("seq"),
        ),
    )


def best_frame(frames: Column) -> Column:
    """The viable frame of the highest score above 0; of equal ones the first closed. Null if there is none."""
    good = F.filter(scored(frames), lambda f: f["viable"] & (f["score"] > 0))
    return F.array_max(F.transform(good, lambda f: F.struct(f["score"].alias("score"), (-f["seq"]).alias("order"), f["start"].alias("start"), f["n"].alias("n"))))


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with ``content, title, final_url, error``.

    ``content`` is null with the reason in ``error`` where no element qualifies or the url cannot be
    parsed; empty and null markup are errors too, and never fail a job. Other columns pass through.
    """
    drop = [c for c in pages.columns if c in ("content", "title", "final_url", "error")]
    read = pages.drop(*drop).withColumn("__read", frames_of(F.col(html)))
    found = read.withColumn("__best", best_frame(F.col("__read.frames"))).withColumn("final_url", urls.resolve_url(F.col(url), F.col("__read.canonical")))
    error = F.when(F.col("__best").isNull(), "no main content").when(F.col("final_url").isNull(), "url cannot be parsed")
    body = F.array_join(F.slice(F.col("__read.chunks"), F.col("__best.start") + 1, F.col("__best.n")), " ")
    out = found.withColumn("error", error)
    out = out.withColumn("content", F.when(F.col("error").isNull(), text.nfkc(body))).withColumn("title", F.when(F.col("error").isNull(), text.nfkc(F.col("__read.title"))))
    return out.withColumn("final_url", F.when(F.col("error").isNull(), F.col("final_url"))).drop("__read", "__best")


def element_frames(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row a closed element: its kind, base and final score, counts and text."""
    read = pages.select(key, frames_of(F.col(html)).alias("r")).select(key, F.col("r.chunks").alias("chunks"), F.posexplode("r.frames").alias("frame_no", "f"))
    base = base_score(F.col("f.tag"), F.col("f.id"), F.col("f.class"))
    return read.select(
        key, "frame_no", F.col("f.tag").alias("tag"), tag_kind(F.col("f.tag")).alias("tag_type"), base.alias("base_score"), F.col("f.bytes").alias("char_count"), F.col("f.link_bytes").alias("link_char_count"),
        F.col("f.commas").alias("comma_count"), final_score(base, F.col("f.bytes"), F.col("f.link_bytes"), F.col("f.commas")).alias("score"), F.array_join(F.slice("chunks", F.col("f.start") + 1, F.col("f.n")), " ").alias("extracted_text"),
    )
