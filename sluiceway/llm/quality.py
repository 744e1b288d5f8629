"""Per-document text statistics, and the reading of texts of any size (problems 1, 2, 5 and 6).

Huge texts are cut into chunks; each chunk gives a partial state (facts of its closed lines, its open
first and last piece), states merge associatively in a tree of bounded fan-in, where pieces that meet
are read as the one line they are, and ratios and rules are taken from what is merged. A text within
one chunk goes the same way without the tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pages as P
from .passes import map_rows

#: Characters of a chunk.
CHUNK = 1 << 17
#: States merged by one task at each level; FAN_IN ** LEVELS chunks are more than a Spark string can hold.
FAN_IN, LEVELS = 32, 3


def site_of(url: str | None) -> str | None:
    """Host of a url without port and leading ``www.``, in lower case; None without host."""
    if url is None:
        return None
    s = url.strip()
    s = s.split("://", 1)[-1]
    for c in "/?#":
        s = s.split(c, 1)[0]
    s = s.rsplit("@", 1)[-1].lower()
    s = s.split(":", 1)[0]
    return (s[4:] if s.startswith("www.") else s) or None


def read_pages(pages: DataFrame, result: Callable, schema: str, chunk: int | None = None, full: bool = True) -> DataFrame:
    """One row for each row of ``pages`` (``page_id, url, title, content``): ``page_id`` and ``result(url, title, facts, lines)``.

    Null content reads as empty. Rows without ``page_id`` are left out. Exact copies of a long text's
    row are read once. ``full`` as in ``pages._line_facts``.
    """
    chunk = chunk or CHUNK
    schema = f"page_id bigint, {schema}"
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "title", F.coalesce("content", F.lit("")).alias("content")).filter("page_id IS NOT NULL")

    def whole(i, url, title, content):
        return ((i, *result(url, title, *P.read(content, site_of(url) or "", full))),)

    short = map_rows(rows.filter(F.length("content") <= chunk), whole, schema, scan=True)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / chunk).cast("int")), lambda i: F.substring(F.col("content"), i * chunk + 1, F.lit(chunk)))
    pieces = rows.filter(F.length("content") > chunk).select("page_id", "url", "title", F.posexplode(cuts).alias("at", "t"))
    state_schema = "page_id bigint, url string, title string, at int, s binary"
    state = map_rows(pieces, lambda i, url, title, at, t: ((i, url, title, at, pickle.dumps(P.partial(t, site_of(url) or "", full), 5)),), state_schema)

    def merged(key, frame):
        frame = frame.drop_duplicates("at").sort_values("at")
        host = site_of(frame["url"].iloc[0]) or ""
        s = reduce(lambda a, b: P.merge(a, b, host, full), map(pickle.loads, frame["s"]))
        return frame.iloc[:1].assign(at=int(key[1]), s=pickle.dumps(s, 5))

    for _ in range(LEVELS):
        state = state.groupBy("page_id", F.floor(F.col("at") / FAN_IN).cast("int").alias("g")).applyInPandas(merged, state_schema)

    def last(i, url, title, _, s):
        return ((i, *result(url, title, *P.finish(pickle.loads(s), site_of(url) or "", full))),)

    return short.unionByName(map_rows(state, last, schema))


def counts(df: DataFrame, id_col: str, text: Column, chunk: int | None = None) -> DataFrame:
    """``page_id, v``: the vector of counts of each text (see ``pages``); null text counts as empty. Repeated rows give repeated rows."""
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"), text.alias("content"))
    return read_pages(rows, lambda url, title, facts, lines: (P.counts(facts),), "v array<bigint>", chunk)


def ratios(counted: DataFrame) -> DataFrame:
    """Statistics of each document by name, from ``counts``, and ``is_prose``: natural prose by these ratios."""
    v = lambda i: F.col("v")[i]
    per = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    solid = v(P.N_CHARS) - v(P.SPACES)
    return counted.select(
        "page_id",
        v(P.N_LINES).alias("n_lines"),
        v(P.N_CHARS).alias("n_chars"),
        v(P.N_WORDS).alias("n_words"),
        per(solid, v(P.N_WORDS)).alias("mean_word_length"),
        per(v(P.ODD), solid).alias("symbol_ratio"),
        per(v(P.ENDED_LINES), v(P.N_LINES)).alias("ended_share"),
        per(v(P.STOPS), v(P.N_WORDS)).alias("common_word_share"),
        per(v(P.DENSE_CHARS), v(P.N_CHARS)).alias("dense_share"),
        prose(F.col("v")).alias("is_prose"),
    )


def prose(v: Column) -> Column:
    """``pages.prose`` as a column."""
    n, words, solid = v[P.N_CHARS], v[P.N_WORDS], v[P.N_CHARS] - v[P.SPACES]
    common = (v[P.STOPS] * 5 >= words) & (v[P.DENSE_CHARS] * 5 >= n * 3)
    other = (v[P.STOPS] * 8 < words) & (words >= 12 * v[P.N_LINES]) & (v[P.ENDED_CHARS] * 2 >= n) & (solid >= 3 * words) & (solid <= 8 * words) & (v[P.ODD] * 20 <= solid)
    return (n > 0) & (common | other)
