"""Pages of repeated keywords, product tags or links (problem 2).

The pass over a page builds the suffix automaton of its words and measures, line by line, how many
characters maximal repeats cover. A page's rule sums them over the lines that aren't boilerplate and
asks whether the page has clauses. Links come from the page's frames: they hold the non-blank lines in
order and count their bytes, so line sizes align frames with lines without moving any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import pages as P


def frame_links(frames: DataFrame) -> DataFrame:
    """``page_id, frame_bytes, frame_links``: bytes and link bytes (-1: unknown) of a page's frames in order; repeated rows once."""
    per = frames.filter("page_id IS NOT NULL AND frame_no IS NOT NULL").groupBy(F.col("page_id").cast("bigint").alias("page_id"), "frame_no")
    per = per.agg(F.max("char_count").cast("int").alias("n"), F.max("link_char_count").cast("int").alias("links"))
    per = per.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("links", F.lit(-1)).alias("links")))).alias("f"))
    return per.select("page_id", F.col("f.n").alias("frame_bytes"), F.col("f.links").alias("frame_links"))


def line_links(sizes: list[int], frames: list | None) -> list[tuple[int, int, int | None]]:
    """(first line, line after the last, link bytes or None) of each frame, by the bytes it counts; none if they don't fit, those before it if one has no count."""
    out, at = [], 0
    for n, links in frames or ():
        if n is None:  # from here on nothing is known
            return out
        to, got = at, 0
        while to < len(sizes) and got < n:
            got += sizes[to]
            to += 1
        if got != n:
            return []
        if to > at:
            out.append((at, to, links))
        at = to
    return out if at == len(sizes) else []


def link_share(sizes: list[int], kinds: list[int], frames: list | None) -> float | None:
    """Share of link bytes in the lines that aren't boilerplate, in frames that know theirs; None if none does.

    Where the frames don't fit the lines (other text, lost frames), the page's sums are taken.
    """
    fits = line_links(sizes, frames)
    if not fits:
        known = [(n, x) for n, x in frames or () if n and x is not None]
        total = sum(n for n, _ in known)
        return min(1.0, sum(x for _, x in known) / total) if total else None
    link = total = 0.0
    for a, b, x in fits:
        core = sum(sizes[i] for i in range(a, b) if kinds[i] != B.BOILER)
        if core and x is not None:
            total += core
            link += min(x, sum(sizes[a:b])) * core / sum(sizes[a:b])
    return link / total if total else None


#: Share of links from which on a page is a list of them, unless sentences make up half of it.
LINK_LIST = 0.55
#: Words below which a page's repeats tell nothing.
LEAST_WORDS = 15


def keyword_page(lines: list[tuple], links: float | None) -> bool:
    """Whether a page is repeated keywords, product names, tags or links, by its lines that aren't boilerplate.

    ``lines``: (kind, characters, words, function words, marks, tag and address characters, word
    characters, those in repeats of two words or more, those in repeats that occur three times, odd characters) each;
    ``links``: share of link bytes, if known. Repeats must cover the page and clauses be missing;
    code, logs and unreadable text repeat too and don't count, nor do tables, whose cells repeat
    without repeating in turn.
    """
    chars = sum(x[1] for x in lines)
    if not chars:
        return False
    of = lambda kinds: sum(x[1] for x in lines if x[0] in kinds) / chars
    prose = of((B.PROSE,))
    tags = sum(x[5] for x in lines) / chars
    if max(links or 0.0, tags) >= LINK_LIST and prose < 0.5:
        return True
    words, stops, solid = sum(x[2] for x in lines), sum(x[3] for x in lines), sum(x[6] for x in lines)
    if words < LEAST_WORDS or not solid or of((B.CODE, B.LOG, B.JUNK)) > 0.4:
        return False
    stop, long, often = stops / words, sum(x[7] for x in lines) / solid, sum(x[8] for x in lines) / solid
    if (long >= 0.66 and stop < 0.25) or (long >= 0.85 and stop < 0.36):
        return True
    items = sum(x[1] for x in lines if x[4] & P.ITEMS) / chars
    figures = sum(x[9] for x in lines) / chars
    return often >= (0.3 if figures < 0.2 else 0.45) and stop < 0.1 and items > 0.6
