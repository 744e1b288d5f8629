"""Menus, notices and footers among the lines of an article (problem 5).

Two passes of block rules. The first decides most blocks: by the density of function words and the
length (sentences are body), by the density of links (from the page's frames), and by how far the
block's template is spread over pages and sites (``support``), which holds for sentence-like notices
too. In the second, short blocks left undecided inherit the label of the nearest decided neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .keywords import line_links

#: Link bytes per byte from which on short lines are links, and below which they are not.
LINKED, UNLINKED = 0.65, 0.35
#: Undecided lines in a row at the end of a page that are links.
LINK_RUN = 3


def second_pass(sizes: list[int], kinds: list[int], frames: list | None) -> list[bool]:
    """Whether each line is boilerplate."""
    n = len(kinds)
    label: list[bool | None] = [True if k == B.BOILER else None if k == B.SHORT else False for k in kinds]
    for a, b, links in line_links(sizes, frames):
        if links is None:
            continue
        open_ = [i for i in range(a, b) if kinds[i] in (B.SHORT, B.ITEM)]
        if not open_:
            continue
        total = sum(sizes[a:b])
        short = sum(sizes[i] for i in open_)
        sure = sum(sizes[i] for i in range(a, b) if kinds[i] == B.BOILER)
        if links >= LINKED * total and total - short - sure < total * 0.5:
            hit: bool | None = True  # a block of links
        elif links < UNLINKED * min(sizes[i] for i in open_):
            hit = False  # too few link bytes for any of them
        elif short + sure == total and links - sure >= LINKED * short:
            hit = True
        else:
            hit = None
        for i in open_:
            if hit is not None:
                label[i] = hit
    # undecided: the nearest decided neighbours, by lines
    before: list[tuple[int, bool] | None] = [None] * n
    last = None
    for i in range(n):
        if label[i] is not None:
            last = (i, label[i])
        before[i] = last
    nxt = None
    later_body = False  # whether body stands further down
    out: list[bool] = [False] * n
    for i in range(n - 1, -1, -1):
        if label[i] is not None:
            nxt = (i, label[i])
            later_body = later_body or not label[i]
            out[i] = bool(label[i])
            continue
        p, q = before[i], nxt
        run = (q[0] if q else n) - (p[0] if p else -1) - 1  # undecided lines in a row
        if p is None or q is None:
            # a list of headings after the body's end is one of links
            out[i] = run >= LINK_RUN if q is None and p is not None and not p[1] else bool((p or q) and (p or q)[1])
        elif p[1] == q[1]:
            out[i] = p[1]
        elif p[1]:  # boilerplate before, body after
            out[i] = i - p[0] < q[0] - i
        elif not later_body:
            out[i] = True
        else:  # body before, boilerplate after, and more body behind it: a subhead if alone
            out[i] = run > 1 and q[0] - i < i - p[0]
    return out


def main_body(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``page_id, body``: each page's text without the given lines (``page_id, line_no``); rows of ``pages`` without text are left out."""
    drop = lines.groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    met = pages.filter("content IS NOT NULL").select("page_id", "content").join(drop, "page_id", "left")
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", i + 1), F.lit(False)))
    return met.select("page_id", F.array_join(kept, "\n").alias("body"))
