"""All page operators over one reading of the texts (problems 1, 2, 5 and 6 together).

Reading every text once, the pass keeps about a kilobyte a page (facts and keys of its lines), written
to the checkpoint folder. The keys tell how far each line's template is spread (``support``), the
frames tell of links; both meet the facts by page, and one judgement over these numbers settles which
lines are boilerplate, and from the others whether the page is prose, keywords or bare of a body. Texts
are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import blocks as B
from . import pages as P
from . import templates
from .boilerplate import second_pass
from .keywords import frame_links, keyword_page, link_share
from .passes import map_rows
from .quality import read_pages, site_of
from .support import COMMON, SUPPORTED, key_classes

#: Bytes of lines besides templates from which on a page has a body.
LEAST_BODY = 120

_JUDGED = "page_id bigint, listlike boolean, keywords boolean, bare boolean, origin int, lines array<bigint>, templates array<bigint>"


def _light_facts(url, title, facts, lines):
    return _facts(url, title, facts, lines, False)


def _facts(url, title, facts, lines, full=True):
    host = site_of(url) or ""
    site = P.hashed(host) if host else None
    return site, P.hashed(url or ""), *P.page(host, title, facts, lines, full)


def judge(i, bits, numbers, sizes, kinds, chars, words, stops, marks, tags, odd, solid, long, often, n_units, hit_lines, hit_keys, hit_classes, frame_bytes, frame_link_bytes):
    """One row of the judgement (see ``_JUDGED``) on one page's facts, the classes of its keys and its frames."""
    n = len(sizes)
    frames = [(a if a >= 0 else None, b if b >= 0 else None) for a, b in zip(frame_bytes or (), frame_link_bytes or (), strict=True)]
    classes: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for line, key, c in zip(hit_lines or (), hit_keys or (), hit_classes or (), strict=True):
        at = classes[min(line, n)]
        at[key] = at.get(key, 0) | c
    label, body = list(kinds), 0
    for k in range(n):
        units = n_units[k]
        if not classes[k]:
            if units and kinds[k] != B.BOILER:
                body += sizes[k]
            continue
        n_supported = n_common = 0
        led = False  # by its lead or shape
        for key, c in classes[k].items():
            if key & (P.SHAPE | P.LEAD):
                led = led or c & SUPPORTED > 0
            else:
                n_supported += c & SUPPORTED > 0
                n_common += c & COMMON > 0 and not key & P.WEAK
        common = 0 < units <= n_common
        if led or 0 < units <= n_supported:
            label[k] = B.BOILER
        elif not (kinds[k] in (B.PROSE, B.SHORT) and common or not units or kinds[k] == B.BOILER):
            body += sizes[k]
    core = [k for k in range(n) if label[k] != B.BOILER]
    origin, bare = templates.origins(bits, marks, core, words, classes), body < LEAST_BODY
    if n and not numbers:  # read for residue only
        yield i, False, False, bare, origin, [], templates.candidates(classes, kinds)
        return
    v = [0] * P.WIDTH
    for k in core:
        v[P.N_LINES] += 1
        v[P.N_CHARS] += chars[k]
        v[P.N_WORDS] += words[k]
        v[P.STOPS] += stops[k]
        v[P.ODD] += odd[k]
        v[P.SPACES] += words[k] - 1
        if marks[k] & P.ENDED:
            v[P.ENDED_LINES] += 1
            v[P.ENDED_CHARS] += chars[k]
        if P.dense(words[k], stops[k]):
            v[P.DENSE_CHARS] += chars[k]
    stuffed = keyword_page([(kinds[k], chars[k], words[k], stops[k], marks[k], tags[k], solid[k], long[k], often[k], odd[k]) for k in core], link_share(sizes, label, frames))
    bad = [no for no, out in zip(numbers, second_pass(sizes, label, frames), strict=True) if out]
    yield i, bool(core) and not P.prose(v), stuffed, bare, origin, bad, templates.candidates(classes, kinds)


def _judge_light(i, bits, sizes, kinds, words, marks, n_units, hit_lines, hit_keys, hit_classes):
    """``judge`` without what only problems 1, 2 and 5 ask."""
    return judge(i, bits, (), sizes, kinds, (), words, (), marks, (), (), (), (), (), n_units, hit_lines, hit_keys, hit_classes, None, None)


class Review:
    """The facts of a table of pages, and what follows from them.

    Null or blank content makes no lines and no case by itself; rows without ``page_id`` are left
    out, repeated rows count once. Frames that don't fit a page's text, or miss, leave its lines to the
    other rules; pages without a url have no site, and only their own lines speak for them. Without
    frames only ``residue`` is settled, and what the others ask is not read.
    """

    def __init__(self, pages: DataFrame, frames: DataFrame | None = None):
        facts = read_pages(pages, _light_facts if frames is None else _facts, f"site bigint, u bigint, {P.PAGE}", full=frames is not None)
        facts = cut(facts.drop(*P.FULL) if frames is None else facts)
        met = facts.drop("keys", "key_at", "site", "u", "title").join(key_classes(facts), "page_id", "left")
        hits = [F.col(f"hits.{c}").alias(f"hit_{c}") for c in ("line", "key", "class")]
        if frames is None:
            self.judged = cut(map_rows(met.select("page_id", "bits", "sizes", "kinds", "words", "marks", "n_units", *hits), _judge_light, _JUDGED))
        else:
            arrays = ["numbers", "sizes", "kinds", "chars", "words", "stops", "marks", "tags", "odd", "solid", "long", "often", "n_units"]
            met = met.join(frame_links(frames), "page_id", "left")
            self.judged = cut(map_rows(met.select("page_id", "bits", *arrays, *hits, "frame_bytes", "frame_links"), judge, _JUDGED))

    def residue_origins(self) -> DataFrame:
        """``page_id, origin`` of problem 6, with the bits of what gave it away."""
        return templates.residue(self.judged)

    def residue(self) -> DataFrame:
        """``page_id`` of problem 6."""
        return self.residue_origins().select("page_id")

    def keyword_pages(self) -> DataFrame:
        """``page_id`` of problem 2."""
        return self.judged.filter("keywords").select("page_id").distinct()

    def list_pages(self) -> DataFrame:
        """``page_id`` of problem 1: neither prose nor template residue."""
        return self.judged.filter("listlike OR keywords").select("page_id").distinct().join(self.residue(), "page_id", "left_anti")

    def lines(self) -> DataFrame:
        """``page_id, line_no`` of the lines that aren't main body, on all pages; lines are numbered from 1, blank ones count."""
        return self.judged.select("page_id", F.explode("lines").alias("line_no")).distinct()

    def boilerplate_lines(self) -> DataFrame:
        """``page_id, line_no`` of problem 5, on the pages that neither problem 1 nor 6 holds."""
        kept = self.judged.filter("NOT (listlike OR keywords) AND size(lines) > 0").join(self.residue(), "page_id", "left_anti")
        return kept.select("page_id", F.explode("lines").alias("line_no")).distinct()
