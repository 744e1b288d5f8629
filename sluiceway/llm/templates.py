"""Unfilled templates, filler, error messages and script notices (problem 6).

Records are aligned by the frames of their sentences (see ``support``): the fixed words stay, names and
figures are slots. A page is residue by

* a slot that keeps a variable's name, or stays blank or at a default where other records of the frame
  fill it;
* a template: a sentence or a title that stands on several sites under differing titles, and for the
  most part on pages that hold nothing but such sentences. Footers stand on pages with a body,
  error messages, script notices and filler do not, whatever their words and their length;
* words of the standard filler text;
* messages known by their form, and titles and short pages that word lists know: these only settle
  what is too rare for an alignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import pages as P
from .support import ALIGNED, COMMON, VARIED

#: What gave a page away.
BY_SLOT, BY_TEMPLATE, BY_FILLER, BY_FORM, BY_WORDS = 1, 2, 4, 8, 16


def origins(bits: int, marks: list[int], core: list[int], words: list[int], classes: list[dict[int, int]]) -> int:
    """What a page gives away by itself and by its alignment. ``core`` are the lines that aren't boilerplate, ``classes`` those of each line's keys."""
    out = 0
    if bits & (P.VAR | P.TITLE) or any(m & P.BLANKS and any(c & ALIGNED for c in known.values()) for m, known in zip(marks, classes, strict=False)):
        out |= BY_SLOT
    if bits & P.LATIN:
        out |= BY_FILLER
    if bits & P.MESSAGE:
        out |= BY_FORM
    short = sum(words[k] for k in core) <= P.SHORT_PAGE
    if bits & P.TITLE_WORDS or any(marks[k] & P.FILLER for k in core) or (short and (bits & P.TITLE_DAILY or any(marks[k] & P.NOTICE for k in core))):
        out |= BY_WORDS
    return out


def candidates(classes: list[dict[int, int]], kinds: list[int]) -> list[int]:
    """Keys of a page that may be templates of residue: of its sentences and its title, common to sites under differing titles."""
    out = set()
    for k, known in enumerate(classes):
        titled = k == len(kinds)
        if titled or kinds[k] in (B.PROSE, B.SHORT):
            not_these = P.SHAPE | P.LEAD | (0 if titled else P.WEAK)
            out |= {key for key, c in known.items() if c & COMMON and c & VARIED and not key & not_these}
    return sorted(out)


def residue(judged: DataFrame) -> DataFrame:
    """``page_id, origin`` of the residue pages among judged ones; one row a page."""
    stands = judged.select("page_id", "bare", F.explode("templates").alias("key"))
    of_residue = stands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("bare").alias("n_bare")).filter("n_bare * 2 >= n").select("key")
    by_template = stands.join(of_residue, "key", "left_semi").select("page_id", F.lit(BY_TEMPLATE).alias("origin"))
    own = judged.filter("origin > 0").select("page_id", "origin")
    return own.unionByName(by_template).groupBy("page_id").agg(F.bit_or("origin").alias("origin"))
