"""Lines repeated across one site's pages (problem 7).

A page is a sequence of line identifiers; a pattern is frequent when it stands on enough distinct
urls of one site. Patterns grow from their prefixes as in PrefixSpan, one distributed round a length:
round one counts single lines, each further round extends the frequent patterns by the line that
follows them in the projected sequences (those of frequent lines only), until none is frequent. Every line of a frequent
sequence is itself a frequent sequence of length one, so what is deleted is settled by round one;
longer sequences tell which lines make up one block.

Counting distinct urls runs as two partial aggregations, and lines or patterns that very many rows
share are joined apart, so neither a hot site nor a line on all of its pages meets in one task.

Patterns are runs in the projected sequences, in which only frequent lines are left: lines of the
articles between them don't part them. Free gaps between frequent lines would make every subset of a
block of n lines a pattern of its own, 2 ** n in all, without a line more or less to delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_limit
from ..session import cut, spread

#: Distinct urls of one site on which a frequent line stands.
SUPPORT = 5

# The full English names of the months.
MONTHS = "january february march april may june july august september october november december".split()


def site(url: Column) -> Column:
    """Host of a url in lower case, without port, user and leading ``www.``; null without host."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def line_keys(content: Column) -> Column:
    """The lines of a text reduced to what makes them the same: letters in lower case, month names left out."""
    s = F.regexp_replace(F.lower(content), r"[^\p{L}\n]+", "  ")
    s = F.concat(F.lit(" "), F.replace(s, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for m in MONTHS:
        s = F.replace(s, F.lit(f" {m} "), F.lit(" "))
    return F.split(F.replace(s, F.lit(" "), F.lit("")), "\n")


def lines(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, site, h1, h2, u``: each line with letters, by the hashes of its key within its site and of its url.

    Pages without url or content have none. h1 and h2 are two 64-bit hashes of site and key under
    differing seeds: among 10 ** 12 lines two keys meet by chance with a probability below 10 ** -14.
    """
    base = spread(pages.select("page_id", "url", "content")).select(F.col("page_id").cast("bigint").alias("page_id"), site(F.col("url")).alias("site"), F.xxhash64("url").alias("u"), F.posexplode(line_keys(F.col("content"))).alias("at", "key"))
    base = base.filter("site IS NOT NULL AND page_id IS NOT NULL AND key <> ''")
    return base.select("page_id", (F.col("at") + 1).cast("bigint").alias("line_no"), F.xxhash64("site").alias("site"), F.xxhash64("site", "key").alias("h1"), F.xxhash64(F.lit("second"), "key", "site").alias("h2"), "u")


def _frequent(items: DataFrame, keys: list[str], support: int) -> DataFrame:
    """Keys that stand on ``support`` distinct urls, with their urls and rows: distinct pairs first, then sums."""
    pairs = items.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_urls"), F.sum("n").alias("n_rows")).filter(F.col("n_urls") >= support)


def _keep(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose keys are among ``groups`` (none null, each once, with ``n_rows``); groups of very many rows are broadcast, at most ``HOT_PARTS`` of them."""
    limit = hot_limit(total)
    if total <= limit:
        return rows.join(groups, keys, "left_semi")
    hot = F.broadcast(groups.filter(F.col("n_rows") > limit))
    return rows.join(groups.filter(F.col("n_rows") <= limit), keys, "left_semi").unionByName(rows.join(hot, keys, "left_semi"))


def occurrences(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``page_id, line_no, site, h1, h2, u`` of every occurrence of a frequent line. Texts are read once; a few numbers a line are kept."""
    all_lines = cut(lines(pages))
    return _keep(all_lines, _frequent(all_lines, ["h1", "h2"], support), ["h1", "h2"], all_lines.count())


def repeated_lines(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``page_id, line_no`` of every occurrence of a frequent sequence, single lines included; distinct."""
    return occurrences(pages, support).select("page_id", "line_no").distinct()


def frequent_sequences(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``site, length, pattern, n_urls``: all frequent sequences of adjacent frequent lines, of any length.

    ``pattern`` is the array of the lines' hashes. Each round extends the frequent patterns of the round
    before by the line that follows them, where what then remains without its first line is frequent
    too; rounds run until one finds nothing. Rows are of fixed size whatever a pattern's length (a
    pattern goes by one number), and those that begin no frequent pattern are gone in the next round.
    """
    seen = occurrences(pages, support).select("page_id", "site", "u", "line_no", "h1").distinct()
    page = Window.partitionBy("page_id", "site", "u")
    at = F.row_number().over(page.orderBy("line_no", "h1"))
    occ = cut(seen.select("page_id", "site", "u", at.alias("at"), F.col("h1").alias("id"), F.col("h1").alias("last")))
    total = occ.count()  # rounds only lose rows
    found = cut(_frequent(occ, ["site", "id"], support).select("site", "id", F.lit(1).alias("length"), F.array("id").alias("pattern"), "n_urls"))
    out, n, wide = None, 1, page.orderBy("at")
    while not found.isEmpty():
        rows = found.select("site", "length", "pattern", "n_urls")
        out = rows if out is None else out.unionByName(rows)
        if n % 16 == 0:  # else the plan grows with the rounds
            out = cut(out)
        n += 1
        pairs = occ.select("page_id", "site", "u", "at", "id", F.lead("id").over(wide).alias("then"), F.lead("last").over(wide).alias("last"), F.lead("at").over(wide).alias("beside"))
        pairs = cut(pairs.filter("beside = at + 1").drop("beside"))
        more = _frequent(pairs, ["site", "id", "then", "last"], support)
        more = more.join(found.select("site", "id", "pattern"), ["site", "id"])
        found = cut(more.select("site", F.xxhash64("id", "then").alias("id"), F.col("id").alias("prefix"), "then", F.lit(n).alias("length"), F.concat("pattern", F.array("last")).alias("pattern"), "n_urls", "n_rows"))
        kept = found.select("site", F.col("prefix").alias("id"), "then", "n_rows")
        occ = _keep(pairs, kept, ["site", "id", "then"], total).select("page_id", "site", "u", "at", F.xxhash64("id", "then").alias("id"), "last")
    return found.select("site", "length", "pattern", "n_urls") if out is None else out


def without_lines(pages: DataFrame, drop: DataFrame) -> DataFrame:
    """``page_id, n_removed, content``: distinct pages with the given lines (``page_id, line_no``) taken out; null content stays null."""
    gone = drop.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    met = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "content").filter("page_id IS NOT NULL").dropDuplicates(["page_id", "content"]).join(gone, "page_id", "left")
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("bigint")), F.lit(False)))
    return met.select("page_id", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.array_join(kept, "\n").alias("content"))
