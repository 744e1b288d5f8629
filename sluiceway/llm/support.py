"""How far a line's template is spread: the sites on which it stands, and how often within them.

Every page gives keys of its lines (see ``pages``): frames of their sentences, in which figures and
names are slots, and of their leads. A frame that stands on several sites and repeats within them, or
on several pages of one site, is part of a site's furniture and not of an article. Only hashes are
shuffled; counts use partial aggregation, and keys that many rows share are joined apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from . import pages as P

#: Sites on which a supported frame stands (twice as many for a shape with its first word open), and its pages per site over all.
SITES, PER_SITE = 4, 1.5
#: Urls of one site on which a supported frame stands.
URLS = 5
#: Sites on which a frame must stand to be common.
COMMON_SITES = 3
#: Records that must fill a slot which another leaves blank.
FILLED = 2
#: Classes of a key on a page: supported, common to sites, common under differing titles, a blank slot that others fill.
SUPPORTED, COMMON, VARIED, ALIGNED = 1, 2, 4, 8


def key_classes(facts: DataFrame) -> DataFrame:
    """``page_id, hits``: for each page the (line, key, class) of its keys that have a class; pages without are left out.

    Pages count by url, so that copies of a row and crawls of one url weigh once: a 64-bit set of url
    hashes a key and site is a lower bound of their number, and exact for a few. Pages without a
    site give no support and get none.
    """
    occ = facts.filter("site IS NOT NULL").select("page_id", "site", "u", "title", F.explode(F.arrays_zip("keys", "key_at")).alias("k"))
    occ = occ.select("page_id", "site", "u", "title", F.col("k.keys").alias("key"), F.col("k.key_at").alias("at"))
    total = facts.agg(F.sum(F.size("keys"))).first()[0] or 0
    seen = F.bit_or(F.expr("shiftleft(1L, cast(pmod(u, 64) AS int))"))
    has = lambda mark: F.sum((F.col("at").bitwiseAND(F.lit(mark)) != 0).cast("int"))
    per = occ.groupBy("key", "site").agg(F.bit_count(seen).alias("urls"), F.count(F.lit(1)).alias("n"), F.min("title").alias("t1"), F.max("title").alias("t2"), has(P.FILLED_AT).alias("filled"), has(P.BLANK_AT).alias("blank"))
    # always true; it names every column, so that all three reads plan the same exchange and the counts are shuffled once
    per = per.filter(F.coalesce(F.col("t1") <= F.col("t2"), F.lit(True)) & (F.col("filled") <= F.col("n")) & (F.col("blank") <= F.col("n")) & (F.col("urls") <= F.col("n")))
    keys = per.groupBy("key").agg(F.count(F.lit(1)).alias("sites"), F.sum("urls").alias("all_urls"), F.min("t1").alias("t1"), F.max("t2").alias("t2"), F.sum("filled").alias("filled"), F.sum("blank").alias("blank"))
    aligned = (F.col("blank") > 0) & (F.col("filled") >= FILLED)
    keys = keys.filter((F.col("sites") >= COMMON_SITES) | aligned)
    least = SITES * (1 + F.col("key").bitwiseAND(F.lit(1)))
    flag = lambda cond, bit: F.when(cond, F.lit(bit)).otherwise(0)
    classes = (
        flag((F.col("sites") >= least) & (F.col("all_urls") >= PER_SITE * F.col("sites")), SUPPORTED) + flag(F.col("sites") >= COMMON_SITES, COMMON)
        + flag((F.col("sites") >= COMMON_SITES) & (F.col("t1") != F.col("t2")), VARIED) + flag(aligned, ALIGNED)
    )
    # in both joins the groups have one row a key (and site), laid out evenly: they are hashed, and the many rows need no sort
    spread_out = join_groups(per.select("key", "site", "n", "urls"), keys.select("key", "sites", classes.alias("class")).hint("shuffle_hash"), ["key"], "sites", total)
    spread_out = spread_out.select("key", "site", "n", F.col("class").bitwiseOR(flag(F.col("urls") >= URLS, SUPPORTED)).alias("class"))
    local = per.filter(F.col("urls") >= URLS).select("key", "site", "n", F.lit(SUPPORTED).alias("class"))
    met = join_groups(occ.select("page_id", "key", "site", "at"), spread_out.unionByName(local).hint("shuffle_hash"), ["key", "site"], "n", total)
    met = met.withColumn("class", F.when(F.col("at").bitwiseAND(F.lit(P.BLANK_AT)) == 0, F.col("class").bitwiseAND(F.lit(~ALIGNED))).otherwise(F.col("class"))).filter("class > 0")
    # hits are moved as plain rows; only where a page's all are, they become an array
    met = met.select("page_id", F.col("at").bitwiseAND(F.lit(P.BLANK_AT - 1)).alias("line"), "key", "class").repartition("page_id")
    met = met.groupBy("page_id", "line", "key").agg(F.bit_or("class").alias("class"))
    return met.groupBy("page_id").agg(F.collect_list(F.struct("line", "key", "class")).alias("hits"))
