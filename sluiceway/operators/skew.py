"""Joins and ranks that stay even when one key holds a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut as cut_lineage

#: A key is hot when it holds more than 1/HOT_PARTS of all rows, so that at most HOT_PARTS keys are hot.
HOT_PARTS = 1000
#: No key below this many rows is hot: one task sorts that many rows of a few numbers, some 200 MB, with ease.
HOT_LEAST = 4_000_000


def hot_limit(total_rows: int) -> int:
    """Rows beyond which a key is hot. At most ``HOT_PARTS`` keys can be."""
    return max(HOT_LEAST, total_rows // HOT_PARTS)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total_rows: int) -> DataFrame:
    """Inner join of rows with one row per group that carries the group's row count.

    Cold groups meet their rows in a shuffle join, where no key exceeds ``hot_limit``; the hot ones,
    of which there are at most ``HOT_PARTS`` by counting, are broadcast to where their rows are.
    Null-safe on the keys. Below ``HOT_LEAST`` rows in all no key can be hot and one join does.
    """
    on = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))

    def joined(g: DataFrame) -> DataFrame:
        r, g = rows.alias("r"), g.alias("g")
        cond = reduce(lambda x, y: x & y, (F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys))
        extra = [F.col(f"g.{c}") for c in groups.columns if c not in keys]
        return r.join(g, cond, "inner").select("r.*", *extra)

    limit = hot_limit(total_rows)
    if total_rows <= limit:
        return joined(groups)
    hot = F.broadcast(groups.filter(F.col(count) > limit))
    return joined(groups.filter(F.col(count) <= limit)).unionByName(joined(hot))


def grouped_rank(df: DataFrame, group: list[str], value: str, total_rows: int, buckets: int = 256) -> DataFrame:
    """For each distinct value of a group: rows with a smaller value, rows with the same, rows in all.

    Returns ``group, value, n_less, n_equal, n_all``. Ties are folded first by a partial aggregation.
    A group with more than ``hot_limit`` rows is cut into value ranges (edges from a mergeable
    sketch), ranked range by range, and offset by the sizes of the ranges below, so that no task
    sorts a whole hot group; the result is exact. A null in ``group`` is a group like any other;
    ``value`` must not be null.
    """
    dist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_equal"))
    limit = hot_limit(total_rows)
    if total_rows <= limit:
        w = Window.partitionBy(*group)
        below = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return dist.select(*group, value, F.coalesce(F.sum("n_equal").over(below), F.lit(0)).alias("n_less"), "n_equal", F.sum("n_equal").over(w).alias("n_all"))
    dist = cut_lineage(dist)  # read four times below
    sizes = dist.groupBy(*group).agg(F.sum("n_equal").alias("n_all"))
    edges = join_groups(df.select(*group, value), sizes.filter(F.col("n_all") > limit), group, "n_all", total_rows)
    edges = edges.groupBy(*group).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("edges"))
    alike = lambda a, b, keys: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))
    sizes = sizes.alias("s").join(F.broadcast(edges.alias("e")), alike("s", "e", group), "left").select("s.*", "e.edges")  # at most HOT_PARTS rows of fixed size
    cut = join_groups(dist, cut_lineage(sizes), group, "n_all", total_rows)
    bucket: Column = F.coalesce(F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col(value) > e).cast("int")), F.lit(0))
    cut = cut.withColumn("bucket", bucket).drop("edges")
    per = cut.groupBy(*group, "bucket").agg(F.sum("n_equal").alias("in_bucket"))
    offset = F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*group, "bucket", offset.alias("before"))
    within = Window.partitionBy(*group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("n_in", F.coalesce(F.sum("n_equal").over(within), F.lit(0)))
    met = ranked.alias("r").join(per.alias("p"), alike("r", "p", [*group, "bucket"])).select("r.*", "p.before")
    return met.select(*group, value, (F.col("before") + F.col("n_in")).alias("n_less"), "n_equal", "n_all")


def row_numbers(df: DataFrame, group: list[str], order: list, name: str, total_rows: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` that never sorts a hot group in one task.

    ``order`` are columns whose values, with the group's, make rows unique (else equal rows are
    numbered as they come). With more than ``hot_limit`` rows the rows are laid out by ranges of group
    and order, numbered inside each range, and offset by the group's rows in the ranges before.
    ``total_rows`` may be an upper bound; without it the rows are counted.
    """
    keys = [c if not isinstance(c, str) else F.col(c) for c in order]
    n = df.count() if total_rows is None else total_rows
    if n <= hot_limit(n):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*keys)))
    laid = cut_lineage(df.repartitionByRange(*[F.col(g) for g in group], *keys).withColumn("__part", F.spark_partition_id()))
    sizes = laid.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "__part", before.alias("__before"))  # a row for each range a group lies in
    local = laid.withColumn("__at", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*keys)))
    on = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*group, "__part"]))
    met = local.alias("l").join(sizes.alias("s"), on).select("l.*", "s.__before")
    return met.withColumn(name, (F.col("__before") + F.col("__at")).cast("int")).drop("__part", "__at", "__before")
