"""One ranking out of scores on different scales (problem 4).

Every source's scores are replaced by their ranks within the query, turned so that high is good, so that
no scale dominates. The correlation matrix of the sources is summed block by block (one row an item,
no pairs leave a partition), its first principal component gives each source's weight, loading signs
are oriented to the declared directions, and items are ordered by their projection on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import grouped_rank, join_groups, row_numbers
from ..session import cut, ship

#: Sources are rows of the correlation matrix, which the driver holds; more than this is refused.
MOST_SOURCES = 200
#: What rounding may take from a projection.
SLACK = 1e-6


def latest_scores(scores: DataFrame) -> DataFrame:
    """``query_id, result_id, source, score``: the latest score of each result and source, if not null.

    Of several at the latest time the largest non-null one holds. Rows without result or source are no scores.
    """
    rows = scores.filter("result_id IS NOT NULL AND source IS NOT NULL").select("query_id", "result_id", "source", "scored_at", F.col("score").cast("double").alias("score"))
    last = rows.groupBy("query_id", "result_id", "source").agg(F.max(F.struct("scored_at", "score")).alias("m"))
    return last.select("query_id", "result_id", "source", F.col("m.score").alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")


def rank_scores(scores: DataFrame, total_rows: int) -> DataFrame:
    """``query_id, result_id, source, r, best, n_all``: the mid-rank in (0, 1), high is good; whether it is strictly the best; scores of the query and source.

    ``scores`` have ``good``: the score, turned so that high is good.
    """
    group = ["query_id", "source"]
    ranks = grouped_rank(scores, group, "good", total_rows)
    met = join_groups(scores, ranks, [*group, "good"], "n_equal", total_rows)
    r = (F.col("n_less") + (F.col("n_equal") + 1) / 2) / (F.col("n_all") + 1)
    return met.select("query_id", "result_id", "source", r.alias("r"), ((F.col("n_less") + 1 == F.col("n_all")) & (F.col("n_equal") == 1)).alias("best"), "n_all")


def moments(items: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlation matrix, means, standard deviations) of ``k`` sources over items that have ``at, r`` (sources' numbers and ranks).

    Each partition sums one k x k block of counts and products over pairwise complete items; the
    blocks are added by place, and k * k rows come to the driver.
    """
    ship(items.sparkSession)

    def block(batches):
        n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            r = np.zeros((len(sizes), k))
            has = np.zeros((len(sizes), k))
            rows, cols = np.repeat(np.arange(len(sizes)), sizes), batch.column(0).flatten().to_numpy(zero_copy_only=False)
            r[rows, cols], has[rows, cols] = batch.column(1).flatten().to_numpy(zero_copy_only=False), 1
            n += has.T @ has
            x += r.T @ has
            xx += (r * r).T @ has
            xy += r.T @ r
        i, j = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, n, x, xx, xy)], ["i", "j", "n", "x", "xx", "xy"])

    sums = items.select("at", "r").mapInArrow(block, "i bigint, j bigint, n double, x double, xx double, xy double")
    n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
    for g in sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]).collect():  # at most MOST_SOURCES ** 2 rows
        i, j = g["i"], g["j"]
        n[i, j], x[i, j], xx[i, j], xy[i, j] = g["n"], g["x"], g["xx"], g["xy"]
    with np.errstate(all="ignore"):
        mean = x / n
        var = xx / n - mean**2
        m = (xy / n - mean * mean.T) / np.sqrt(var * var.T)
    m = np.where((n > 2) & (var > 1e-12) & (var.T > 1e-12), m, 0.0)
    np.fill_diagonal(m, 1.0)
    return m, np.nan_to_num(np.diag(mean)), np.sqrt(np.maximum(np.nan_to_num(np.diag(var)), 0))


def component(m: np.ndarray) -> np.ndarray:
    """Loadings of the first principal component of a correlation matrix of ranks that are turned to their declared directions.

    A loading's sign says whether its source agrees with the others; the declared direction holds, so
    signs are set to it, and the sizes stay as they are.
    """
    return np.abs(np.linalg.eigh(m)[1][:, -1])


def fuse_rankings(scores: DataFrame, sources: DataFrame) -> DataFrame:
    """One ranking per query of all items that any source scored.

    Returns ``query_id, result_id, projection, position, n_sources, n_best, query_sources, floor``:
    ``n_best`` counts the sources that give the item the strictly best score of its query,
    ``query_sources`` the sources with scores in the query; ``floor`` is the projection that no item falls
    below which all sources of the query, or all but one, put strictly first. A source without a
    declared direction counts as ``high``. A source that an item misses counts as its mean. Ties in
    the projection go to the smaller ``result_id``. No scores at all give an empty result.
    """
    total = scores.count()
    last = latest_scores(scores)
    low = sources.filter("lower(better) = 'low'").select("source").distinct().withColumn("low", F.lit(True))
    turned = last.join(low, "source", "left").select("query_id", "result_id", "source", F.when(F.col("low"), -F.col("score")).otherwise(F.col("score")).alias("good"))
    ranked = cut(rank_scores(turned, total))  # a few numbers a score; each step below reads it again
    names = [r[0] for r in ranked.select("source").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names.sort()
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)]) if names else F.lit(None).cast("map<string,int>")
    items = ranked.groupBy("query_id", "result_id").agg(
        F.collect_list(F.struct(F.try_element_at(number, F.col("source")).alias("at"), "r")).alias("s"), F.count(F.lit(1)).alias("n_sources"), F.sum(F.col("best").cast("int")).cast("bigint").alias("n_best")
    ).select("query_id", "result_id", F.col("s.at").alias("at"), F.col("s.r").alias("r"), "n_sources", "n_best")
    items = cut(items)  # at most MOST_SOURCES numbers an item
    m, mean, sd = moments(items, max(len(names), 1))
    weight = component(m) * (sd > 1e-9)
    scale = [w / s if s > 1e-9 else 0.0 for w, s in zip(weight.tolist(), sd.tolist(), strict=True)]
    a, b = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (scale, (np.array(scale) * mean).tolist()))
    # in the order of the sources, so that equal items get equal sums
    terms = F.transform(F.array_sort(F.arrays_zip("at", "r")), lambda x: x["r"] * F.get(a, x["at"]) - F.get(b, x["at"]))
    items = items.select("query_id", "result_id", F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 9).alias("projection"), "n_sources", "n_best")
    place = F.try_element_at(number, F.col("source"))
    of = lambda r: r * F.get(a, place) - F.get(b, place)
    top, least = of(F.col("n_all") / (F.col("n_all") + 1)), F.least(of(1 / (F.col("n_all") + 1)), F.lit(0.0))
    per = ranked.groupBy("query_id", "source").agg(F.max("n_all").alias("n_all"))
    per = per.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_sources"), F.sum("n_all").alias("n"), (F.sum(top) - F.max(top - least) - SLACK).alias("floor"))
    met = join_groups(items, per, ["query_id"], "n", total).drop("n").withColumn("p", -F.col("projection"))
    return row_numbers(met, ["query_id"], ["p", "result_id"], "position", total).withColumn("position", F.col("position").cast("bigint")).drop("p")


def agreed_best(ranking: DataFrame, least_sources: int = 3) -> DataFrame:
    """Items of ``fuse_rankings`` that all sources of their query, or all but one, put strictly first.

    Candidates come from the projection: an item strictly first in all sources but one has at least the
    sum of the sources' top contributions less the largest that one source can withhold (``floor``).
    The ranks then settle each candidate exactly.
    """
    candidates = ranking.filter((F.col("query_sources") >= least_sources) & (F.col("projection") >= F.col("floor")))
    return candidates.filter(F.col("n_best") >= F.col("query_sources") - 1)
