"""Structured Streaming: micro-batch indexing, a snapshot with a time to live, and stream metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, readability


def index_stream(pages: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds", on_batch: Callable[[int, int, int], None] | None = None) -> StreamingQuery:
    """Extract and index a stream of ``url, html`` pages, committing at most every ``every`` (None: all there is, then stop).

    Each micro-batch is one commit under its own number, so a batch replayed after a failure
    overwrites itself. A page that cannot be read gives an error row, never a failed batch.
    """

    def batch(df: DataFrame, number: int) -> None:
        pages_ = df.filter("html <> ''").withColumn("__seq", F.monotonically_increasing_id())
        read = readability.extract(pages_).persist()
        try:
            good = index.latest_pages(read.filter("error IS NULL").select(F.col("final_url").alias("url"), "title", "content", "__seq"), "__seq").drop("__seq")
            index.write(good, f"{path}/batch={number}")
            if on_batch:
                n = read.agg(F.count_if(F.col("error").isNull()).alias("a"), F.count_if(F.col("error").isNotNull()).alias("b")).first()
                on_batch(number, n["a"], n["b"])
        finally:
            read.unpersist()

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest_documents(docs: DataFrame) -> DataFrame:
    """Across the batches of an index, the last commit of each url."""
    last = docs.groupBy("url").agg(F.max_by(F.struct("doc_id", "title", "batch"), "batch").alias("d"))
    return last.select("d.doc_id", "url", "d.title", "d.batch")


def snapshot(fetches: DataFrame, key: str, ts: str, ok: Column, as_of: Column, ttl_seconds: int = 3600) -> DataFrame:
    """What a cache with a time to live serves at ``as_of`` for each key.

    The last good fetch up to then, with ``state``: ``fresh`` if it is younger than the time to live,
    ``stale`` if not (served when a refetch fails), ``missing`` if there was none.
    """
    seen = fetches.filter(F.col(ts) <= as_of).groupBy(key).agg(F.max(F.when(ok, F.col(ts))).alias("fetched_at"))
    fresh = F.col("fetched_at") > as_of - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    return seen.withColumn("state", F.when(F.col("fetched_at").isNull(), "missing").when(fresh, "fresh").otherwise("stale"))


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per kind and window; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
