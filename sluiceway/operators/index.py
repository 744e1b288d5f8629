"""The inverted index: documents and postings as Parquet tables, upserted by url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

FIELDS = ("url", "title", "body")


def latest_pages(pages: DataFrame, sequence: str) -> DataFrame:
    """The last written row of each url."""
    w = Window.partitionBy("url").orderBy(F.col(sequence).desc())
    return pages.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows whose url is not among the new ones, and the new ones."""
    return existing.join(new.select("url").distinct(), "url", "left_anti").unionByName(new.select(*existing.columns))


def documents(pages: DataFrame) -> DataFrame:
    """``doc_id, url, title`` with a stable id from the url; the body is indexed, not stored."""
    return pages.select(F.xxhash64("url").alias("doc_id"), "url", "title")


def postings(pages: DataFrame, stemmed: bool = True, positions: bool = True) -> DataFrame:
    """``field, term, doc_id, tf, positions``: urls and titles in plain tokens, bodies in stems with positions.

    A page's terms are grouped inside its own row, so the only shuffle an index needs is the one that
    lays the postings out by term.
    """
    body = text.stems(text.tokens(F.col("content"))) if stemmed else text.tokens(F.col("content"))
    each = pages.select(F.xxhash64("url").alias("doc_id"), text.index_tokens(F.col("url")).alias("url"), text.index_tokens(F.col("title")).alias("title"), body.alias("body"))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("terms")) for f in FIELDS])
    flat = each.select("doc_id", F.explode(fields).alias("x")).select("doc_id", "x.field", F.posexplode("x.terms").alias("pos", "term"))
    out = flat.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return out if positions else out.drop("positions")


def write(pages: DataFrame, path: str, mode: str = "overwrite", parts: int | None = None) -> None:
    """Write documents and postings; postings are laid out by ranges of term and document within each field, so that a frequent term spreads over several files."""
    documents(pages).write.mode(mode).parquet(f"{path}/docs")
    p = postings(pages)
    p = p.repartitionByRange(parts, "term", "doc_id") if parts else p.repartitionByRange("term", "doc_id")
    p.sortWithinPartitions("term", "doc_id").write.mode(mode).partitionBy("field").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of an index; an error names what its schema lacks."""
    docs, post = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    lacking = [c for c in ("doc_id", "url", "title") if c not in docs.columns] + [c for c in ("field", "term", "doc_id", "tf") if c not in post.columns]
    if lacking:
        raise ValueError(f"not an index: it lacks {', '.join(lacking)}")
    return docs, post


def doc_count(docs: DataFrame) -> int:
    return docs.count()


def bm25(post: DataFrame, docs: DataFrame, words: list[str], field: str = "body", k1: float = 1.2, b: float = 0.75, top: int = 10) -> DataFrame:
    """Best documents for stemmed query words (an extension: the index alone is never queried by the pages above)."""
    rows = post.filter((F.col("field") == field) & F.col("term").isin(words))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    size = post.filter(F.col("field") == field).groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    mean = size.agg(F.avg("dl").alias("adl"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = rows.join(F.broadcast(df), "term").join(size, "doc_id").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(mean))  # single rows
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("adl")))
    return x.groupBy("doc_id").agg(F.round(F.sum(s), 6).alias("score")).join(docs, "doc_id").orderBy(F.desc("score"), "url").limit(top)
