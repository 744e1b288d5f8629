"""Records that differ only in formatting: one record each, with the number of copies (problem 3).

Every field becomes a normalised ``name=value`` string (percent codes decoded, case folded,
whitespace and punctuation dropped). The fields of a record form a multiset, whose fingerprint is
the sum of the fields' hashes modulo a prime: the order of fields does not matter and nothing is
sorted. Records are grouped by fingerprint, and each is then compared field by field with the first
record of its group, so a hash collision can never merge two records: those that differ are grouped
anew by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..operators.skew import join_groups

_P1, _P2 = 2305843009213693951, 2305843009213693921  # the two largest primes below 2**61


def normal(text: Column) -> Column:
    """Letters, digits and marks only, percent codes decoded, lower case. Null stays null."""
    clean = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "")
    decoded = F.coalesce(F.try_url_decode(clean), clean)
    return F.lower(F.regexp_replace(decoded, r"[^\p{L}\p{N}\p{M}]+", ""))


def url_fields(url: Column) -> Column:
    """A url as a multiset of fields: host with path, each query parameter, the fragment.

    Scheme, a leading ``www.``, letter case, whitespace and punctuation (plain or percent-encoded)
    leave no trace; letters, digits, the order of path segments and which value belongs to which
    parameter do. Null for a null url; an empty or blank url has the one field ``/``.
    """
    url = F.regexp_replace(url, r"(?U)\s+", "")
    frag = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    body = F.regexp_replace(url, r"(?s)#.*$", "")
    query = F.regexp_extract(body, r"(?s)\?(.*)$", 1)
    base = F.regexp_replace(body, r"(?s)\?.*$", "")
    clean = F.regexp_replace(base, "%(?![0-9A-Fa-f]{2})", "")
    base = F.trim(F.coalesce(F.try_url_decode(clean), clean))
    base = F.regexp_replace(base, r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//+", "")
    base = F.lower(F.regexp_replace(F.regexp_replace(base, r"^(?i)www\.", ""), r"[^\p{L}\p{N}\p{M}]+", ""))
    pair = lambda p: F.concat(normal(F.regexp_extract(p, r"(?s)^([^=]*)", 1)), F.lit("="), normal(F.regexp_extract(p, r"(?s)=(.*)$", 1)))
    pairs = F.filter(F.transform(F.split(query, "&"), pair), lambda p: p != "=")
    mark = F.filter(F.array(F.concat(F.lit("#"), normal(frag))), lambda p: p != "#")
    return F.when(url.isNotNull(), F.concat(F.array(F.concat(F.lit("/"), base)), pairs, mark))


def record_fields(names: list[str]) -> Column:
    """The named columns of a record as a multiset of fields; a null column leaves no field."""
    each = [F.concat(normal(F.lit(n)), F.lit("="), normal(F.col(f"`{n}`").cast("string"))) for n in names]
    return F.filter(F.array(*each), lambda p: p.isNotNull())


def fingerprint(fields: Column) -> tuple[Column, Column]:
    """Two commutative hashes of a multiset of strings, 61 bits each."""
    return _sum(fields, _P1), _sum(fields, _P2, F.lit("second"))


def _sum(fields: Column, p: int, *seed: Column) -> Column:
    return F.aggregate(fields, F.lit(0).cast("bigint"), lambda a, x: (a + F.pmod(F.xxhash64(x, *seed), F.lit(p))) % F.lit(p))


def _same(a: Column, b: Column) -> Column:
    """Equality of two multisets without sorting: as sets, and in every multiplicity where a string repeats."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    sets = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return sets & ((F.size(F.array_distinct(a)) == F.size(a)) | F.forall(a, lambda x: times(a, x) == times(b, x)))


def collapse(df: DataFrame, id_col: str, fields: Column) -> DataFrame:
    """``first_id, id`` of every record that has a copy: the group's smallest id, and its own.

    Null fields (a null url) have no copies. Repeated rows of one id count once. An empty table
    gives an empty result; other columns of ``df`` are never read.
    """
    h1, h2 = fingerprint(F.col("fields"))
    keys = df.select(F.col(f"`{id_col}`").alias("id"), fields.alias("fields")).filter("fields IS NOT NULL and id IS NOT NULL")
    keys = keys.withColumns({"h1": h1, "h2": h2})
    # the first record of each fingerprint, found by a partial aggregation before the shuffle
    first = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min_by("fields", "id").alias("first_fields"))
    first = first.filter("n > 1")
    met = join_groups(keys, first, ["h1", "h2"], "n", df.count())
    same = _same(F.col("fields"), F.col("first_fields"))
    # two numbers a copy, read by both branches below
    met = cut(met.select("id", "first_id", F.when(~same, F.col("fields")).alias("fields")))
    good = met.filter("fields IS NULL").select("first_id", "id")
    # records whose fingerprint collides with another record's: the rest of a fingerprint goes by further hashes, until none is left
    rest, seed = met.filter("fields IS NOT NULL").select("id", "fields"), 0
    while not rest.isEmpty():
        seed += 1
        again = rest.withColumn("h", _sum(F.col("fields"), _P1, F.lit(f"again {seed}")))
        least = again.groupBy("h").agg(F.min("id").alias("first_id"), F.min_by("fields", "id").alias("first_fields"))
        again = cut(again.join(least, "h").select("id", "first_id", F.when(~same, F.col("fields")).alias("fields")))
        good = good.unionByName(again.filter("fields IS NULL").select("first_id", "id"))
        rest = again.filter("fields IS NOT NULL").select("id", "fields")
    return good


def copies(df: DataFrame, id_col: str, fields: Column) -> DataFrame:
    """``first_id, copy_id``: a row for each record that copies one with a smaller id."""
    return collapse(df, id_col, fields).filter("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def copy_counts(df: DataFrame, id_col: str, fields: Column) -> DataFrame:
    """``first_id, n_copies``: one row for each distinct record, with its number of records."""
    pairs = copies(df, id_col, fields)
    counted = pairs.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    ids = df.select(F.col(f"`{id_col}`").alias("first_id")).filter("first_id IS NOT NULL").distinct()
    alone = ids.join(pairs.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return alone.join(counted, "first_id", "left").select("first_id", F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))
