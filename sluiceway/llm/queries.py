"""Queries of the llm problems, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import dedup, languages, leaks, mixing, quality, ranking, repeats, review


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_data")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "element_frame")


def _review(spark: SparkSession, sf_dir: str) -> review.Review:
    return review.Review(_pages(spark, sf_dir), _frames(spark, sf_dir))


# ------------------------------------------------------------------ 1: text statistics


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir).list_pages()


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of every page, boilerplate included."""
    return quality.ratios(quality.counts(_pages(spark, sf_dir), "page_id", F.col("content"))).distinct()


# ------------------------------------------------------------------ 2: keyword pages


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir).keyword_pages()


# ------------------------------------------------------------------ 3: copies under other formatting


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copies(table(spark, sf_dir, "search_result"), "result_id", dedup.url_fields(F.col("url")))


def p3_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct page with its number of results."""
    return dedup.copy_counts(table(spark, sf_dir, "search_result"), "result_id", dedup.url_fields(F.col("url")))


# ------------------------------------------------------------------ 4: one ranking


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse_rankings(table(spark, sf_dir, "source_score"), table(spark, sf_dir, "search_source"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.agreed_best(_ranking(spark, sf_dir)).select("query_id", "result_id").distinct()


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of every query."""
    return _ranking(spark, sf_dir).select("query_id", "result_id", (F.round("projection", 5) + 0.0).alias("projection"), "position", "n_sources", "n_best")


# ------------------------------------------------------------------ 5: boilerplate


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _review(spark, sf_dir).boilerplate_lines()


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of all pages, junk pages included."""
    return _review(spark, sf_dir).lines()


# ------------------------------------------------------------------ 6: template residue


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.Review(_pages(spark, sf_dir)).residue()


def p6_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue pages by what gave them away (bits: slot, template, filler, form, words)."""
    return review.Review(_pages(spark, sf_dir)).residue_origins().groupBy("origin").agg(F.count(F.lit(1)).alias("n_pages"))


# ------------------------------------------------------------------ 7: repeated lines


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_lines(_pages(spark, sf_dir))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of frequent sequences of each length over all sites, the sites that have them, and the most urls of one."""
    found = repeats.frequent_sequences(_pages(spark, sf_dir))
    return found.groupBy("length").agg(F.count(F.lit(1)).alias("n_patterns"), F.countDistinct("site").alias("n_sites"), F.max("n_urls").alias("most_urls")).withColumn("length", F.col("length").cast("bigint"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its repeated lines."""
    pages = _pages(spark, sf_dir)
    return repeats.without_lines(pages, repeats.repeated_lines(pages))


# ------------------------------------------------------------------ 8: leaked evaluation texts


def _leaks(spark: SparkSession, sf_dir: str, own_only: bool = False) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), own_only=own_only)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir, own_only=True).filter("own").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks, those with edits and those in words that items share included, with their longest runs."""
    return _leaks(spark, sf_dir)


# ------------------------------------------------------------------ 9: mixing sources


#: Tokens of a mix, as a share of those of the listed sources' documents.
MIX_SIZE = 0.5


def _mix(spark: SparkSession, sf_dir: str, on_target: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Drawn documents, counts, targets and exponent: of a mix of ``MIX_SIZE`` of its sources' tokens, or of the largest that meets every target."""
    counts = cut(mixing.token_counts(table(spark, sf_dir, "documents")))
    targets = table(spark, sf_dir, "mix_target")
    drawn, plan = mixing.draw(counts, targets, None if on_target else MIX_SIZE * mixing.listed_tokens(counts, targets))
    return drawn, counts, targets, plan["exponent"]


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, and how often, for a mix half as large as its sources: the exponent is bisected to the repetition limits."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of that mix."""
    return mixing.report(*_mix(spark, sf_dir))


def p9_target_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, and how often, for the largest mix in which every source has its target share."""
    return _mix(spark, sf_dir, True)[0]


def p9_target_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and reached shares of that mix."""
    return mixing.report(*_mix(spark, sf_dir, True))


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the sources by temperature, at the entropy of the wanted shares."""
    sizes = mixing.source_sizes(mixing.token_counts(table(spark, sf_dir, "documents")))
    targets = table(spark, sf_dir, "mix_target").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("n_tokens"))
    weights = mixing.temperature_weights(sizes, mixing.entropy([x or 0.0 for x in mixing.source_sizes(targets).values()]))
    return spark.createDataFrame([(s, round(w, 6), sizes[s]) for s, w in sorted(weights.items())], "source string, weight double, n_tokens bigint")


# ------------------------------------------------------------------ 10: languages


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, languages.Model]:
    docs = table(spark, sf_dir, "documents")
    return docs, languages.fit_on(docs, "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _languages(spark, sf_dir)
    return languages.unnamed_languages(docs, "doc_id", "text", "lang", model)


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    docs, model = _languages(spark, sf_dir)
    return languages.segments(docs, "doc_id", "text", model)


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of each document with its share and confidence."""
    return languages.document_languages(p10_segments(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_statistics, p2_found, p3_found, p3_copies, p4_found, p4_ranking, p5_found, p5_lines, p6_found, p6_origins, p7_found, p7_sequences, p7_cleaned, p8_found, p8_leaks, p9_draws, p9_shares, p9_target_draws, p9_target_shares, p9_temperature, p10_found, p10_segments, p10_documents,
)}

_P7 = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, content,
    regexp_replace(regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '^www\.', '') AS site
  FROM page_data WHERE url IS NOT NULL AND content IS NOT NULL),
l AS (SELECT page_id, url, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM p WHERE site <> ''),
k AS (SELECT page_id, url, site, line_no, regexp_replace(regexp_replace(regexp_replace(' ' || lower(line) || ' ', '[^\p{L}]+', '  ', 'g'),
  ' (january|february|march|april|may|june|july|august|september|october|november|december) ', ' ', 'g'), ' ', '', 'g') AS key FROM l),
f AS (SELECT site, key FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 5)
"""

_P3 = r"""
WITH u AS (SELECT result_id, regexp_replace(url, '\s+', '', 'g') AS u FROM search_result WHERE url IS NOT NULL),
parts AS (
  SELECT result_id,
    regexp_extract(u, '#(.*)$', 1, 's') AS frag,
    regexp_replace(u, '#.*$', '', 's') AS body
  FROM u),
split AS (
  SELECT result_id, frag, regexp_extract(body, '\?(.*)$', 1, 's') AS query,
    regexp_replace(regexp_replace(trim(url_decode(regexp_replace(body, '\?.*$', '', 's'))), '^([a-z][a-z0-9+.-]*:)?//+', '', 'i'), '^www\.', '', 'i') AS base
  FROM parts),
canon AS (
  SELECT result_id,
    lower(regexp_replace(base, '[^\p{L}\p{N}\p{M}]+', '', 'g')) AS base,
    lower(regexp_replace(url_decode(frag), '[^\p{L}\p{N}\p{M}]+', '', 'g')) AS frag,
    list_sort(list_filter(list_transform(string_split(query, '&'), lambda p:
      lower(regexp_replace(url_decode(split_part(p, '=', 1)), '[^\p{L}\p{N}\p{M}]+', '', 'g')) || '=' ||
      lower(regexp_replace(url_decode(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END), '[^\p{L}\p{N}\p{M}]+', '', 'g'))),
      lambda p: p <> '=')) AS pairs
  FROM split),
g AS (SELECT result_id, min(result_id) OVER (PARTITION BY base, frag, pairs) AS first_id FROM canon)
"""

_P4 = """
WITH last AS (
  SELECT query_id, result_id, source, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, result_id, source ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS rn FROM source_score
    WHERE result_id IS NOT NULL AND source IS NOT NULL)
  WHERE rn = 1 AND score IS NOT NULL),
s AS (SELECT l.*, CASE WHEN lower(x.better) = 'low' THEN -score ELSE score END AS good FROM last l LEFT JOIN search_source x USING (source)),
b AS (SELECT query_id, source, max(good) AS top FROM s GROUP BY 1, 2),
t AS (SELECT query_id, source, any_value(result_id) AS result_id FROM s JOIN b USING (query_id, source) WHERE good = top GROUP BY 1, 2 HAVING count(*) = 1),
n AS (SELECT query_id, count(DISTINCT source) AS n FROM s GROUP BY 1)
SELECT query_id, result_id FROM t JOIN n USING (query_id) WHERE n >= 3 GROUP BY query_id, result_id, n HAVING count(*) >= n - 1
"""

_P4_RANKING = """
WITH RECURSIVE last AS (
  SELECT query_id, result_id, source, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, result_id, source ORDER BY scored_at DESC NULLS LAST, score DESC NULLS LAST) AS rn FROM source_score
    WHERE result_id IS NOT NULL AND source IS NOT NULL)
  WHERE rn = 1 AND score IS NOT NULL),
s AS (SELECT l.*, CASE WHEN lower(x.better) = 'low' THEN -score ELSE score END AS good FROM last l LEFT JOIN search_source x USING (source)),
g AS (SELECT *, rank() OVER w AS less, count(*) OVER (PARTITION BY query_id, source, good) AS same, count(*) OVER (PARTITION BY query_id, source) AS n_all FROM s WINDOW w AS (PARTITION BY query_id, source ORDER BY good)),
r AS (SELECT query_id, result_id, source, (less - 1 + (same + 1) / 2.0) / (n_all + 1) AS r, less = n_all AND same = 1 AS best FROM g),
names AS (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM r)),
x AS (SELECT r.*, i FROM r JOIN names USING (source)),
one AS (SELECT i, avg(r) AS mean, stddev_pop(r) AS sd FROM x GROUP BY i),
pair AS (SELECT a.i, b.i AS j, count(*) AS n, corr(a.r, b.r) AS c FROM x a JOIN x b ON a.query_id = b.query_id AND a.result_id = b.result_id GROUP BY 1, 2),
cell AS (SELECT p.i, q.i AS j, CASE WHEN p.i = q.i THEN 1 WHEN pair.n > 2 AND NOT isnan(c) THEN c ELSE 0 END AS c FROM names p CROSS JOIN names q LEFT JOIN pair ON pair.i = p.i AND pair.j = q.i),
m AS (SELECT list(c ORDER BY i) AS m FROM (SELECT i, list(c + CASE WHEN i = j THEN 10 ELSE 0 END ORDER BY j) AS c FROM cell GROUP BY i)),
power AS (
  SELECT 0 AS step, list_transform(m, lambda z: 1.0::DOUBLE) AS v FROM m
  UNION ALL
  SELECT step + 1, list_transform(list_transform(m, lambda z: list_dot_product(z, v)), lambda z: z / sqrt(list_sum(list_transform(m, lambda y: list_dot_product(y, v) ** 2)))) FROM power, m WHERE step < 400),
w AS (SELECT names.i, abs(v[names.i]) / sd AS w, mean FROM names JOIN one USING (i), power WHERE step = 400),
p AS (SELECT query_id, result_id, round(sum(w * (r - mean)), 9) AS projection, count(*) AS n_sources, sum(best::INT)::BIGINT AS n_best FROM x JOIN w USING (i) GROUP BY 1, 2)
SELECT query_id, result_id, round(projection, 5) + 0.0 AS projection, row_number() OVER (PARTITION BY query_id ORDER BY projection DESC, result_id) AS position, n_sources, n_best FROM p
"""

ORACLE = {
    "p3_found": _P3 + "SELECT first_id, result_id AS copy_id FROM g WHERE result_id <> first_id",
    "p3_copies": _P3 + "SELECT first_id, count(*) AS n_copies FROM g GROUP BY 1 UNION ALL SELECT result_id, 1 FROM search_result WHERE url IS NULL",
    "p4_found": _P4,
    "p4_ranking": _P4_RANKING,
    "p7_found": _P7 + "SELECT DISTINCT page_id, line_no FROM k JOIN f USING (site, key)",
    "p8_found": r"""
WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT item_id, text FROM eval_item)),
g AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM w WHERE len(w) >= 10),
u AS (SELECT g, min(item_id) AS item_id FROM g GROUP BY g HAVING count(DISTINCT item_id) = 1),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 8, 1)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM d WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM h JOIN u USING (g)""",
    "p7_sequences": _P7
    + """, o AS (SELECT page_id, url, site, list(key ORDER BY line_no) AS keys FROM k JOIN f USING (site, key) GROUP BY 1, 2, 3),
i AS (SELECT *, unnest(range(1, len(keys) + 1)) AS a FROM o),
r AS (SELECT url, site, a, unnest(range(a, len(keys) + 1)) AS b, keys FROM i),
s AS (SELECT site, b - a + 1 AS length, array_to_string(keys[a:b], '|') AS pattern, count(DISTINCT url) AS n FROM r GROUP BY ALL HAVING count(DISTINCT url) >= 5)
SELECT length, count(*) AS n_patterns, count(DISTINCT site) AS n_sites, max(n) AS most_urls FROM s GROUP BY length""",
    "p7_cleaned": _P7
    + """, g AS (SELECT DISTINCT page_id, line_no FROM k JOIN f USING (site, key)),
a AS (SELECT page_id, list(line_no) AS gone FROM g GROUP BY 1),
d AS (SELECT DISTINCT page_id, content FROM page_data)
SELECT d.page_id, coalesce(len(a.gone), 0) AS n_removed,
  array_to_string(list_filter(string_split(d.content, chr(10)), lambda x, i: NOT coalesce(list_contains(a.gone, i), false)), chr(10)) AS content
FROM d LEFT JOIN a USING (page_id)""",
}
