"""Queries over result urls and result lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import lists, search
from ..session import spread, table

FEED_QUERY = "the old Council bridge the"
AS_OF = "2024-01-05 00:00:00"


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_result")


def _found(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).filter("url IS NOT NULL")


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("result_id", urls.url_host(F.col("url")).alias("host"))


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("result_id", urls.dedup_key(F.col("url")).alias("dedup_key"))


def netlocs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_data").select("page_id", urls.netloc(F.col("url")).alias("netloc")).distinct()


def pattern_hosts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _found(spark, d).select("result_id", urls.pattern_host(u).alias("host"), urls.pattern_host(u, False).alias("host_to_slash"), urls.absolute(u).alias("is_absolute"))


def field_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("result_id", urls.field_host(F.trim("url")).alias("host"))


def text_urls(spark: SparkSession, d: str) -> DataFrame:
    """Distinct scheme-and-host of urls in running text (a result's description with its url in brackets)."""
    body = F.concat(F.coalesce("description", F.lit("")), F.lit(" ("), F.lower("url"), F.lit(") and "), F.lower("url"))
    return _found(spark, d).select(F.explode(urls.text_urls(body)).alias("url")).distinct()


def request_urls(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_text")
    return _results(spark, d).filter(search.answerable(q)).select("query_text").distinct().select("query_text", urls.request_url(F.lit("wiby"), q).alias("request"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _block(spark: SparkSession, d: str) -> DataFrame:
    """A block list out of the data: parent domains of every fourth-length page host."""
    host = urls.url_host(F.col("url"))
    pages = table(spark, d, "page_data").select(host.alias("value")).filter(F.length("value") % 4 == 0)
    return lists.blocklist(pages.select(F.regexp_replace("value", r"^(blog|forum)\.", "").alias("value")))


def blocked_pages(spark: SparkSession, d: str) -> DataFrame:
    return lists.blocked(table(spark, d, "page_data").select("page_id", "url").distinct(), "url", _block(spark, d))


def unblocked_pages(spark: SparkSession, d: str) -> DataFrame:
    return lists.without_blocked(table(spark, d, "page_data").select("page_id", "url").distinct(), "url", _block(spark, d))


def allowed_domains(spark: SparkSession, d: str) -> DataFrame:
    return lists.allowed(table(spark, d, "page_data").select(urls.url_host(F.col("url")).alias("domain")), _block(spark, d))


def union_domains(spark: SparkSession, d: str) -> DataFrame:
    each = [table(spark, d, t).select(urls.url_host(F.col("url")).alias("domain")) for t in ("page_data", "search_result", "documents")]
    return lists.union_domains(*each)


def seed_urls(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "page_data").select(F.when(F.col("page_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), urls.url_host(F.col("url")))).alias("value"))
    return lists.seeds(lines).distinct()


def _relevant(df: DataFrame) -> DataFrame:
    return df.filter(search.relevant(F.col("query_text"), F.col("title"), F.col("description"), F.col("url")))


def relevant_results(spark: SparkSession, d: str) -> DataFrame:
    return _relevant(_results(spark, d)).select("result_id")


def top_per_source(spark: SparkSession, d: str) -> DataFrame:
    return search.top_per_source(_results(spark, d), ["query_id", "source"], ["rank", "result_id"]).select("query_id", "source", "result_id", F.col("place").cast("bigint").alias("place"))


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d)
    out = search.interleave(_relevant(rows), "query_id", "source", ["rank", "result_id"], total_rows=rows.count())
    return out.select("query_id", "result_id", "tier", F.col("position").cast("bigint").alias("position"), "side")


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).withColumn("source_idx", F.col("source"))
    out = search.fuse(rows, ["query_id"])
    return out.select("query_id", "dedup_key", F.round("mean_rank", 6).alias("mean_rank"), "n_ranks", "url", F.array_join("sources", ",").alias("sources"))


def rank_fusion_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Fusion with adjusted ranks, without the keys of a first batch of sources."""
    rows = _results(spark, d).withColumn("source_idx", F.col("source"))
    seen = rows.filter("source = 'wibbly' AND url IS NOT NULL").select(urls.dedup_key(F.col("url")).alias("dedup_key"))
    out = search.fuse(rows, ["query_id"], seen=seen, adjust=lambda r: r * 2 + 1)
    return out.select("query_id", "dedup_key", F.round("mean_rank", 6).alias("mean_rank"), "n_ranks")


def feed_search(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "title", "text"))
    return search.feed_search(docs, F.lit(FEED_QUERY), "title", "text").select("doc_id", F.col("score").cast("bigint").alias("score"))


def fused_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of every fused page within its query."""
    rows = _results(spark, d).withColumn("source_idx", F.col("source"))
    return search.in_order(search.fuse(rows, ["query_id"]), ["query_id"]).select("query_id", "dedup_key", F.col("position").cast("bigint").alias("position"))


def feed_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold words of the query, most words first."""
    docs = spread(table(spark, d, "documents").select("doc_id", "title", "text"))
    found = search.feed_search(docs, F.lit(FEED_QUERY), "title", "text").select("doc_id", "score")
    return search.best_first(found, "doc_id").select("doc_id", F.col("position").cast("bigint").alias("position"))


def recent_results(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.to_timestamp(F.lit(AS_OF))
    return search.recent(_results(spark, d).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), "fetched_at", as_of, 1).select("result_id")


def zip_shortest(spark: SparkSession, d: str) -> DataFrame:
    z = search.zip_shortest(F.split("title", " "), F.split("description", " "), F.col("sources"))
    flat = _results(spark, d).filter("sources IS NOT NULL").select("result_id", F.posexplode(z).alias("pos", "z"))
    return flat.select("result_id", "pos", *[F.col("z").getField(str(i)).alias(n) for i, n in enumerate(("title_word", "description_word", "source"))])


def rendered(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    extra = F.when(F.col("rank") % 2 == 1, "result-left").otherwise("")
    card = search.render(text.or_empty(F.col("title")), text.or_empty(F.col("url")), text.or_empty(F.col("description")), F.coalesce("sources", F.array().cast("array<string>")), text.http_only(F.col("image")), extra)
    return r.select("result_id", card.alias("card"))


def squeezed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_data").filter("content IS NOT NULL").select("page_id", F.md5(text.squeeze(F.col("content"))).alias("digest"), F.length(text.strip(F.col("content"))).cast("bigint").alias("n_chars")).distinct()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Results of every query: relevant, from no blocked domain, in the order in which they are shown."""
    rows = lists.without_blocked(_relevant(_results(spark, d)), "url", _block(spark, d))
    out = search.interleave(rows, "query_id", "source", ["rank", "result_id"], total_rows=_results(spark, d).count())
    return out.select("query_id", F.col("position").cast("bigint").alias("position"), "side", "source", "result_id", "title", "url")


QUERIES = {
    "q_" + f.__name__: f
    for f in (
        url_hosts, dedup_keys, netlocs, pattern_hosts, field_hosts, text_urls, request_urls, source_counts, blocked_pages, unblocked_pages, allowed_domains, union_domains, seed_urls, relevant_results,
        top_per_source, interleaved, rank_fusion, rank_fusion_adjusted, fused_order, feed_search, feed_order, recent_results, zip_shortest, rendered, squeezed,
    )
} | {"q_search": flagship}

_HOST = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^(?s:.*?)://', ''), '(?s)[/?].*\z', ''), ':[0-9]*\z', ''), '^www\.', ''))"
_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace(replace(url, 'old.reddit.com', 'www.reddit.com'), '^https?://', ''), '^www\.', ''), '/+\z', ''))"
_BLOCK = rf"b AS (SELECT DISTINCT regexp_replace(h, '^(blog|forum)\.', '') AS domain FROM (SELECT {_HOST} AS h FROM page_data) WHERE length(h) % 4 = 0)"
_IS_BLOCKED = "EXISTS (SELECT 1 FROM b WHERE host = b.domain OR ends_with(host, '.' || b.domain))"
_REL = r"""rel AS (SELECT * FROM search_result WHERE
  len(list_filter(string_split_regex(lower(query_text), '\s+'), lambda w: w <> '')) = 0 OR
  len(list_filter(string_split_regex(lower(query_text), '\s+'), lambda w: w <> '' AND contains(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || coalesce(url, '')), w))) > 0)"""
_INTER = """placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, result_id) AS place FROM {rows}),
tiered AS (SELECT *, CASE WHEN place <= 4 THEN 0 ELSE 1 END AS tier FROM placed),
shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, source, place) AS position FROM tiered)"""
_FUSE = f"""k AS (SELECT *, {_KEY} AS dedup_key FROM search_result WHERE url IS NOT NULL)"""
_E = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_E_ = _E.format

ORACLE = {
    "q_url_hosts": f"SELECT result_id, {_HOST} AS host FROM search_result WHERE url IS NOT NULL",
    "q_dedup_keys": f"SELECT result_id, {_KEY} AS dedup_key FROM search_result WHERE url IS NOT NULL",
    "q_netlocs": "SELECT DISTINCT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc FROM page_data",
    "q_pattern_hosts": "SELECT result_id, regexp_extract(url, '^https?://([^/?]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)', 1) AS host_to_slash, regexp_matches(url, '^https?://') AS is_absolute FROM search_result WHERE url IS NOT NULL",
    "q_field_hosts": "SELECT result_id, CASE WHEN split_part(trim(url), '/', 1) IN ('http:', 'https:') THEN split_part(trim(url), '/', 3) ELSE split_part(trim(url), '/', 1) END AS host FROM search_result WHERE url IS NOT NULL",
    "q_text_urls": "SELECT DISTINCT unnest(regexp_extract_all(coalesce(description, '') || ' (' || lower(url) || ') and ' || lower(url), 'https?://[^/ )]+')) AS url FROM search_result WHERE url IS NOT NULL",
    "q_request_urls": "SELECT DISTINCT query_text, 'https://wiby.me/json/?q=' || url_encode(query_text) AS request FROM search_result WHERE query_text <> ''",
    "q_source_counts": "SELECT source, count(*) AS n FROM search_result GROUP BY source",
    "q_blocked_pages": f"WITH {_BLOCK}, p AS (SELECT DISTINCT page_id, url, {_HOST} AS host FROM page_data) SELECT page_id, url FROM p WHERE {_IS_BLOCKED}",
    "q_unblocked_pages": f"WITH {_BLOCK}, p AS (SELECT DISTINCT page_id, url, {_HOST} AS host FROM page_data) SELECT page_id, url FROM p WHERE host IS NULL OR NOT {_IS_BLOCKED}",
    "q_allowed_domains": f"WITH {_BLOCK}, p AS (SELECT DISTINCT {_HOST} AS host FROM page_data) SELECT host AS domain FROM p WHERE host IS NULL OR NOT {_IS_BLOCKED}",
    "q_union_domains": f"SELECT domain FROM (SELECT {_HOST} AS domain FROM page_data UNION SELECT {_HOST} FROM search_result UNION SELECT {_HOST} FROM documents) WHERE domain <> ''",
    "q_seed_urls": f"SELECT DISTINCT 'https://' || {_HOST} AS url FROM page_data WHERE page_id % 10 <> 0",
    "q_relevant_results": f"WITH {_REL} SELECT result_id FROM rel",
    "q_top_per_source": "SELECT query_id, source, result_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, result_id) AS place FROM search_result) WHERE place <= 4",
    "q_interleaved": f"WITH {_REL}, {_INTER.format(rows='rel')} SELECT query_id, result_id, tier, position, CASE WHEN position % 2 = 1 THEN 'left' ELSE 'right' END AS side FROM shown",
    "q_rank_fusion": f"WITH {_FUSE} SELECT query_id, dedup_key, round(avg(rank), 6) AS mean_rank, count(*) AS n_ranks, arg_min(url, (source, rank, url)) AS url, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY 1, 2",
    "q_rank_fusion_adjusted": f"WITH {_FUSE}, seen AS (SELECT dedup_key FROM k WHERE source = 'wibbly') SELECT query_id, dedup_key, round(avg(rank * 2.0 + 1), 6) AS mean_rank, count(*) AS n_ranks FROM k WHERE dedup_key NOT IN (SELECT dedup_key FROM seen) GROUP BY 1, 2",
    "q_feed_search": rf"""WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, len(list_filter(string_split(lower('{FEED_QUERY}'), ' '), lambda q: list_contains(w, q))) AS score FROM t) SELECT doc_id, score FROM s WHERE score > 0""",
    "q_fused_order": f"WITH {_FUSE} SELECT query_id, dedup_key, row_number() OVER (PARTITION BY query_id ORDER BY avg(rank), dedup_key) AS position FROM k GROUP BY 1, 2",
    "q_feed_order": rf"""WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, len(list_filter(string_split(lower('{FEED_QUERY}'), ' '), lambda q: list_contains(w, q))) AS score FROM t) SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM s WHERE score > 0""",
    "q_recent_results": f"SELECT result_id FROM search_result WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY",
    "q_zip_shortest": """WITH a AS (SELECT result_id, string_split(title, ' ') AS t, string_split(description, ' ') AS d, sources AS s FROM search_result WHERE sources IS NOT NULL AND title IS NOT NULL AND description IS NOT NULL),
n AS (SELECT *, unnest(range(0, least(len(t), len(d), len(s)))) AS pos FROM a) SELECT result_id, pos::INT AS pos, t[pos + 1] AS title_word, d[pos + 1] AS description_word, s[pos + 1] AS source FROM n""",
    "q_rendered": f"""WITH r AS (SELECT result_id, {_E_("coalesce(title, '')")} AS t, {_E_("coalesce(url, '')")} AS u, {_E_("coalesce(description, '')")} AS d, coalesce(sources, []) AS s, CASE WHEN starts_with(image, 'http') THEN image END AS i, rank FROM search_result)
SELECT result_id, '<div class="' || CASE WHEN rank % 2 = 1 THEN 'result result-left' ELSE 'result' END || '">' ||
  CASE WHEN i IS NOT NULL THEN '<img class="' || CASE WHEN list_contains(s, 'brave') THEN 'result-img result-img-square' ELSE 'result-img' END || '" src="' || {_E_("i")} || '" alt="" loading="lazy" referrerpolicy="no-referrer">' ELSE '' END ||
  '<div class="result-source">' || array_to_string(list_transform(s, lambda x: '<span class="source-' || {_E_("replace(x, ' ', '-')")} || '">' || {_E_("x")} || '</span>'), ' ') ||
  '</div><div class="result-title"><a href="' || u || '">' || t || '</a></div><div class="result-url">' || u || '</div><div class="result-desc">' || d || '</div></div>' AS card FROM r""",
    "q_squeezed": r"SELECT DISTINCT page_id, md5(trim(regexp_replace(content, '[\s\p{Z}\x{85}\x0b]+', ' ', 'g'))) AS digest, length(regexp_replace(content, '^[\s\p{Z}\x{85}\x0b]+|[\s\p{Z}\x{85}\x0b]+$', '', 'g')) AS n_chars FROM page_data WHERE content IS NOT NULL",
    "q_search": f"""WITH {_BLOCK}, {_REL}, ok AS (SELECT * FROM (SELECT *, {_HOST} AS host FROM rel) WHERE host IS NULL OR NOT {_IS_BLOCKED}),
{_INTER.format(rows='ok')} SELECT query_id, position, CASE WHEN position % 2 = 1 THEN 'left' ELSE 'right' END AS side, source, result_id, title, url FROM shown""",
}
