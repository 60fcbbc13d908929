"""The flagship query: from raw pages to stories by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import texts, urls
from broadsheet.sources.articles import article_scan

from .registry import Tables, query


def _sql() -> str:
    """The stories by text and title of the catalogue's pages, whose bodies are plain articles."""
    from . import articles as a

    body = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
    heading = a._UNESCAPED.format(x="coalesce(nullif(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), ''), regexp_extract(html, '(?is)<title>(.*?)</title>', 1))")
    return f"""WITH p AS (SELECT {a._normal()} AS url, {body} AS body, lower({heading}) AS title FROM pages),
s AS (SELECT {a._HOST.format(u='url')} AS host, CASE WHEN body <> '' AND title <> '' THEN body || chr(0) || title ELSE url END AS story, count(*) AS pages, min(url) AS first_url, max(url) AS last_url, max(CASE WHEN body = '' THEN 'content_parse_error' ELSE 'partial' END) AS status FROM p GROUP BY 1, 2)
SELECT host, count(*) AS stories, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages - 1) AS BIGINT) AS copies, min(first_url) AS first_url, max(last_url) AS last_url, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM s GROUP BY 1"""


@query(_sql())
def duplicate_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts with their stories: pages are parsed, keyed by content and title, and grouped; copies are counted.

    The parser runs once a page, before any shuffle; only hashes and keys are shuffled, with partial sums in each task.
    """
    pages = Tables(spark, folder).pages.select("url", F.col("html").alias("content"))
    parsed = article_scan(pages, {"ended_references": True}).select(urls.normalize_url("url").alias("url"), "content_hash", "parse_status", texts.title_key("title").alias("key"))
    story = F.coalesce(texts.content_identity(F.col("content_hash"), F.col("key")), F.col("url"))
    stories = parsed.groupBy(urls.host(F.col("url")).alias("host"), story.alias("story")).agg(F.count("*").alias("pages"), F.min("url").alias("first_url"), F.max("url").alias("last_url"), F.max("parse_status").alias("parse_status"))
    return stories.groupBy("host").agg(
        F.count("*").alias("stories"), F.sum("pages").alias("pages"), F.sum(F.greatest(F.col("pages") - 1, F.lit(0))).alias("copies"), F.min("first_url").alias("first_url"), F.max("last_url").alias("last_url"), F.array_join(F.array_sort(F.collect_set("parse_status")), ",").alias("statuses")
    )
