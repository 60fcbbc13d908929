"""Audits: what must hold between registry, runs and articles, each as rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import classify, texts, urls

from . import joins, rollups


def _findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _finding(code: str, df: DataFrame, subject: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def registry_audit(publishers: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled publishers without an enabled source, sources without a publisher, repeated ids."""
    live = sources.where("enabled").select(F.col("publisher_id").alias("id")).distinct()
    orphan = sources.join(publishers.select(F.col("id").alias("publisher_id")), "publisher_id", "left_anti")
    twice = rollups.duplicate_groups(sources, F.col("id"), "id")
    return _findings([_finding("no_enabled_source", publishers.where("enabled").join(live, "id", "left_anti"), F.col("id")), _finding("unknown_publisher", orphan, F.col("id"), F.col("publisher_id")), _finding("duplicate_source", twice, F.col("id"), F.col("n"))])


def run_evidence_audit(run_id: str, sources: DataFrame, stats: DataFrame, runs: DataFrame, tolerance: str = "1 second") -> DataFrame:
    """Enabled sources without exactly one stat in a run, stats of others, and stats outside the run's time."""
    mine = stats.where(F.col("run_id") == run_id)
    cover = joins.coverage(sources.where("enabled").select(F.col("id").alias("source_id")), mine, ["source_id"]).where("state <> 'exactly_one'")
    window = runs.where(F.col("id") == run_id).select(F.col("id").alias("run_id"), F.col("started_at").alias("_from"), F.col("finished_at").alias("_to"))
    timed = joins.within(mine.where("started_at is not null"), window, "run_id", "started_at", "_from", "_to", tolerance).where("not inside")
    return _findings([_finding("source_evidence", cover, F.col("source_id"), F.col("state")), _finding("outside_run", timed, F.col("source_id"), F.col("started_at"))])


def result_audit(run_id: str, publishers: DataFrame, results: DataFrame) -> DataFrame:
    """Enabled publishers without exactly one result, results of unknown category, and blocking failures."""
    mine = results.where(F.col("run_id") == run_id)
    cover = joins.coverage(publishers.where("enabled").select(F.col("id").alias("publisher_id")), mine, ["publisher_id"]).where("state <> 'exactly_one'")
    category = classify.completion(F.col("error_category"), F.col("source_status"), F.col("status"))
    blocked = mine.withColumn("_c", category).where(classify.blocking(F.col("_c")))
    return _findings([_finding("publisher_evidence", cover, F.col("publisher_id"), F.col("state")), _finding("blocking_failure", blocked, F.col("publisher_id"), F.col("_c"))])


def duplicate_audit(articles: DataFrame) -> DataFrame:
    """Groups that identity should have made one: URLs, identity keys, and hash with title."""
    keys = {"canonical_url": F.col("canonical_url"), "normalized_url": F.col("normalized_url"), "content_identity_key": F.col("content_identity_key"), "content_and_title": texts.content_identity(F.col("content_hash"), texts.title_key("title"))}
    return _findings([_finding(f"duplicate_{name}", rollups.duplicate_groups(articles, key), F.col("value"), F.col("n")) for name, key in keys.items()])


def article_audit(articles: DataFrame, publisher: str, official_hosts: Column, minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """(articles with an array of reasons against them, publishers with fewer valid articles than the minimum)."""
    url = F.coalesce("canonical_url", "normalized_url")
    reasons = {
        "no_title": texts.collapsed(F.coalesce("title", F.lit(""))) == "", "no_url": ~F.coalesce(url, F.lit("")).rlike("(?i)^https?://"), "no_content": F.trim(F.coalesce("content", F.lit(""))) == "",
        "not_official": ~F.array_contains(official_hosts, urls.host(url)), "root_page": F.regexp_replace(urls.path(url), "/+$", "") == "", "not_parsed": ~F.coalesce("parse_status", F.lit("")).isin("success", "partial"), "navigation": classify.navigation_content(F.col("title"), F.col("content")),
    }
    judged = articles.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in reasons.items()])))
    few = judged.groupBy(publisher).agg(F.count_if(F.size("reasons") == 0).alias("valid"), F.count("*").alias("articles")).where(F.col("valid") < minimum)
    return judged, few


def two_run_acceptance(first: DataFrame, second: DataFrame, publisher: str, key: str) -> DataFrame:
    """Per publisher: articles of each run, new in the second, and lost; two full runs of the same sources should bring none."""
    seen = first.select(publisher, key, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(second.select(publisher, key, F.lit(False).alias("a"), F.lit(True).alias("b")))
    by_key = seen.groupBy(publisher, key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return by_key.groupBy(publisher).agg(F.count_if("a").alias("first"), F.count_if("b").alias("second"), F.count_if(~F.col("a")).alias("new"), F.count_if(~F.col("b")).alias("lost"))
