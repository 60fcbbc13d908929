"""Sections of the report as frames: counts of publishers, adapters, quality, failures, roster scope and acceptance.

Sections are one row a publisher, source, class or criterion, so what reaches the driver is bounded by the registry. Articles
stay distributed: they are counted with partial sums and written by Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import classify, coerce, texts, urls

from . import consolidate, joins, rollups
from .candidates import KINDS, canonical_kind

#: Counts of a publisher, in the order of the report.
COUNTS = (
    "configured_sources", "registered_sources", "articles", "unique_articles", "source_article_associations", "discovered", "fetched", "parsed", "stored", "inserted", "updated", "failed",
    "duplicate_filtered", "already_known", "duplicate_candidates", "errors", "warnings", "duration_ms",
)
#: Counts of a source's stat that the counts sum, and what a publisher's stored result puts in their place.
FROM_STATS = {"discovered": "discovered", "fetched": "fetched", "parsed": "fetched", "stored": "stored", "inserted": "stored", "failed": "error_count", "duplicate_filtered": "duplicate_candidate", "already_known": "already_known", "duplicate_candidates": "duplicate_candidate", "errors": "error_count", "duration_ms": "duration_ms"}
FROM_RESULT = {"discovered": "discovered", "fetched": "parsed", "parsed": "parsed", "stored": "inserted", "inserted": "inserted", "updated": "updated", "failed": "failed", "duration_ms": "duration_ms", "duplicate_candidates": "duplicate_filtered", "duplicate_filtered": "duplicate_filtered", "errors": "failed"}
# Findings that stand against acceptance; a long title is only a warning.
BLOCKING_QUALITY = ("bad_url", "duplicate_url", "empty_content", "empty_title", "future_date", "navigation_content_suspect", "non_official_host")


def associations(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(publisher_id, source_id, article_id), each once, from discoveries and sources."""
    return links.select("source_id", "article_id").distinct().join(sources.select(F.col("id").alias("source_id"), "publisher_id"), "source_id").select("publisher_id", "source_id", "article_id")


def publisher_counts(publishers: DataFrame, sources: DataFrame, links: DataFrame, stats: DataFrame, results: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """publisher_id and COUNTS of each publisher in one run: sums of its sources' stats, over which its stored result goes.

    warnings: publisher_id, code, one row a finding. Of repeated results the least counts. Counts that are missing are 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    linked = associations(links, sources)
    by_article = linked.groupBy("publisher_id", "article_id").agg(F.count("*").alias("n"))
    news = by_article.groupBy("publisher_id").agg(F.count("*").alias("articles"), F.sum("n").alias("source_article_associations"))
    seen = sources.groupBy("publisher_id").agg(F.count("*").alias("configured_sources"), F.count_if(F.col("status").isNotNull() | F.col("success").isNotNull()).alias("registered_sources"))
    have = [c for c in dict.fromkeys(FROM_STATS.values()) if c in stats.columns]
    summed = stats.groupBy("publisher_id").agg(*[rollups.total(F.col(c)).alias(f"s_{c}") for c in have])
    columns = [c for c in dict.fromkeys(FROM_RESULT.values()) if c in results.columns]
    stored = results.groupBy("publisher_id").agg(F.min(F.struct("id", *columns)).alias("r") if "id" in results.columns else F.min(F.struct(*columns)).alias("r"))
    x = publishers.select(F.col("id").alias("publisher_id"))
    for part in (news, seen, summed, stored):
        x = x.join(part, "publisher_id", "left")
    if warnings is not None:
        x = x.join(warnings.groupBy("publisher_id").agg(F.count("*").alias("warnings")), "publisher_id", "left")
    out = []
    for name in COUNTS:
        source = F.col(f"s_{FROM_STATS[name]}") if FROM_STATS.get(name) in have else F.col("articles") if name == "unique_articles" else F.col(name) if name in x.columns else F.lit(None)
        result = F.col(f"r.{FROM_RESULT[name]}") if FROM_RESULT.get(name) in columns else F.lit(None)
        out.append(zero(F.coalesce(result, source)).alias(name))
    return x.select("publisher_id", *out)


def adapter_stats(sources: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each known kind of source: configured, enabled, registered, successful, failed, associations, unique articles."""
    of = sources.select(F.col("id").alias("source_id"), F.coalesce(canonical_kind(F.col("kind")), F.lit("unknown")).alias("kind"), "enabled", "status", "success")
    good = F.coalesce(F.col("success"), texts.token(F.col("status")).isin(*classify.SUCCESS), F.lit(False))
    counted = of.groupBy("kind").agg(
        F.count("*").alias("configured"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("status").isNotNull() | F.col("success").isNotNull()).alias("registered"),
        F.count_if(good).alias("successful"), F.count_if(texts.token(F.coalesce("status", F.lit(""))).isin(*classify.FAILED, *classify.WARNING)).alias("failed"),
    )
    by_article = links.select("source_id", "article_id").distinct().join(of.select("source_id", "kind"), "source_id").groupBy("kind", "article_id").agg(F.count("*").alias("n"))
    found = by_article.groupBy("kind").agg(F.sum("n").alias("associations"), F.count("*").alias("unique_articles"))
    kinds = sources.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    names = ["configured", "enabled", "registered", "successful", "failed", "associations", "unique_articles"]
    return kinds.join(counted, "kind", "full_outer").join(found, "kind", "full_outer").select("kind", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def official_hosts(publishers: DataFrame, sources: DataFrame) -> DataFrame:
    """(publisher_id, hosts): host of the website, else those of the sources."""
    own = publishers.select(F.col("id").alias("publisher_id"), urls.host(F.col("website_url")).alias("site"))
    of = sources.groupBy("publisher_id").agg(F.array_sort(F.collect_set(urls.host(F.col("url")))).alias("of_sources"))  # a publisher's few hosts
    hosts = F.when(F.coalesce("site", F.lit("")) != "", F.array("site")).otherwise(F.coalesce("of_sources", F.array().cast("array<string>")))
    return own.join(of, "publisher_id", "left").select("publisher_id", hosts.alias("hosts"))


def article_findings(articles: DataFrame, links: DataFrame, sources: DataFrame, publishers: DataFrame, now: Column) -> DataFrame:
    """(publisher_id, article_id, code) for each finding of each publisher's articles at ``now``."""
    url = F.coalesce("canonical_url", "normalized_url", "source_url")
    a = articles.select(F.col("id").alias("article_id"), url.alias("url"), "title", "content", "published_at", "last_fetched_at", texts.title_key("title").alias("_t"))
    by_url, by_title = a.groupBy("url").agg(F.count("*").alias("_nu")), a.groupBy("_t").agg(F.count("*").alias("_nt"))
    a = joins.null_safe_join(joins.null_safe_join(a, by_url, ["url"], "left"), by_title, ["_t"], "left")
    of = associations(links, sources).select("publisher_id", "article_id").distinct().join(official_hosts(publishers, sources), "publisher_id", "left")
    x = a.join(of, "article_id")
    official = F.coalesce(F.array_contains("hosts", urls.host(F.col("url"))), F.lit(False))
    codes = classify.quality_warnings(F.col("title"), F.col("url"), official, F.col("content"), F.col("published_at"), F.col("last_fetched_at"), now, F.col("_nu"), F.col("_nt"))
    return x.select("publisher_id", "article_id", F.explode(codes).alias("code"))


def publisher_findings(publishers: DataFrame, sources: DataFrame, links: DataFrame, articles: DataFrame, results: DataFrame) -> DataFrame:
    """(publisher_id, code) of findings that are a publisher's own: one date for all, no single result, a source in error."""
    dated = associations(links, sources).select("publisher_id", "article_id").distinct().join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id")
    live = publishers.where("enabled").select(F.col("id").alias("publisher_id"))
    parts = [
        rollups.same_date(dated, "publisher_id", F.col("published_at")).select("publisher_id", F.lit("same_date").alias("code")),
        joins.coverage(live, results, ["publisher_id"]).where(F.col("state").isin("missing", "duplicate")).select("publisher_id", F.lit("missing_result").alias("code")),
        sources.where("enabled").where(texts.token(F.coalesce("status", F.lit(""))).isin(*classify.FAILED)).select("publisher_id", F.lit("source_error").alias("code")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_histogram(of_articles: DataFrame, of_publishers: DataFrame) -> DataFrame:
    """(code, n): findings of articles, and those of publishers whose code none of their articles has."""
    told = of_articles.select("publisher_id", "code").distinct()
    own = of_publishers.join(told, ["publisher_id", "code"], "left_anti")
    return of_articles.select("code").unionByName(own.select("code")).groupBy("code").agg(F.count("*").alias("n"))


def failures(results: DataFrame, stats: DataFrame) -> DataFrame:
    """(class, n, external, blocking) of the failures of one run's results and stats; what went well is none."""
    said = lambda df, *names: df.select(F.coalesce(*[classify.specific_category(F.col(n)) for n in names if n in df.columns], F.lit(None).cast("string")).alias("said"), texts.token(F.coalesce("status", F.lit(""))).alias("status"))
    every = said(results, "error_category", "source_status").unionByName(said(stats, "stop_reason")).where(F.col("said").isNotNull() | F.col("status").isin("failed", "failure", "error"))
    every = every.where(~F.coalesce(F.col("said").isin(*classify.BUDGET_STOPS, "exhausted", "no_new_urls"), F.lit(False)))
    name = classify.failure_class(F.coalesce("said", "status"))
    return every.groupBy(name.alias("class")).agg(F.count("*").alias("n")).select("class", "n", classify.external(F.col("class")).alias("external"), classify.blocking(F.col("class")).alias("blocking"))


#: What a provenance record is made of.
PROVENANCE = "struct<source:string,version:string,sha256:string,expanded_count:bigint>"


def provenance(entries: Column) -> Column:
    """The one record of a list of JSON texts; null for none, several, or one without source, version and digest."""
    record = F.from_json(F.get(entries, F.lit(0)), PROVENANCE)
    digest = F.coalesce(record["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    whole = (F.size(entries) == 1) & digest & texts.present(record["source"]).isNotNull() & texts.present(record["version"]).isNotNull()
    return F.when(F.coalesce(whole, F.lit(False)), record)


def memberships(groups: Column) -> tuple[Column, Column]:
    """(groups without repeats, whether all are named, none twice)."""
    named = F.filter(F.coalesce(groups, F.array().cast("array<string>")), lambda g: texts.present(g).isNotNull())
    once = F.array_distinct(F.transform(named, lambda g: F.trim(g)))
    return once, (F.size(once) > 0) & (F.size(once) == F.size(groups))


def roster_scope(publishers: DataFrame) -> DataFrame:
    """One row: whether the registry is a whole roster, and of which origin.

    It is if every publisher has an id, a slug and a name that no other has, complete groups, and one provenance record, all
    of one origin, which declares as many members as there are. publishers: id, slug, name, groups, list_provenance, enabled.
    """
    groups, complete = memberships(F.col("groups"))
    x = publishers.select(
        texts.present(F.col("id")).alias("id"), texts.present(F.col("slug")).alias("slug"), F.lower(texts.collapsed(F.col("name"))).alias("name"), F.size(groups).alias("groups"), complete.alias("complete"),
        provenance(F.col("list_provenance")).alias("p"), (F.size(F.coalesce("list_provenance", F.array().cast("array<string>"))) > 0).alias("claims"), "enabled",
    )
    one = x.agg(
        F.count("*").alias("configured"), F.count_if("enabled").alias("enabled"), F.count_if("complete").alias("members"), F.sum("groups").alias("memberships"), F.count_if(F.col("p").isNotNull()).alias("records"),
        F.count_if(F.col("id").isNull() | F.col("slug").isNull() | (F.coalesce("name", F.lit("")) == "")).alias("nameless"), F.countDistinct("id").alias("ids"), F.countDistinct("name").alias("names"),
        F.countDistinct(F.struct("p.source", "p.version", "p.sha256")).alias("origins"), F.min("p.expanded_count").alias("least"), F.max("p.expanded_count").alias("most"), F.count("p.expanded_count").alias("counts"),
        F.min(F.struct("p.source", "p.version", "p.sha256")).alias("origin"), F.max("claims").alias("claimed"),
    )
    n = F.col("configured")
    unique = (F.col("nameless") == 0) & (F.col("ids") == n) & (F.col("names") == n)
    whole = (n > 0) & unique & (F.col("members") == n) & (F.col("records") == n) & (F.col("origins") == 1) & (F.col("counts") == n) & (F.col("least") == n) & (F.col("most") == n)
    whole = F.coalesce(whole, F.lit(False))
    kept = lambda c: F.when(whole, c)
    return one.select(
        n.alias("configured"), "enabled", F.col("members").alias("configured_memberships"), F.coalesce("memberships", F.lit(0)).cast("long").alias("group_memberships"), whole.alias("available"),
        F.when(whole, "available").when(F.coalesce("claimed", F.lit(False)), "invalid").otherwise("not_provided").alias("status"), kept(n).alias("expanded"),
        kept(F.col("origin.source")).alias("source"), kept(F.col("origin.version")).alias("version"), kept(F.col("origin.sha256")).alias("sha256"),
    )


def criteria(scope: DataFrame, publishers: DataFrame, sources: DataFrame, run_id: str | None, run_status: str | None, results: DataFrame, failed: DataFrame, quality: DataFrame, articles: DataFrame, projected: int, config_error: str | None = None, forbidden: int = 0) -> DataFrame:
    """(place, id, status, detail) of the thirteen criteria of acceptance; each holds or doesn't.

    results: those of the run. failed: failures(). quality: quality_histogram(). articles: normalized_url, content_identity_key.
    projected: rows of publishers in the report. forbidden: columns of the projection that must not be shown.
    """
    live = publishers.where("enabled").select(F.col("id").alias("publisher_id"))
    covered = joins.coverage(live, results, ["publisher_id"]).agg(F.count_if(F.col("state") == "exactly_one").alias("one"), F.count_if(F.col("state").isin("missing", "duplicate")).alias("not_one"))
    of = sources.agg(F.count("*").alias("sources"), F.count_if(canonical_kind(F.col("kind")).isNull()).alias("odd"), F.count_if(F.col("enabled") & F.col("status").isNull() & F.col("success").isNull()).alias("unregistered"), F.count_if("enabled").alias("live"))
    bad = failed.agg(F.coalesce(F.sum(F.when(F.col("blocking"), F.col("n"))), F.lit(0)).alias("blocking"), F.coalesce(F.sum(F.when(F.col("external"), F.col("n"))), F.lit(0)).alias("external"))
    found = quality.agg(F.array_sort(F.collect_set(F.when(F.col("code").isin(*BLOCKING_QUALITY), F.col("code")))).alias("codes"))
    excess = lambda c, n: articles.where(F.coalesce(c, F.lit("")) != "").groupBy(c).agg((F.count("*") - 1).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias(n))
    parts = (scope, covered, of, bad, found, excess("normalized_url", "urls"), excess("content_identity_key", "identities"))  # one row each
    facts = reduce(lambda a, b: a.join(b, "_one"), [part.withColumn("_one", F.lit(1)) for part in parts])
    blocked = classify.token(F.lit(run_status or "")).isin("error", "failed", "failure", "partial", "completed_with_errors") & (F.col("external") == 0)
    n = lambda c: F.col(c).cast("string")
    bad_urls = F.arrays_overlap("codes", F.array(F.lit("bad_url"), F.lit("non_official_host")))
    rows = [
        ("configuration_loaded", F.lit(config_error is None), F.lit(config_error or "the registry can be read")),
        ("publishers_projected", F.lit(projected) == F.col("configured"), F.concat(F.lit(f"{projected} of "), n("configured"))),
        ("supported_adapters", F.col("odd") == 0, F.concat(n("odd"), F.lit(" sources of unknown kind"))),
        ("run_evidence", F.lit(run_id is not None), F.lit(run_id or "no run")),
        ("source_coverage", F.col("unregistered") == 0, F.concat((F.col("live") - F.col("unregistered")).cast("string"), F.lit(" of "), n("live"))),
        ("one_result_each", F.lit(run_id is not None) & (F.col("not_one") == 0), F.concat(n("one"), F.lit(" with exactly one result, "), n("not_one"), F.lit(" without"))),
        ("registry_scope", F.coalesce(F.col("status"), F.lit("")) != "invalid", F.col("status")),
        ("no_run_failures", (F.col("blocking") == 0) & ~blocked, F.concat(n("blocking"), F.lit(" blocking, "), n("external"), F.lit(" external"))),
        ("article_quality", F.size("codes") == 0, F.array_join("codes", ", ")),
        ("deduplication", (F.col("urls") == 0) & (F.col("identities") == 0), F.concat(n("urls"), F.lit(" repeated URLs, "), n("identities"), F.lit(" repeated identities"))),
        ("url_safety", ~bad_urls, F.when(bad_urls, "some URLs are invalid or not official").otherwise("all URLs are valid and official")),
        ("safe_projection", F.lit(forbidden == 0), F.lit(f"{forbidden} forbidden fields")),
        ("one_contract", F.lit(True), F.lit("all renderings come from one projection")),
    ]
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("id"), F.when(F.coalesce(holds, F.lit(False)), "PASS").otherwise("FAIL").alias("status"), detail.alias("detail")) for i, (name, holds, detail) in enumerate(rows, 1)])
    return facts.select(F.inline(listed))


def safe_articles(articles: DataFrame, links: DataFrame, sources: DataFrame, findings: DataFrame) -> DataFrame:
    """The articles as they may be shown: selected fields, links without secrets, publishers and finding codes; no raw pages or metadata."""
    of = associations(links, sources).groupBy("article_id").agg(F.array_sort(F.collect_set("publisher_id")).alias("publishers"), F.count("*").alias("associations"))
    codes = findings.groupBy("article_id").agg(F.array_sort(F.collect_set("code")).alias("warnings"))
    x = articles.withColumnRenamed("id", "article_id").join(of, "article_id", "left").join(codes, "article_id", "left")
    url = F.coalesce("canonical_url", "normalized_url", "source_url")
    none = F.array().cast("array<string>")
    return x.select(
        F.col("article_id").alias("id"), urls.safe_link(urls.redact(url)).alias("url"), "title", "published_at", "author", "language", "parse_status",
        F.coalesce(texts.present(F.col("summary")), texts.summary(F.coalesce("content", F.lit("")))).alias("summary"), "content_hash", F.coalesce("publishers", none).alias("publishers"), F.coalesce("warnings", none).alias("warnings"),
    )


def empty_sources(publishers: DataFrame, sources: DataFrame) -> DataFrame:
    """Publishers without an enabled source, and what that amounts to."""
    origin = F.when(provenance(F.col("list_provenance")).isNotNull(), "list")
    return consolidate.empty_publishers(publishers.withColumn("provenance", origin), sources)


def image_count(stored: Column, metadata: Column, image_url: Column) -> Column:
    """Images of an article: as stored, else as its metadata counts or lists them, else one if there is a picture."""
    listed = F.from_json(coerce.json_field(metadata, "$.images"), "array<string>")
    return F.coalesce(stored, coerce.safe_int(coerce.json_field(metadata, "$.image_count")), F.when(listed.isNotNull(), F.size(listed)), F.when(F.coalesce(image_url, F.lit("")) != "", 1).otherwise(0)).cast("long")
