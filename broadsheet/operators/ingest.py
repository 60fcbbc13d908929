"""Ingestion as one plan: registry and fetched documents in, new table versions and their statistics out.

Sources are dispatched by kind to scans that all yield the same candidates. What is known, repeated or off policy goes
before any page is parsed, since no filter moves below the parser. Failures are columns, not exceptions: a document that
can't be read yields no candidates and an error class.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import classify, texts, urls
from broadsheet.sources import archives, feeds, jsonapi
from broadsheet.sources.articles import article_scan

from . import candidates as c

COLUMNS = ("source_id", "publisher_id", "kind", "source_url", "position", "url", "title", "summary", "author", "published_at", "published_raw", "date_problem")
Adapter = Callable[[DataFrame, DataFrame], DataFrame]


class AdapterRegistry:
    """Named adapters for sources of kind custom_adapter. Configuration names them; only code registers them.

    An adapter gets (its sources, the fetched documents of their official hosts) and returns source_id, url and any other candidate column.
    """

    def __init__(self):
        self._by_name: dict[str, Adapter] = {}

    def register(self, name: str, adapter: Adapter, replace: bool = False) -> Adapter:
        if not name or (name in self._by_name and not replace):
            raise ValueError(f"adapter name is empty or taken: {name!r}")
        self._by_name[name] = adapter
        return adapter

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def get(self, name: str) -> Adapter | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return sorted(self._by_name)


def _shaped(found: DataFrame) -> DataFrame:
    types = {"position": "int", "published_at": "timestamp"}
    return found.select(*[(F.col(n) if n in found.columns else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in COLUMNS])


def _config(sources: DataFrame, default: dict | None) -> Column:
    """Each source's configuration over the default one, as a JSON object."""
    if "config" not in sources.columns:
        return F.lit(json.dumps(default or {}))
    kind = dict(sources.dtypes)["config"]
    base = F.create_map(*[F.lit(x) for k, v in (default or {}).items() for x in (k, v if isinstance(v, str) else json.dumps(v))]) if default else F.create_map().cast("map<string,string>")
    own = F.col("config") if kind.startswith("map") else F.from_json("config", "map<string,string>")
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own))


def discover(sources: DataFrame, documents: DataFrame, adapters: AdapterRegistry | None = None, json_config: dict | None = None, archive_config: dict | None = None, policies: DataFrame | None = None) -> DataFrame:
    """Candidates of enabled sources (id, publisher_id, url, kind, enabled, adapter) from documents (url, status, content).

    sources may have ``config`` (a map, or JSON): paths of an API, selectors, next_selector and max_pages of an archive,
    max_sitemaps of a sitemap. It goes before json_config and archive_config. Indexes of sitemaps and next links of archives
    are followed through the documents. registry_only sources yield none: they only have a status. Custom sources go to the
    adapter that they name, which gets documents of official hosts alone: those of policies (source_id or publisher_id,
    hosts), else the hosts of its sources' own URLs.
    """
    live = sources.where("enabled").withColumn("kind", c.canonical_kind(F.col("kind")))
    documents = documents.where(F.coalesce("status", F.lit(200)).between(200, 299)).select("url", "status", "content")
    named = ["source_id", "publisher_id", "kind", "source_url"]
    tagged = [F.col("id").alias("source_id"), "publisher_id", "kind", F.col("url").alias("source_url")]
    feed = live.where(F.col("kind").isin("rss", "atom")).select(*tagged, "url").join(documents.select("url", "content"), "url")
    found = [_shaped(feed.select(*named, F.explode(feeds.parse_feed("content", "url")).alias("i")).select(*named, "i.*"))]
    api = live.where("kind = 'json_api'").select(*tagged, "url", _config(live, json_config).alias("said")).join(documents.select("url", "content"), "url")
    found.append(_shaped(api.select(*named, F.explode(jsonapi.parse_json_api(F.col("content"), F.col("url"), F.col("said"))).alias("i")).select(*named, "i.*")))

    # Every source walks by its own settings, those that share a URL as well.
    walk = [F.col("source_id").alias("root"), F.col("source_url").alias("url")]
    maps = live.where("kind = 'sitemap'").select(*tagged, F.get_json_object(_config(live, None), "$.max_sitemaps").cast("int").alias("max_sitemaps"))
    if not maps.isEmpty():
        walked = feeds.sitemap_walk(documents, maps.select(*walk, "max_sitemaps")).withColumnRenamed("root", "source_id")
        entries = maps.drop("max_sitemaps").join(walked, "source_id")
        found.append(_shaped(entries.withColumn("published_at", F.col("last_modified")).withColumn("published_raw", F.col("last_modified_raw"))))
    pages = live.where("kind = 'archive'").select(*tagged, _config(live, archive_config).alias("config"))
    if not pages.isEmpty():
        cards = archives.archive_walk(documents, pages.select(*walk, "config")).withColumnRenamed("root", "source_id")
        found.append(_shaped(pages.drop("config").join(cards, "source_id")))
    for name in adapters.names() if adapters else ():
        mine = live.where((F.col("kind") == "custom_adapter") & (F.col("adapter") == name))
        hosts = mine.select(urls.host(F.col("url")).alias("host"))
        if policies is not None:
            key = "source_id" if "source_id" in policies.columns else "publisher_id"
            hosts = mine.select(F.col("id").alias("source_id"), "publisher_id").join(policies, key).select(F.explode("hosts").alias("host"))
        official = documents.withColumn("host", urls.host(F.col("url"))).join(hosts.distinct(), "host", "left_semi").drop("host")
        out = adapters.get(name)(mine, official)
        found.append(_shaped(out.drop("publisher_id", "kind", "source_url").join(mine.select(*tagged), "source_id")))
    return reduce(DataFrame.unionByName, found)


def source_health(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """source_id, status, success, http_status, error of each enabled source by its own document."""
    x = sources.where("enabled").join(documents.select("url", F.col("status").alias("http_status")), "url", "left")
    failed = F.col("http_status").isNull() | (F.col("http_status") >= 400)
    status = F.when(c.canonical_kind(F.col("kind")).isNull() | (c.canonical_kind(F.col("kind")) == "unsupported"), "unsupported").when(F.col("http_status").isNull(), "source_not_found").when(failed, classify.http_class(F.col("http_status"))).otherwise("success")
    return x.select(F.col("id").alias("source_id"), status.alias("status"), (status == "success").alias("success"), "http_status")


def select_candidates(found: DataFrame, policies: DataFrame, known: DataFrame, limit: int = 10, cutoff=None) -> tuple[DataFrame, DataFrame]:
    """(to fetch, all with their fate). policies: source_id or publisher_id, hosts, phrases, and patterns. known: url.

    Patterns are the columns allow, allow_text, exclude, navigation and restricted of registry.policies(); a policy without
    them has none. Fates, in this order: off_policy, off_topic, too_old, duplicate (within the source or of an earlier
    source), known, over_limit, new. Sources take turns by priority of kind, then id.
    """
    for name, kind in (("allow", "array<string>"), ("allow_text", "array<string>"), ("exclude", "array<string>"), ("navigation", "array<string>"), ("restricted", "boolean")):
        if name not in policies.columns:
            policies = policies.withColumn(name, F.lit(None).cast(kind))
    names = ["hosts", "allow", "allow_text", "exclude", "navigation", "restricted", "phrases"]
    of = "source_id" if "source_id" in policies.columns else "publisher_id"
    x = found.withColumn("key", urls.normalize_url("url")).join(policies.select(of, *names), of, "left")
    text = texts.title_key(F.concat_ws(" ", "title", "summary", "author"))
    on_topic = F.coalesce(F.size("phrases"), F.lit(0)) <= 0
    x = x.withColumn("_text", text).withColumn("_topic", on_topic | F.exists(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: F.contains(F.col("_text"), p)))
    bad = c.policy_by(F.col("key"), F.col("hosts"), F.col("source_url"), *[F.col(n) for n in names[1:6]]).isNotNull()
    old = F.coalesce(F.col("published_at") < cutoff, F.lit(False)) if cutoff is not None else F.lit(False)
    x = x.withColumn("fate", F.when(F.coalesce(bad, F.lit(True)), "off_policy").when(~F.col("_topic"), "off_topic").when(old, "too_old"))
    order = [c.source_order(F.col("kind")), F.col("source_id"), F.col("position")]
    x = x.withColumn("_n", F.row_number().over(W.partitionBy("key", F.col("fate").isNull()).orderBy(*order)))
    x = x.join(known.select(F.col("url").alias("key"), F.lit(True).alias("_known")).distinct(), "key", "left")
    x = x.withColumn("fate", F.coalesce("fate", F.when(F.col("_n") > 1, "duplicate").when(F.col("_known"), "known")))
    x = x.withColumn("_n", F.row_number().over(W.partitionBy("source_id", F.col("fate").isNull()).orderBy(*order)))
    x = x.withColumn("fate", F.coalesce("fate", F.when(F.col("_n") > limit, "over_limit").otherwise(F.lit("new")))).drop("_n", "_known", "_text", "_topic", *names)
    return x.where("fate = 'new'"), x


def parse_new(chosen: DataFrame, documents: DataFrame, config: dict | None = None) -> DataFrame:
    """Articles of the chosen candidates: what the page says wins, then what the candidate said."""
    pages = documents.where(F.coalesce("status", F.lit(200)).between(200, 299)).withColumn("key", urls.normalize_url("url"))
    pages = pages.join(chosen.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    a = article_scan(pages.select(F.col("key").alias("url"), "content"), config).withColumnRenamed("url", "key")
    said = lambda n: F.coalesce(F.nullif(F.col(f"a.{n}"), F.lit("")), F.col(f"c.{n}")).alias(n)
    joined = chosen.alias("c").join(a.alias("a"), "key", "left")
    return joined.select(
        F.col("key").alias("url"), "c.source_id", "c.publisher_id", "a.canonical_url", *[said(n) for n in ("title", "summary", "author", "published_raw")],
        F.coalesce("a.published_at", "c.published_at").alias("published_at"), "a.content", "a.content_html", "a.content_hash", "a.html_hash", "a.language", "a.image_url",
        F.coalesce("a.parse_status", F.lit("failed")).alias("parse_status"), F.coalesce("a.errors", F.array(F.lit("http_error: not fetched"))).alias("errors"),
    )


def run_stats(fates: DataFrame, outcomes: DataFrame, run_id: str) -> DataFrame:
    """One row a source: what was discovered, repeated, known and stored, errors and status. outcomes: source_id, outcome, failed."""
    a = fates.groupBy("publisher_id", "source_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("fate") == "duplicate").alias("duplicate_candidate"), F.count_if(F.col("fate") == "known").alias("already_known"), F.count_if(F.col("fate") == "new").alias("fetched"), F.max(F.col("fate") == "over_limit").alias("limited"))
    b = outcomes.groupBy("source_id").agg(F.count_if(F.col("outcome") == "created").alias("stored"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if("failed").alias("error_count"))
    x = a.join(b, "source_id", "left").fillna(0, ["stored", "updated", "error_count"])
    stop = F.when(F.col("limited"), "candidate_limit").otherwise("exhausted")
    return x.select(F.lit(run_id).alias("run_id"), "publisher_id", "source_id", "discovered", "fetched", "stored", "updated", "already_known", "duplicate_candidate", "error_count", classify.result_status(F.col("error_count"), F.col("discovered")).alias("status"), stop.alias("stop_reason"))


def run_events(stats: DataFrame, at) -> DataFrame:
    """Events that the stages' results amount to, in order of source."""
    event = F.when(F.col("error_count") > 0, "source_failed").when(F.col("stop_reason") == "candidate_limit", "budget_hit").otherwise("source_finished")
    level = F.when(F.col("error_count") > 0, "WARNING").otherwise("INFO")
    message = F.concat_ws(" ", F.col("discovered").cast("string"), F.lit("discovered,"), F.col("stored").cast("string"), F.lit("stored"))
    return stats.select("run_id", "publisher_id", "source_id", F.lit(at).cast("timestamp").alias("created_at"), level.alias("level"), F.lit("crawler").alias("component"), event.alias("event_type"), message.alias("message"))


def progress(stats: DataFrame, phase: str, publisher_id: str | None = None, source_id: str | None = None) -> DataFrame:
    """One row: where a run stands, six counters over its stats so far, its phase and what it is at."""
    names = ("discovered", "fetched", "stored", "updated", "already_known", "error_count")
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names]
    return stats.agg(*sums).select(F.lit(phase).alias("phase"), F.lit(publisher_id).cast("string").alias("publisher_id"), F.lit(source_id).cast("string").alias("source_id"), *names)


def emit(events: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str | None]:
    """Hands events to each sink; what one raises keeps none of the others from them, and is returned by the sink's name."""
    told = {}
    for name, sink in sinks.items():
        try:
            sink(events)
            told[name] = None
        except Exception as e:  # a sink's failure never stops a run
            told[name] = f"{type(e).__name__}: {e}"
    return told


def recorded(stats: DataFrame, write: Callable[[DataFrame], None]) -> tuple[DataFrame, str | None]:
    """(stats as they count, what went wrong): if they can't be stored, the run goes on with all of them marked as failed."""
    try:
        write(stats)
        return stats, None
    except Exception as e:  # the error is part of the result
        failed = stats.withColumn("status", F.lit("failed")).withColumn("error_count", F.greatest(F.col("error_count"), F.lit(1))).withColumn("stop_reason", F.lit("storage_error"))
        return failed, f"{type(e).__name__}: {e}"
