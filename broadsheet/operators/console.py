"""Console and dashboard operators over the logical tables of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import classify, coerce, texts, urls
from broadsheet.sources.scratch import staged

from . import joins, latest, rollups
from .candidates import canonical_kind

METRICS = ("discovered", "fetched", "stored", "already_known", "duplicate_candidate", "error_count")


# --- selection ---


def select_publishers(publishers: DataFrame, selection: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Enabled publishers: all, or those named by id, slug or name, or those in one of the groups, whatever the case."""
    out = publishers.where("enabled")
    wanted = [s.strip().lower() for s in selection or [] if s.strip()]
    if wanted and "all" not in wanted:
        out = out.where(F.lower("id").isin(*wanted) | F.lower("slug").isin(*wanted) | F.lower("name").isin(*wanted))
    if groups:
        out = out.where(F.arrays_overlap(F.transform("groups", F.lower), F.array(*[F.lit(g.lower()) for g in groups])))
    return out


def listed(df: DataFrame, enabled_only: bool = False, **wanted) -> DataFrame:
    """Rows of a stored table: enabled ones only if asked, and those whose columns have the wanted values; None is no wish."""
    out = df.where("enabled") if enabled_only and "enabled" in df.columns else df
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    return out


def event_key(row_id: Column) -> Column:
    """Order of event ids that may be texts: numbers by value, then texts."""
    number = coerce.safe_int(row_id)
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), F.when(number.isNull(), row_id.cast("string")).alias("text"))


def legacy_event_page(events: DataFrame, after: str | None = None, limit: int = 50, offset: int = 0, **wanted) -> DataFrame:
    """A page of events whose ids may be texts and whose columns may be fewer, with ``total``, the number of all that match.

    wanted: column -> value, compared whatever the case; a column that the events lack matches nothing.
    """
    x = events.withColumn("_key", event_key(F.col("id")))
    for name, value in wanted.items():
        if value is not None:
            x = x.where(F.lower(F.col(name).cast("string")) == str(value).lower()) if name in events.columns else x.limit(0)
    if after not in (None, ""):
        x = x.where(F.col("_key") > event_key(F.lit(str(after))))
    total = x.agg(F.count("*").alias("total"))
    page = x.orderBy("_key").offset(offset).limit(limit)
    return page.join(F.broadcast(total), F.lit(True)).orderBy("_key").drop("_key")  # one row


def select_runs(runs: DataFrame, state: str, status: str | None = None) -> DataFrame:
    """Runs by shown state, by ``finished`` or ``terminal`` for all that ended, or by stored status."""
    if status is None:
        return runs
    word = status.strip().lower().replace("-", "_").replace(" ", "_")
    if word in ("finished", "terminal"):
        return runs.where(~F.col(state).isin("running", "stale", "unknown"))
    return runs.where((F.col(state) == word) | (texts.token(F.col("status")) == word)) if word not in classify.LABELS else runs.where(F.col(state) == word)


def active_run(runs: DataFrame) -> DataFrame:
    """The running or active run of newest heartbeat; one without heartbeat only if there is no other."""
    return runs.where(F.col("status").isin("running", "active")).orderBy(F.col("heartbeat_at").desc_nulls_last(), F.desc("id")).limit(1)


def selectable_sources(sources: DataFrame, publishers: DataFrame) -> DataFrame:
    """Enabled sources of enabled publishers whose id is unique among all sources."""
    unique = sources.groupBy("id").agg(F.count("*").alias("_n")).where("_n = 1").select("id")
    live = sources.where("enabled").join(publishers.where("enabled").select(F.col("id").alias("publisher_id")), "publisher_id", "left_semi")
    return live.join(unique, "id", "left_semi")


def resolve_source(sources: DataFrame, publishers: DataFrame, wanted: str) -> dict:
    """The one enabled source of this id or URL; ValueError for an unknown, disabled or orphaned one."""
    url = urls.normalize_or_none(wanted)
    found = sources.where((F.col("id") == wanted) | (F.col("normalized_url") == F.lit(url))).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'unknown' if not found else 'ambiguous'} source: {wanted}")
    if not found[0]["enabled"]:
        raise ValueError(f"disabled source: {wanted}")
    if publishers.where((F.col("id") == found[0]["publisher_id"]) & F.col("enabled")).isEmpty():
        raise ValueError(f"source without an enabled publisher: {wanted}")
    return found[0].asDict()


def requires_javascript(config: Column) -> Column:
    """Whether a source's configuration (map) says that its pages need a browser."""
    keys = ("requires_javascript", "javascript_required", "js_required", "javascript", "render_javascript")
    return classify.any_of(*[coerce.flag(F.element_at(config, k), False) for k in keys], F.lower(F.element_at(config, "rendering")).isin("javascript", "browser", "client"))


def config_only_missing(publishers: DataFrame, sources: DataFrame) -> DataFrame:
    """Publishers that are marked as having no source and indeed have none."""
    return publishers.where(F.col("source_status").isin("not_found", "source_not_found")).join(sources.select(F.col("publisher_id").alias("id")).distinct(), "id", "left_anti")


# --- runs ---


def fold_runs(changes: DataFrame) -> DataFrame:
    """Runs from their changes (id, seq and any run column): the last value of each column that isn't null.

    progress_at moves only with a change that carries progress; the duration is that of start and finish, and a finish is a
    heartbeat.
    """
    columns = [c for c in changes.columns if c not in ("id", "seq", "progress_at", "duration_ms")]
    last = lambda c, when=None: F.max_by(c, F.when(F.col(when or c).isNotNull(), F.col("seq"))).alias(c)
    out = changes.groupBy("id").agg(*[last(c) for c in columns], F.max_by("heartbeat_at", F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress_at"))
    ms = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return out.withColumn("duration_ms", F.when(ms >= 0, F.bround(ms).cast("long"))).withColumn("heartbeat_at", F.greatest("heartbeat_at", "finished_at"))


def run_leases(runs: DataFrame, leases: DataFrame) -> DataFrame:
    """runs with the lease that names them (name run:<id>), newest heartbeat first; no lease is guessed."""
    own = latest.top_per_key(leases.withColumn("id", F.regexp_extract("name", r"^run:(.+)$", 1)).where("id <> ''"), ["id"], [F.col("heartbeat_at").desc_nulls_last()])
    return runs.join(own.select("id", "lease_until", F.col("heartbeat_at").alias("lease_heartbeat_at"), F.col("owner").alias("lease_owner")), "id", "left")


def classified_runs(runs: DataFrame, leases: DataFrame, stats: DataFrame, results: DataFrame, now: Column, stale_seconds: int = 300) -> DataFrame:
    """runs with state, reason, label and failures: liveness by heartbeat and lease while running, else the outcome.

    Stored failures of sources and publishers turn a completed run into a warning.
    """
    bad = lambda df: df.where(texts.token(F.col("status")).isin(*classify.FAILED, *classify.WARNING)).groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    failures = bad(stats).unionByName(bad(results)).groupBy("id").agg(F.sum("n").alias("failures"))
    stops = stats.where(texts.token(F.col("stop_reason")).isin(*classify.BUDGET_STOPS, *classify.FAILURE_STOPS)).groupBy(F.col("run_id").alias("id")).agg(F.min("stop_reason").alias("_stop"))
    x = run_leases(runs, leases).join(failures, "id", "left").join(stops, "id", "left").fillna(0, ["failures"])
    beat = F.coalesce("heartbeat_at", "lease_heartbeat_at")
    live, reason = classify.liveness(F.col("status"), F.col("finished_at"), beat, F.col("lease_until"), F.lit(None).cast("string"), now, stale_seconds)
    ended = F.when(texts.token(F.col("status")).isin(*classify.RUNNING), "completed").otherwise(F.col("status"))
    outcome = classify.display_status(ended, (F.col("failures") > 0) | (F.coalesce("error", F.lit("")) != ""), F.coalesce("stop_reason", "_stop"))
    state = F.when(live == "terminal", outcome).otherwise(live)
    return x.withColumn("state", state).withColumn("reason", reason).withColumn("label", classify.status_label(state)).drop("_stop")


def in_order(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``_n``, 1, 2, 3... by ``order`` without gaps, and how many there are.

    The rows are range-partitioned and written once, with their place in their partition, so counting and numbering see the
    same cuts. One count a partition reaches the driver; no task sees all rows.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = staged(placed, "events")
    part = F.shiftright("_m", 33)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row a partition
        before[r["p"]], total = total, total + r["n"]
    if not before:
        return placed.withColumn("_n", F.col("_m")).drop("_m"), 0
    start = F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in before.items() for v in kv]), part)
    return placed.withColumn("_n", start + F.col("_m") % (1 << 33) + 1).drop("_m"), total


def append_events(events: DataFrame, rows: DataFrame) -> DataFrame:
    """New events with ids after the greatest one, in order of arrival (run_id, arrival); metadata is made safe.

    One writer at a time; ``outbox.Outbox`` gives ids to several.
    """
    top = events.agg(F.max("id")).first()[0] or 0
    numbered, _ = in_order(rows, ["run_id", "arrival"])
    return numbered.withColumn("id", F.lit(top).cast("long") + F.col("_n")).withColumn("metadata", texts.sanitize_metadata("metadata")).drop("_n")


# --- sources, publishers, articles ---


def latest_stats(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest stat of each source: by its run's time, then its own, then id."""
    x = joins.enrich(stats, runs.withColumnRenamed("id", "run_id"), "run_id", {"started_at": "_run_at"})
    return latest.top_per_key(x, ["source_id"], [F.coalesce("_run_at", "started_at").desc_nulls_last(), F.col("started_at").desc_nulls_last(), F.desc("id")]).drop("_run_at")


def source_list(sources: DataFrame, publishers: DataFrame, stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with publisher, latest stat and whether they can be started."""
    mine = latest_stats(stats, runs).select("source_id", *[F.col(m).alias(m) for m in METRICS], F.col("status").alias("stat_status"), F.col("stop_reason").alias("stat_stop_reason"))
    x = sources.join(mine.withColumnRenamed("source_id", "id"), "id", "left")
    x = joins.enrich(x, publishers.withColumnRenamed("id", "publisher_id"), "publisher_id", {"name": "publisher_name", "enabled": "publisher_enabled"})
    status = F.coalesce(F.col("stat_status"), F.col("status"), F.lit("discovered"))
    good = F.coalesce("success", texts.token(status).isin(*classify.SUCCESS))
    return x.select(
        "id", "publisher_id", "publisher_name", "url", canonical_kind(F.col("kind")).alias("kind"), F.col("kind").alias("adapter"), "enabled", status.alias("status"), good.alias("success"), *METRICS,
        "stat_stop_reason", (F.col("enabled") & F.coalesce("publisher_enabled", F.lit(False))).alias("can_start"), urls.safe_link(urls.redact(F.col("url"))).alias("link"),
    )


def publisher_history(stats: DataFrame, results: DataFrame, runs: DataFrame, publisher_id: str) -> DataFrame:
    """Each run of a publisher: its stored result, else the sum of its stats; newest first."""
    own = lambda df: df.where(F.col("publisher_id") == publisher_id)
    a = own(results).groupBy("run_id").agg(*[F.max(c).alias(c) for c in ("status", "discovered", "inserted")])
    b = own(stats).groupBy("run_id").agg(rollups.joined_values(F.col("status")).alias("status"), rollups.total(F.col("discovered")).alias("discovered"), rollups.total(F.col("stored")).alias("inserted"))
    x = joins.prefer(a, b, ["run_id"])
    return joins.enrich(x, runs.withColumnRenamed("id", "run_id"), "run_id", {"started_at": "started_at", "stop_reason": "stop_reason"}).orderBy(F.col("started_at").desc_nulls_last(), F.desc("run_id"))


def publisher_detail(publishers: DataFrame, sources: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """Publishers with numbers of sources and the latest run that has a result of them."""
    n = sources.groupBy("publisher_id").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources"))
    r = joins.enrich(results.select("publisher_id", "run_id", "status"), runs.withColumnRenamed("id", "run_id"), "run_id", {"started_at": "run_at"})
    last = r.groupBy("publisher_id").agg(F.max_by(F.struct("run_id", "status", "run_at"), F.struct("run_at", "run_id")).alias("l")).select("publisher_id", F.col("l.run_id").alias("last_run_id"), F.col("l.status").alias("last_status"))
    x = publishers.withColumnRenamed("id", "publisher_id").join(n, "publisher_id", "left").join(last, "publisher_id", "left")
    return x.fillna(0, ["sources", "enabled_sources"])


def article_list(articles: DataFrame, discoveries: DataFrame, sources: DataFrame, publisher_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Articles with publishers, kinds and bounds of discovery, of one publisher or kind if asked; newest first by caller."""
    s = sources.select(F.col("id").alias("source_id"), "publisher_id", canonical_kind(F.col("kind")).alias("kind"))
    d = discoveries.join(s, "source_id", "left").groupBy(F.col("article_id").alias("id")).agg(
        F.array_sort(F.collect_set("publisher_id")).alias("publishers"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("discovered_at").alias("first_discovered_at"), F.max(F.greatest("discovered_at", "last_discovered_at")).alias("last_discovered_at"), F.count("*").alias("discoveries")
    )
    if publisher_id is not None:
        d = d.where(F.array_contains("publishers", publisher_id))
    if kind is not None:
        d = d.where(F.array_contains("kinds", kind))
    restricted = publisher_id is not None or kind is not None
    return articles.join(d, "id", "inner" if restricted else "left").drop("raw_html")


def article_projection(listed: DataFrame, official_hosts: list[str], now: Column) -> DataFrame:
    """Safe records of articles: links without secrets, a summary of the body, and quality findings; no raw pages."""
    url = F.coalesce("canonical_url", "normalized_url", "source_url")
    counts = listed.select("id", url.alias("url"), texts.title_key("title").alias("_t"), "title", "content", "summary", "published_at", "last_fetched_at", "first_discovered_at", "image_url")
    by_url = counts.groupBy("url").agg(F.count("*").alias("_nu"))
    by_title = counts.groupBy("_t").agg(F.count("*").alias("_nt"))
    x = joins.null_safe_join(joins.null_safe_join(counts, by_url, ["url"], "left"), by_title, ["_t"], "left")
    official = urls.host(F.col("url")).isin(*official_hosts) if official_hosts else F.lit(True)
    codes = classify.quality_warnings(F.col("title"), F.col("url"), F.coalesce(official, F.lit(False)), F.col("content"), F.col("published_at"), F.col("last_fetched_at"), now, F.col("_nu"), F.col("_nt"))
    newest = F.greatest("published_at", "first_discovered_at", "last_fetched_at")
    return x.select("id", urls.safe_link(urls.redact(F.col("url"))).alias("url"), "title", "published_at", F.coalesce(F.nullif("summary", F.lit("")), texts.summary(F.coalesce("content", F.lit("")))).alias("summary"), urls.safe_link(F.col("image_url")).alias("image_url"), codes.alias("warnings"), newest.alias("newest_at"))


def run_articles(relations: DataFrame | None, articles: DataFrame, run_id: str) -> tuple[DataFrame, bool, str]:
    """(articles of a run, whether that can be told, how): by stored relations, else by the articles' own run, else not at all.

    It is never guessed from times.
    """
    if relations is not None:
        found = relations.where(F.col("run_id") == run_id).groupBy(F.col("article_id").alias("id")).agg(rollups.joined_values(F.col("outcome")).alias("outcomes"), F.bool_or(F.col("outcome") == "stored").alias("stored"))
        return articles.join(found, "id"), True, "relation"
    if "run_id" in articles.columns:
        return articles.where(F.col("run_id") == run_id), True, "article"
    return articles.limit(0), False, "no relation between runs and articles is stored"


def envelope(page: list[dict], total: int, limit: int, offset: int) -> dict:
    """A page for an API: items, counts, whether there is more and where."""
    more = offset + len(page) < total
    stamps = [str(r[c]) for r in page for c in ("updated_at", "created_at", "last_updated") if r.get(c)]
    return {"items": page, "count": len(page), "total": total, "limit": limit, "offset": offset, "has_more": more, "next_offset": offset + len(page) if more else None, "next_cursor": str(offset + len(page)) if more else None, "last_updated": max(stamps, default=None)}
