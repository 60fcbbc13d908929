"""Report, console, audit and consolidation queries over the catalogue's tables in the roles of the store.

Roles: nations are publishers, suppliers their sources, customers articles, lineitems discoveries, years of orders runs, and
what a supplier sold in a year is its stat of that run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import classify, coerce, dates, texts, urls
from broadsheet.operators import audit, candidates, console, consolidate, identity, ingest, merges, reporting, rollups

from .registry import Tables, query

#: The roles as SQL, for the queries' own SQL.
ROLES = """
publishers AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, 'p-' || n_nationkey AS slug, 'Press ' || CAST(n_nationkey % 20 AS VARCHAR) AS name, 'https://p' || n_nationkey || '.example.org/' AS website_url, n_nationkey % 5 <> 0 AS enabled, n_regionkey FROM nation),
sources AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(CASE WHEN s_suppkey % 17 = 5 THEN 99 ELSE s_nationkey END AS VARCHAR) AS publisher_id, 'https://p' || s_nationkey || '.example.org/s' || s_suppkey AS url, ['feed', 'html', 'sitemap', 'mystery', 'api'][s_suppkey % 5 + 1] AS kind, s_suppkey % 3 <> 0 AS enabled, [NULL, 'ok', 'failed', 'partial'][s_suppkey % 4 + 1] AS status, CASE s_suppkey % 4 WHEN 1 THEN true WHEN 2 THEN false END AS success FROM supplier),
articles AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 50 <> 7 THEN 'https://p' || c_nationkey || '.example.org/n/' || (c_custkey - c_custkey % 11 // 10) END AS url, CASE WHEN c_custkey % 40 = 3 THEN '' ELSE 'Story ' || (c_custkey // 3) END AS title, CASE WHEN c_custkey % 30 = 4 THEN '' ELSE c_mktsegment END AS content, TIMESTAMP '2000-01-01' - to_days(CAST(c_custkey AS INTEGER)) AS published_at FROM customer),
links AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS source_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2),
stats AS (SELECT year(o_orderdate) AS run_id, CAST(s_nationkey AS VARCHAR) AS publisher_id, CAST(l_suppkey AS VARCHAR) AS source_id, count(*) AS discovered, count(*) FILTER (WHERE l_linestatus = 'F') AS fetched, count(*) FILTER (WHERE l_returnflag = 'R') AS stored, count(*) FILTER (WHERE l_returnflag = 'A') AS already_known, count(*) FILTER (WHERE l_quantity > 48) AS error_count
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
results AS (SELECT 1996 + n_nationkey % 2 AS run_id, CAST(n_nationkey AS VARCHAR) AS publisher_id, [NULL, 'partial', 'failed', 'success'][n_nationkey % 4 + 1] AS status, [NULL, 'dns', 'robots', NULL, 'config'][n_nationkey % 5 + 1] AS error_category, n_nationkey * 10 AS parsed, n_nationkey AS inserted FROM nation)"""


def roles(spark, d):
    t = Tables(spark, d)
    pick = lambda index, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
    key = F.col("n_nationkey")
    publishers = t.nation.select(key.cast("string").alias("id"), F.concat(F.lit("p-"), key).alias("slug"), F.concat(F.lit("Press "), key % 20).alias("name"), F.concat(F.lit("https://p"), key, F.lit(".example.org/")).alias("website_url"), (key % 5 != 0).alias("enabled"), "n_regionkey")
    s = F.col("s_suppkey")
    sources = t.supplier.select(
        s.cast("string").alias("id"), F.when(s % 17 == 5, 99).otherwise(F.col("s_nationkey")).cast("string").alias("publisher_id"), F.concat(F.lit("https://p"), "s_nationkey", F.lit(".example.org/s"), s).alias("url"), pick(s % 5, "feed", "html", "sitemap", "mystery", "api").alias("kind"),
        (s % 3 != 0).alias("enabled"), pick(s % 4, None, "ok", "failed", "partial").alias("status"), F.when(s % 4 == 1, True).when(s % 4 == 2, False).alias("success"),
    )
    c = F.col("c_custkey")
    url = F.when(c % 50 != 7, F.concat(F.lit("https://p"), "c_nationkey", F.lit(".example.org/n/"), c - F.floor(c % 11 / 10)))
    articles = t.customer.select(
        c.cast("string").alias("id"), url.alias("canonical_url"), url.alias("normalized_url"), F.lit(None).cast("string").alias("source_url"), F.when(c % 40 == 3, "").otherwise(F.concat(F.lit("Story "), F.floor(c / 3))).alias("title"), F.when(c % 30 == 4, "").otherwise(F.col("c_mktsegment")).alias("content"),
        F.timestamp_add("DAY", -c.cast("int"), F.lit("2000-01-01").cast("timestamp")).alias("published_at"), F.lit("2000-01-01").cast("timestamp").alias("last_fetched_at"),
    )
    sold = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    links = sold.where("l_linenumber <= 2").select(F.col("o_custkey").cast("string").alias("article_id"), F.col("l_suppkey").cast("string").alias("source_id"), F.col("o_orderdate").alias("discovered_at"))
    kinds = {"fetched": F.col("l_linestatus") == "F", "stored": F.col("l_returnflag") == "R", "already_known": F.col("l_returnflag") == "A", "error_count": F.col("l_quantity") > 48}
    by_source = sold.groupBy(F.year("o_orderdate").cast("long").alias("run_id"), "l_suppkey").agg(F.count("*").alias("discovered"), *[F.count_if(x).alias(n) for n, x in kinds.items()])
    stats = by_source.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("publisher_id")), "l_suppkey").withColumn("source_id", F.col("l_suppkey").cast("string")).withColumn("status", F.when(F.col("error_count") > 0, "partial").otherwise("success")).withColumn("stop_reason", F.lit(None).cast("string"))
    results = t.nation.select((1996 + key % 2).cast("long").alias("run_id"), key.alias("id"), key.cast("string").alias("publisher_id"), pick(key % 4, None, "partial", "failed", "success").alias("status"), F.lit(None).cast("string").alias("source_status"), pick(key % 5, None, "dns", "robots", None, "config").alias("error_category"), (key * 10).alias("parsed"), key.alias("inserted"))
    return {"publishers": publishers, "sources": sources, "articles": articles, "links": links, "stats": stats, "results": results}


@query(f"""WITH {ROLES}, linked AS (SELECT publisher_id, source_id, article_id FROM links JOIN sources ON source_id = sources.id),
a AS (SELECT publisher_id, count(DISTINCT article_id) AS articles, count(*) AS pairs FROM linked GROUP BY 1), s AS (SELECT publisher_id, count(*) AS n, count(*) FILTER (WHERE status IS NOT NULL OR success IS NOT NULL) AS r FROM sources GROUP BY 1),
t AS (SELECT publisher_id, sum(discovered) AS d, sum(fetched) AS f, sum(stored) AS st, sum(already_known) AS k, sum(error_count) AS e FROM stats WHERE run_id = 1996 GROUP BY 1), z AS (SELECT * FROM results WHERE run_id = 1996)
SELECT p.id AS publisher_id, CAST(coalesce(n, 0) AS BIGINT) AS configured_sources, CAST(coalesce(r, 0) AS BIGINT) AS registered_sources, CAST(coalesce(articles, 0) AS BIGINT) AS articles, CAST(coalesce(pairs, 0) AS BIGINT) AS source_article_associations, CAST(coalesce(d, 0) AS BIGINT) AS discovered, CAST(coalesce(parsed, f, 0) AS BIGINT) AS parsed, CAST(coalesce(inserted, st, 0) AS BIGINT) AS inserted, CAST(coalesce(k, 0) AS BIGINT) AS already_known, CAST(coalesce(e, 0) AS BIGINT) AS errors
FROM publishers p LEFT JOIN a ON a.publisher_id = p.id LEFT JOIN s ON s.publisher_id = p.id LEFT JOIN t ON t.publisher_id = p.id LEFT JOIN z ON z.publisher_id = p.id""")
def report_publisher_counts(spark, d):
    """Counts of publishers in a run: sums of stats, over which a stored result goes."""
    r = roles(spark, d)
    x = reporting.publisher_counts(r["publishers"], r["sources"], r["links"], r["stats"].where("run_id = 1996"), r["results"].where("run_id = 1996"))
    return x.select("publisher_id", "configured_sources", "registered_sources", "articles", "source_article_associations", "discovered", "parsed", "inserted", "already_known", "errors")


_KIND = "CASE kind WHEN 'feed' THEN 'rss' WHEN 'html' THEN 'archive' WHEN 'api' THEN 'json_api' WHEN 'mystery' THEN 'unknown' ELSE kind END"


@query(f"""WITH {ROLES}, k AS (SELECT unnest(['rss', 'atom', 'sitemap', 'archive', 'json_api', 'custom_adapter', 'registry_only', 'unsupported', 'unknown']) AS kind), s AS (SELECT {_KIND} AS kind, count(*) AS configured, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE status IS NOT NULL OR success IS NOT NULL) AS registered, count(*) FILTER (WHERE coalesce(success, status = 'ok', false)) AS successful, count(*) FILTER (WHERE status IN ('failed', 'partial')) AS failed FROM sources GROUP BY 1),
a AS (SELECT {_KIND} AS kind, count(*) AS associations, count(DISTINCT article_id) AS unique_articles FROM links JOIN sources ON source_id = sources.id GROUP BY 1)
SELECT kind, coalesce(configured, 0) AS configured, coalesce(enabled, 0) AS enabled, coalesce(registered, 0) AS registered, coalesce(successful, 0) AS successful, coalesce(failed, 0) AS failed, coalesce(associations, 0) AS associations, coalesce(unique_articles, 0) AS unique_articles FROM k LEFT JOIN s USING (kind) LEFT JOIN a USING (kind)""")
def report_adapter_stats(spark, d):
    r = roles(spark, d)
    return reporting.adapter_stats(r["sources"], r["links"])


_FOUND = f"""WITH {ROLES}, c AS (SELECT *, count(*) OVER (PARTITION BY url) AS nu, count(*) OVER (PARTITION BY title) AS nt FROM articles), of AS (SELECT DISTINCT publisher_id, article_id FROM links JOIN sources ON source_id = sources.id),
f AS (SELECT publisher_id, article_id, unnest(list_filter([CASE WHEN url IS NULL THEN 'bad_url' END, CASE WHEN nt > 1 AND title <> '' THEN 'duplicate_title' END, CASE WHEN nu > 1 THEN 'duplicate_url' END, CASE WHEN content = '' THEN 'empty_content' END, CASE WHEN title = '' THEN 'empty_title' END,
  CASE WHEN coalesce(regexp_extract(url, '//([^/]*)', 1) <> regexp_extract(p.website_url, '//([^/]*)', 1), true) THEN 'non_official_host' END, CASE WHEN published_at < TIMESTAMP '2000-01-01' - to_days(365) THEN 'over_old' END], lambda x: x IS NOT NULL)) AS code FROM of JOIN c ON article_id = c.id LEFT JOIN publishers p ON p.id = publisher_id)"""


@query(f"{_FOUND} SELECT publisher_id, code, count(*) AS n FROM f GROUP BY 1, 2")
def report_article_findings(spark, d):
    """Quality findings of the articles of each publisher."""
    r = roles(spark, d)
    x = reporting.article_findings(r["articles"], r["links"], r["sources"], r["publishers"], F.lit("2000-01-01").cast("timestamp"))
    sources = r["sources"].select("publisher_id").distinct()
    return x.join(sources, "publisher_id", "left_semi").groupBy("publisher_id", "code").agg(F.count("*").alias("n"))


@query(f"""{_FOUND}, own AS (SELECT id AS publisher_id, 'missing_result' AS code FROM publishers WHERE enabled AND id NOT IN (SELECT publisher_id FROM results WHERE run_id = 1996) UNION SELECT publisher_id, 'source_error' FROM sources WHERE enabled AND status = 'failed')
SELECT code, count(*) AS n FROM (SELECT code FROM f UNION ALL SELECT code FROM own o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.publisher_id = o.publisher_id AND f.code = o.code)) GROUP BY 1""")
def report_quality(spark, d):
    """Findings of articles and of publishers, the latter only where they don't repeat the former."""
    r = roles(spark, d)
    of = reporting.article_findings(r["articles"], r["links"], r["sources"], r["publishers"], F.lit("2000-01-01").cast("timestamp"))
    own = reporting.publisher_findings(r["publishers"], r["sources"], r["links"], r["articles"], r["results"].where("run_id = 1996"))
    return reporting.quality_histogram(of, own)


@query(f"""WITH {ROLES}, f AS (SELECT CASE error_category WHEN 'dns' THEN 'dns_error' WHEN 'robots' THEN 'robots_disallowed' WHEN 'config' THEN 'configuration_error' ELSE 'failed' END AS class FROM results WHERE error_category IS NOT NULL OR status = 'failed')
SELECT class, count(*) AS n, class IN ('dns_error', 'robots_disallowed') AS external, class IN ('configuration_error', 'failed') AS blocking FROM f GROUP BY 1""")
def report_failures(spark, d):
    r = roles(spark, d)
    return reporting.failures(r["results"], r["stats"])


def _rosters(spark, d):
    """Two rosters of the same publishers: a whole one, and one with a repeated name and a member short of provenance."""
    p = roles(spark, d)["publishers"].withColumn("groups", F.array(F.lit("members"), F.concat(F.lit("g"), "n_regionkey")))
    n = p.agg(F.count("*").alias("all"))
    record = lambda extra: F.array(F.to_json(F.struct(F.lit("roster.md").alias("source"), F.lit("v1").alias("version"), F.repeat(F.lit("a"), F.lit(64)).alias("sha256"), extra.alias("expanded_count"))))
    p = p.join(F.broadcast(n), F.lit(True))  # one row
    whole = p.withColumn("name", F.col("slug")).withColumn("list_provenance", record(F.col("all")))
    broken = p.withColumn("list_provenance", F.when(F.col("id") != "3", record(F.col("all"))))
    return whole, broken


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_nationkey % 5 <> 0) AS e FROM nation)
SELECT n AS configured, e AS enabled, n AS configured_memberships, 2 * n AS group_memberships, true AS available, 'available' AS status, n AS expanded, 'roster.md' AS source, 'v1' AS version, repeat('a', 64) AS sha256 FROM n
UNION ALL SELECT n, e, n, 2 * n, false, 'invalid', NULL, NULL, NULL, NULL FROM n""")
def report_roster_scope(spark, d):
    """Whether a registry is a whole roster of one origin."""
    whole, broken = _rosters(spark, d)
    return reporting.roster_scope(whole).unionByName(reporting.roster_scope(broken))


@query(f"""{_FOUND}, u AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM articles WHERE url IS NOT NULL GROUP BY url))
SELECT * FROM (VALUES ('configuration_loaded', 'PASS'), ('publishers_projected', 'PASS'), ('supported_adapters', 'FAIL'), ('run_evidence', 'PASS'), ('source_coverage', 'FAIL'), ('one_result_each', 'FAIL'), ('registry_scope', 'PASS'), ('no_run_failures', 'FAIL'), ('safe_projection', 'PASS'), ('one_contract', 'PASS')) v(id, status)
UNION ALL SELECT 'article_quality', CASE WHEN count(*) FILTER (WHERE code IN ('bad_url', 'duplicate_url', 'empty_content', 'empty_title', 'non_official_host')) > 0 THEN 'FAIL' ELSE 'PASS' END FROM f UNION ALL SELECT 'url_safety', CASE WHEN count(*) FILTER (WHERE code IN ('bad_url', 'non_official_host')) > 0 THEN 'FAIL' ELSE 'PASS' END FROM f
UNION ALL SELECT 'deduplication', CASE WHEN coalesce(n, 0) > 0 THEN 'FAIL' ELSE 'PASS' END FROM u""")
def report_criteria(spark, d):
    """The thirteen criteria of acceptance."""
    r = roles(spark, d)
    now = F.lit("2000-01-01").cast("timestamp")
    results = r["results"].where("run_id = 1996")
    quality = reporting.quality_histogram(reporting.article_findings(r["articles"], r["links"], r["sources"], r["publishers"], now), reporting.publisher_findings(r["publishers"], r["sources"], r["links"], r["articles"], results))
    publishers = r["publishers"].withColumn("groups", F.array().cast("array<string>")).withColumn("list_provenance", F.array().cast("array<string>"))
    articles = r["articles"].withColumn("content_identity_key", F.lit(None).cast("string"))
    x = reporting.criteria(reporting.roster_scope(publishers), publishers, r["sources"], "1996", "completed", results, reporting.failures(results, r["stats"].where("run_id = 1996")), quality, articles, 25)
    return x.select("id", "status")


@query(f"""WITH {ROLES}, l AS (SELECT source_id, max((run_id, discovered, stored))[2] AS discovered, max((run_id, discovered, stored))[3] AS stored FROM stats GROUP BY 1)
SELECT s.id, s.publisher_id, p.name AS publisher_name, CASE WHEN {_KIND} <> 'unknown' THEN {_KIND} END AS kind, coalesce(s.enabled AND p.enabled, false) AS can_start, l.discovered, l.stored FROM sources s LEFT JOIN publishers p ON p.id = s.publisher_id LEFT JOIN l ON l.source_id = s.id""")
def console_source_list(spark, d):
    """Sources with publisher, latest stat and whether they can be started."""
    r = roles(spark, d)
    stats = r["stats"].withColumn("id", F.col("run_id")).withColumn("started_at", F.make_timestamp(F.col("run_id").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).withColumn("duplicate_candidate", F.lit(0))
    runs = stats.select(F.col("run_id").alias("id"), "started_at").distinct()
    return console.source_list(r["sources"], r["publishers"], stats, runs).select("id", "publisher_id", "publisher_name", "kind", "can_start", "discovered", "stored")


@query(f"""WITH {ROLES}, b AS (SELECT run_id, sum(discovered) AS discovered, sum(stored) AS inserted FROM stats WHERE publisher_id = '3' GROUP BY 1), a AS (SELECT run_id, inserted FROM results WHERE publisher_id = '3')
SELECT run_id, a.run_id IS NOT NULL AS from_result, CAST(CASE WHEN a.run_id IS NULL THEN b.discovered END AS BIGINT) AS discovered, CAST(CASE WHEN a.run_id IS NULL THEN b.inserted ELSE a.inserted END AS BIGINT) AS inserted FROM b FULL JOIN a USING (run_id)""")
def console_publisher_history(spark, d):
    """Each run of a publisher: its stored result, else the sum of its stats."""
    r = roles(spark, d)
    results = r["results"].withColumn("discovered", F.lit(None).cast("long")).withColumn("inserted", F.col("inserted").cast("long"))
    runs = r["stats"].select(F.col("run_id").alias("id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("stop_reason")).distinct()
    return console.publisher_history(r["stats"], results, runs, "3").select("run_id", "from_result", "discovered", "inserted")


@query(f"""WITH {ROLES}, l AS (SELECT CAST(o_custkey AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS source_id, o_orderdate AS seen FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 2)
SELECT article_id AS id, strftime(min(seen), '%Y-%m-%d') AS first_at, strftime(max(seen), '%Y-%m-%d') AS last_at, count(*) AS discoveries FROM l LEFT JOIN sources s ON s.id = source_id GROUP BY 1 HAVING bool_or(publisher_id = '3')""")
def console_article_list(spark, d):
    """Articles of one publisher with the bounds of all their discoveries."""
    r = roles(spark, d)
    x = console.article_list(r["articles"], r["links"].withColumn("last_discovered_at", F.lit(None).cast("timestamp")), r["sources"], publisher_id="3")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return x.select("id", day("first_discovered_at").alias("first_at"), day("last_discovered_at").alias("last_at"), "discoveries")


@query(f"""WITH {ROLES}, n AS (SELECT publisher_id, count(*) AS sources, count(*) FILTER (WHERE enabled) AS enabled_sources FROM sources GROUP BY 1) SELECT p.id AS publisher_id, coalesce(sources, 0) AS sources, coalesce(enabled_sources, 0) AS enabled_sources, r.run_id AS last_run_id, r.status AS last_status FROM publishers p LEFT JOIN n ON n.publisher_id = p.id LEFT JOIN results r ON r.publisher_id = p.id""")
def console_publisher_detail(spark, d):
    r = roles(spark, d)
    runs = r["results"].select(F.col("run_id").alias("id"), F.lit("1996-01-01").cast("timestamp").alias("started_at")).distinct()
    return console.publisher_detail(r["publishers"], r["sources"], r["results"], runs).select("publisher_id", "sources", "enabled_sources", "last_run_id", "last_status")


@query("""SELECT CAST(user_id AS VARCHAR) AS id, max((event_id, event_type))[2] AS status, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS heartbeat_at, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN max((event_id, props)) FILTER (WHERE event_type = 'view')[2] END AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id""".replace("max(ts)", "max((event_id, ts))[2]").replace("max((event_id, props)) FILTER (WHERE event_type = 'view')[2]", "(max((event_id, props)) FILTER (WHERE event_type = 'view'))[2]"))
def run_fold(spark, d):
    """Runs from their changes: the last value of each column that a change carries."""
    e = Tables(spark, d).events
    changes = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("ts").alias("heartbeat_at"), F.when(F.col("event_type") == "view", F.col("props")).alias("progress"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return console.fold_runs(changes).select("id", "status", F.date_format("heartbeat_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("heartbeat_at"), "progress")


@query("""WITH x AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS id, event_id % 3 = 0 AS t, event_id, event_type FROM events WHERE event_type = 'error')
SELECT id, (SELECT count(*) FROM x WHERE t OR event_id > 40) AS total FROM x WHERE t OR event_id > 40 ORDER BY t, CASE WHEN t THEN 0 ELSE event_id END, id LIMIT 30 OFFSET 5""")
def events_legacy_page(spark, d):
    """A page of events whose ids are numbers or texts: numbers first, by value."""
    e = Tables(spark, d).events.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string")).alias("id"), "event_type")
    return console.legacy_event_page(e, after="40", limit=30, offset=5, event_type="ERROR").select("id", "total")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS publisher_id, s_suppkey % 3 AS place, min(s_suppkey) AS id, count(*) - 1 AS donors FROM supplier GROUP BY 1, 2")
def consolidate_sources(spark, d):
    """One source for each publisher and URL; references to the others follow."""
    s = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("publisher_id"), (F.col("s_suppkey") % 3).cast("string").alias("normalized_url"), F.lit("n").alias("name"))
    kept, donors = consolidate.sources(s, ["publisher_id", "normalized_url", "name"])
    n = donors.groupBy(F.col("keeper").alias("id")).agg(F.count("*").alias("donors"))
    return kept.join(n, "id", "left").select("publisher_id", F.col("normalized_url").cast("long").alias("place"), "id", F.coalesce("donors", F.lit(0)).alias("donors"))


@query("SELECT CAST(l_orderkey % 500 AS VARCHAR) AS article_id, CAST(l_suppkey AS VARCHAR) AS source_id, CASE WHEN l_partkey % 2 = 0 THEN 'k' ELSE '' END AS discovered_key, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS discovered_at, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_at, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem GROUP BY 1, 2, 3")
def consolidate_discoveries(spark, d):
    x = Tables(spark, d).lineitem.select((F.col("l_orderkey") % 500).cast("string").alias("article_id"), F.col("l_suppkey").cast("string").alias("source_id"), F.when(F.col("l_partkey") % 2 == 0, "k").alias("discovered_key"), F.col("l_shipdate").alias("discovered_at"), F.lit(None).cast("timestamp").alias("last_discovered_at"), F.lit("u").alias("discovered_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return consolidate.discoveries(x).select("article_id", "source_id", "discovered_key", at("discovered_at").alias("discovered_at"), at("last_discovered_at").alias("last_at"), "id")


@query("SELECT l_orderkey // 4 AS run_id, CAST(l_suppkey AS VARCHAR) AS publisher_id, max((CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END, l_shipdate, -(l_orderkey * 10 + l_linenumber)))[3] * -1 AS id FROM lineitem GROUP BY 1, 2")
def consolidate_results(spark, d):
    """One result for each run and publisher: most evidence, then finished last, then least id."""
    x = Tables(spark, d).lineitem.select(F.floor(F.col("l_orderkey") / 4).alias("run_id"), F.col("l_suppkey").cast("string").alias("publisher_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("status"), F.when(F.col("l_tax") > 0.04, "e").alias("error"), F.col("l_shipdate").alias("finished_at"), F.lit(None).cast("timestamp").alias("started_at"))
    return consolidate.results(x, ["status", "error"]).select("run_id", "publisher_id", "id")


@query("SELECT 'run:' || user_id AS name, CAST(max((event_type <> 'error', ts, event_id))[3] AS VARCHAR) AS owner FROM events GROUP BY 1")
def consolidate_leases(spark, d):
    """One lease a name: with an owner before without, furthest expiry, latest heartbeat."""
    e = Tables(spark, d).events.select(F.concat(F.lit("run:"), "user_id").alias("name"), F.when(F.col("event_type") != "error", F.col("event_id")).cast("string").alias("owner"), F.col("event_id"), F.col("ts").alias("lease_until"))
    x = e.withColumn("heartbeat_at", F.col("event_id")).withColumn("owner", F.when(F.col("owner").isNull(), F.lit(None)).otherwise(F.col("owner")))
    return consolidate.leases(x).select("name", F.coalesce("owner", F.col("heartbeat_at").cast("string")).alias("owner"))


@query(f"""WITH {ROLES} SELECT 'no_enabled_source' AS code, id AS subject, NULL AS detail FROM publishers WHERE enabled AND id NOT IN (SELECT publisher_id FROM sources WHERE enabled)
UNION ALL SELECT 'unknown_publisher', id, publisher_id FROM sources WHERE publisher_id NOT IN (SELECT id FROM publishers)""")
def audit_registry(spark, d):
    r = roles(spark, d)
    return audit.registry_audit(r["publishers"], r["sources"])


@query(f"""WITH {ROLES}, n AS (SELECT source_id, count(*) AS n FROM stats WHERE run_id = 1996 AND discovered > 60 GROUP BY 1)
SELECT coalesce(s.id, n.source_id) AS subject, CASE WHEN s.id IS NULL THEN 'extra' ELSE 'missing' END AS detail FROM (SELECT id FROM sources WHERE enabled) s FULL JOIN n ON n.source_id = s.id WHERE s.id IS NULL OR n.n IS NULL""")
def audit_run_evidence(spark, d):
    """Sources without exactly one stat in a run, and stats of others."""
    r = roles(spark, d)
    stats = r["stats"].where("discovered > 60").withColumn("started_at", F.lit(None).cast("timestamp"))
    runs = stats.select(F.col("run_id").alias("id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at")).distinct()
    return audit.run_evidence_audit("1996", r["sources"], stats, runs).select("subject", "detail")


@query(f"""WITH {ROLES}, a AS (SELECT id, list_filter([CASE WHEN title = '' THEN 'no_title' END, CASE WHEN url IS NULL THEN 'no_url' END, CASE WHEN content = '' THEN 'no_content' END, CASE WHEN url IS NULL OR regexp_extract(url, '//([^/]*)', 1) NOT IN ('p1.example.org', 'p2.example.org') THEN 'not_official' END, CASE WHEN url IS NULL THEN 'root_page' END, CASE WHEN CAST(id AS INTEGER) % 9 = 0 THEN 'not_parsed' END], lambda x: x IS NOT NULL) AS reasons FROM articles)
SELECT array_to_string(list_sort(reasons), ',') AS reasons, count(*) AS n FROM a GROUP BY 1""")
def audit_articles(spark, d):
    """Reasons against articles, all at once."""
    a = roles(spark, d)["articles"].withColumn("parse_status", F.when(F.col("id").cast("int") % 9 == 0, "failed").otherwise("success")).withColumn("publisher", F.lit("p"))
    judged, _ = audit.article_audit(a, "publisher", F.array(F.lit("p1.example.org"), F.lit("p2.example.org")))
    return judged.groupBy(F.array_join(F.array_sort("reasons"), ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"""WITH {ROLES}, g AS (SELECT 'canonical_url' AS k, url AS v FROM articles UNION ALL SELECT 'normalized_url', url FROM articles) SELECT 'duplicate_' || k AS code, v AS subject, CAST(count(*) AS VARCHAR) AS detail FROM g WHERE v IS NOT NULL GROUP BY k, v HAVING count(*) > 1""")
def audit_duplicates(spark, d):
    """Groups of articles that identity should have made one."""
    a = roles(spark, d)["articles"].withColumn("content_identity_key", F.lit(None).cast("string")).withColumn("content_hash", F.lit(None).cast("string"))
    return audit.duplicate_audit(a)


@query("""WITH x AS (SELECT source AS p, sha256(text) AS k, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 3 = 0) AS b FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY 1, 2) SELECT p, count(*) FILTER (WHERE a) AS first, count(*) FILTER (WHERE b) AS second, count(*) FILTER (WHERE NOT a) AS new, count(*) FILTER (WHERE NOT b) AS lost FROM x GROUP BY 1""")
def audit_two_runs(spark, d):
    """Articles of two runs by publisher, new and lost."""
    x = Tables(spark, d).documents.select(F.col("source").alias("p"), "doc_id", texts.content_hash(F.col("text")).alias("k"))
    return audit.two_run_acceptance(x.where("doc_id % 2 = 0"), x.where("doc_id % 3 = 0"), "p", "k")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch(o_orderdate) + 34200 WHEN 1 THEN epoch(o_orderdate) + 34200 WHEN 2 THEN epoch(o_orderdate) ELSE CAST('-inf' AS DOUBLE) END AS score,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT09:30:00.000000Z') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT09:30:00.000000Z') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000000Z') WHEN 3 THEN 'soon' END AS stamp, o_orderkey % 5 = 0 AS strict FROM orders""")
def time_scores(spark, d):
    """Scores of times, their canonical form, and whether they state an offset; what is no time scores least.

    The texts state an order's day; what they say beyond it is added to the order's own time. An order without a day has a form, but neither score nor stamp.
    """
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    dated = F.coalesce((key % 5).between(0, 2), F.lit(False))
    day = F.coalesce(at.cast("date"), F.lit("1970-01-01").cast("date"))
    forms = F.array(F.date_format(day, "yyyy-MM-dd'T09:30:00Z'"), F.date_format(day, "yyyy-MM-dd '09:30:00'"), F.date_format(day, "yyyy-MM-dd"), F.lit(" soon "), F.lit(""))
    # By its parts, as the order's time has no zone and the session may have any.
    seconds = ((F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")) / 1e6
    x = Tables(spark, d).orders.select("o_orderkey", F.get(forms, (key % 5).cast("int")).alias("raw"), dated.alias("dated"), F.unix_date(day).cast("long").alias("day"), seconds.alias("seconds"))
    raw, dated, seconds = F.col("raw"), F.col("dated"), F.col("seconds")
    stamp = F.regexp_replace(dates.stamp(raw), r"^[+]", "")  # of years from 10000 on
    return x.select("o_orderkey", F.when(dated, seconds + (dates.score(raw) - F.col("day") * 86400)).otherwise(dates.score(raw)).alias("score"), F.when(~dated | seconds.isNotNull(), stamp).alias("stamp"), F.when(key.isNotNull(), dates.strict_timestamp(raw).isNotNull()).alias("strict"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'col' WHEN event_id % 3 = 1 THEN 'meta' END AS reason, CAST(CASE WHEN event_id % 4 = 0 THEN event_id WHEN event_id % 4 = 1 THEN 7 WHEN event_id % 4 = 2 THEN 2 ELSE 1 END AS BIGINT) AS images, CASE WHEN event_id % 2 = 0 THEN 'parse_error,timeout' ELSE 'timeout' END AS classes FROM events""")
def metadata_fallbacks(spark, d):
    """Stop reasons and image counts from columns or metadata, and errors added to a record once."""
    i = F.col("event_id")
    e = Tables(spark, d).events.select("event_id", F.when(i % 3 == 0, "col").otherwise("").alias("c"), F.when(i % 3 == 1, '{"termination_reason": "meta"}').alias("m"), F.when(i % 4 == 0, i).alias("stored"), F.when(i % 4 == 1, '{"image_count": 7, "images": ["a"]}').when(i % 4 == 2, '{"images": ["a", "b"]}').alias("im"), F.lit("https://e.org/i.png").alias("url"), F.when(i % 2 == 0, F.array(F.lit("parse_error"))).alias("had"))
    classes, _, _ = coerce.add_error(F.col("had"), F.array(F.lit("x")), F.lit("Timeout"), F.lit("x"))
    return e.select("event_id", coerce.stop_reason(F.col("c"), F.col("m")).alias("reason"), reporting.image_count(F.col("stored"), F.col("im"), F.col("url")).alias("images"), F.array_join(classes, ",").alias("classes"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'budget_hit' WHEN event_id % 7 = 0 THEN 'stale' WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'running' END AS status, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE 2.5 END AS poll, event_id % 4 = 0 AS busy FROM events""")
def service_statuses(spark, d):
    """Statuses as a service shows them, when to ask again, and which errors mean that a lease is held."""
    i = F.col("event_id")
    status = classify.service_status(F.lit("Running"), F.when(i % 5 == 0, "article-limit"), i % 7 == 0, i % 11 != 0)
    e = Tables(spark, d).events.select("event_id", status.alias("status"), F.when(i % 4 == 0, "LeaseBusyError").otherwise("RuntimeError").alias("kind"))
    return e.select("event_id", "status", classify.poll_hint(F.col("status"))["interval_seconds"].alias("poll"), classify.lease_busy(F.col("kind"), F.lit("x")).alias("busy"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'en' END AS tag, c_name || ' & b' AS cleaned, CASE WHEN c_custkey % 2 = 0 THEN 'request to https://e.org/' || c_custkey || ' failed: token=<redacted>' ELSE 'odd' END AS error,
  CASE WHEN c_custkey % 2 = 0 THEN '{"a": ' || c_custkey || '}' ELSE '{"html": "[html omitted]", "n": {"password": "[secret omitted]"}}' END AS metadata FROM customer""")
def stored_texts(spark, d):
    """Texts as they are stored: language tags, cleaned titles, errors without secrets, metadata without pages."""
    k, tag = F.col("c_custkey"), F.pandas_udf(lambda said: said.map(texts.language_tag), "string")
    error = F.when(k % 2 == 0, F.concat(F.lit("request to https://u:p@e.org/"), k.cast("string"), F.lit("?token=1 failed: token=abc"))).otherwise("odd")
    metadata = F.when(k % 2 == 0, F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))).otherwise('{"html": "<p>", "n": {"password": "x"}}')
    x = Tables(spark, d).customer.select("c_custkey", F.element_at(F.array(F.lit("DE_at"), F.lit("en"), F.lit("no tag")), (k % 3 + 1).cast("int")).alias("raw"), F.concat(F.lit(" "), "c_name", F.lit("&#32;&amp;  b ")).alias("title"), error.alias("e"), metadata.alias("m"))
    return x.select("c_custkey", tag("raw").alias("tag"), texts.clean_text("title").alias("cleaned"), texts.sanitize_error("e").alias("error"), texts.sanitize_metadata("m").alias("metadata"))


@query("SELECT s_nationkey, CAST(sum(greatest(CAST(floor(s_acctbal) AS BIGINT), 0)) AS BIGINT) AS total FROM supplier GROUP BY 1")
def clamped_totals(spark, d):
    """Sums of counts, negative ones as none."""
    return Tables(spark, d).supplier.groupBy("s_nationkey").agg(rollups.total(F.floor("s_acctbal")).alias("total"))


@query("""SELECT page_id, CASE WHEN url LIKE '%#%' THEN split_part(url, '#', 1) ELSE url END AS transport, regexp_extract(url, '^([^?#]*)', 1) AS target, url AS safe, 'see ' || url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=REDACTED now' AS told, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'source_id=s+' || page_id AS control, '/i' || page_id || '.png' AS picture, CASE WHEN page_id % 3 > 0 THEN url END AS usable FROM (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages)""")
def url_forms(spark, d):
    """URLs as they are fetched, shown in diagnostics, linked, controlled and redacted within a text; pictures of a set of sources."""
    p = Tables(spark, d).pages.select("page_id", F.regexp_replace("url", "#.*", "").alias("url"))
    u, mark = F.col("url"), F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    text = F.concat(F.lit("see "), F.regexp_replace(u, "://", "://me:pw@"), mark, F.lit("token=abc now"))
    bad = F.when(F.col("page_id") % 3 > 0, u).otherwise("http://[broken")
    return p.select(
        "page_id", urls.resolve_transport_url(F.lit("https://base.example.org/"), F.concat(u, F.lit("#top"))).alias("transport"), urls.url_target(u).alias("target"), urls.safe_link(u).alias("safe"), urls.redact_in_text(text).alias("told"),
        urls.control_link(u, F.concat(F.lit("s "), "page_id")).alias("control"), urls.first_srcset(F.concat(F.lit("/i"), "page_id", F.lit(".png 2x, /j.png 1x"))).alias("picture"), F.when(urls.normalize_url(bad).isNotNull(), u).alias("usable"),
    )


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 4 = 2 THEN 0 ELSE 1 END AS listed, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN 7 END AS first FROM events""")
def coercions(spark, d):
    """Flags from words, lists from JSON or a text, and the first of several columns that has a value."""
    i = F.col("event_id")
    word = F.element_at(F.array(*[F.lit(w) for w in (" Yes ", "off", "1", "disabled", "maybe")]), (i % 5 + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(w) for w in ('["a", "b"]', "plain", " ", "[broken")]), (i % 4 + 1).cast("int"))
    e = Tables(spark, d).events.select("event_id", word.alias("w"), text.alias("t"), F.when(i % 3 == 0, i).alias("count"), F.when(i % 3 == 1, F.lit(7).cast("long")).alias("counted"))
    return e.select("event_id", coerce.flag(F.col("w")).alias("flag"), F.size(coerce.json_list(F.col("t"))).alias("listed"), coerce.first_of(e, "missing", "COUNT", "counted").alias("first"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN lang || '-new' ELSE 'added' END AS lang, CASE WHEN doc_id % 4 <> 3 THEN source END AS kept FROM documents""")
def registry_upsert(spark, d):
    """Unspecified values keep the old ones, empty ones clear, some columns are never touched."""
    x = Tables(spark, d).documents
    old = x.where("doc_id % 4 <> 3").select("doc_id", "lang", F.col("source").alias("kept"))
    value = F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, F.concat("lang", F.lit("-new"))).when(F.col("doc_id") % 4 == 3, "added")
    return merges.partial_update(old, x.select("doc_id", value.alias("lang")), "doc_id", ["lang"], ["kept"])


@query("""WITH c AS (SELECT s_suppkey AS id, max((o_orderdate, o_orderkey, o_orderstatus))[3] AS status, max(o_orderdate) AS at, max(CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END) AS good FROM supplier JOIN orders ON o_custkey = s_suppkey GROUP BY 1)
SELECT s_suppkey AS id, coalesce(c.status, 'new') AS status, strftime(c.at, '%Y-%m-%d') AS last_checked, strftime(greatest(TIMESTAMP '1994-01-01', good), '%Y-%m-%d') AS last_success FROM supplier LEFT JOIN c ON c.id = s_suppkey""")
def source_checks(spark, d):
    """The latest check of each source; its last success moves with a success only."""
    t = Tables(spark, d)
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("new").alias("status"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("struct<at:timestamp,o:bigint>").alias("last_checked"), F.struct(F.lit("1994-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("o")).alias("last_success"))
    checks = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") != "F").alias("success"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("o")).alias("checked_at"))
    day = lambda c: F.date_format(F.col(f"{c}.at"), "yyyy-MM-dd").alias(c)
    return merges.source_status(old, checks, "id").select("id", "status", day("last_checked"), day("last_success"))


@query("""WITH k AS (SELECT doc_id AS id, 'u' || (doc_id % 7) AS u, 'n' || (doc_id % 11) AS n, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'u' || (doc_id % 14) END AS u, 'n' || (doc_id % 22) AS n, sha256(text) AS h FROM documents)
SELECT doc_id, coalesce((SELECT min(id) FROM k WHERE k.u = c.u), (SELECT min(id) FROM k WHERE k.n = c.n), (SELECT min(id) FROM k WHERE k.h = c.h)) AS article_id FROM c""")
def identity_lookups(spark, d):
    """Known articles of candidates: by canonical URL, else by normalised URL, else by content and title."""
    x = Tables(spark, d).documents.select("doc_id", texts.content_hash(F.col("text")).alias("content_identity_key"))
    i = F.col("doc_id")
    known = x.where("doc_id % 3 = 0").select(i.alias("article_id"), F.concat(F.lit("u"), i % 7).alias("canonical_url"), F.concat(F.lit("n"), i % 11).alias("normalized_url"), "content_identity_key")
    asked = x.select("doc_id", F.when(i % 2 == 0, F.concat(F.lit("u"), i % 14)).alias("canonical_url"), F.concat(F.lit("n"), i % 22).alias("normalized_url"), "content_identity_key")
    return identity.identity_lookup(asked, known).select("doc_id", "article_id")


@query(f"""WITH {ROLES} SELECT source_id AS id, CASE WHEN kind = 'mystery' THEN 'unsupported' WHEN n = 0 THEN 'source_not_found' WHEN n % 5 = 1 THEN 'blocked' WHEN n % 5 = 2 THEN 'http_error' ELSE 'success' END AS status FROM (SELECT id AS source_id, kind, CAST(id AS INTEGER) % 13 AS n FROM sources WHERE enabled)""")
def source_health(spark, d):
    """Status of each enabled source by its own document."""
    sources = roles(spark, d)["sources"]
    n = F.col("id").cast("int") % 13
    documents = sources.where(n > 0).select("url", F.when(n % 5 == 1, 403).when(n % 5 == 2, 503).otherwise(200).alias("status"))
    return ingest.source_health(sources, documents).select(F.col("source_id").alias("id"), "status")


@query("""SELECT page_id, CASE WHEN p LIKE '%.html' THEN 'excluded' WHEN page_id % 2 = 0 AND NOT contains(p, '/en/') THEN 'not_allowed' WHEN regexp_matches(p, '/9') THEN 'navigation' END AS reason FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def url_policy_by_source(spark, d):
    """The same ladder where each source has patterns of its own."""
    p = Tables(spark, d).pages.select("page_id", urls.normalize_url("url").alias("url"))
    some = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    even = F.col("page_id") % 2 == 0
    reason = candidates.policy_by(F.col("url"), F.array(urls.host(F.col("url"))), F.lit(None).cast("string"), some(), F.when(even, some("/en/")), some(r"\.html$"), some("/9"), even)
    return p.select("page_id", reason.alias("reason"))


@query("""SELECT run_id, discovered, stored, errors, CASE WHEN errors > 0 THEN 'source_failed' ELSE 'source_finished' END AS event FROM (SELECT o_orderpriority AS run_id, count(*) AS discovered, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS stored, count(*) FILTER (WHERE o_orderkey % 3 = 1 AND o_orderpriority = '1-URGENT') AS errors FROM orders GROUP BY 1)""")
def run_statistics(spark, d):
    """Statistics and events of sources from the fates of candidates and the outcomes of articles."""
    o = Tables(spark, d).orders.select(F.col("o_orderpriority").alias("source_id"), F.lit("p").alias("publisher_id"), F.lit("new").alias("fate"), "o_orderkey")
    key = F.col("o_orderkey") % 3
    outcomes = o.select("source_id", F.when(key == 0, "created").otherwise("unchanged").alias("outcome"), ((key == 1) & (F.col("source_id") == "1-URGENT")).alias("failed"))
    stats = ingest.run_stats(o, outcomes, "r")
    events = ingest.run_events(stats, "2025-01-01").select("source_id", F.col("event_type").alias("event"))
    return stats.join(events, "source_id").select(F.col("source_id").alias("run_id"), "discovered", "stored", F.col("error_count").alias("errors"), "event")
