"""Console queries. Roles: events are run events (a day is a run, a user a source), orders are runs, lineitem their stats,
suppliers sources, nations publishers, regions groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from broadsheet.functions import classify, coerce, dates
from broadsheet.operators import candidates, joins, latest, maintained, outbox, paging, rollups
from broadsheet.sources.scratch import scratch_dir

from .registry import Tables, query

TYPES = ["click", "error", "purchase", "signup", "view"]
DAY = "strftime(ts, '%Y-%m-%d')"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def day(at="ts"):
    return F.date_format(at, "yyyy-MM-dd")


def stamp(at):
    return F.date_format(at, STAMP)


@query("SELECT event_id, user_id, event_type, props FROM events WHERE lower(event_type) = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def events_filter_level(spark, d):
    """Filter by level whatever its case, in a range of time; both reach the scan."""
    t = Tables(spark, d)
    return t.events.where((F.lower("event_type") == "ERROR".lower()) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))).select("event_id", "user_id", "event_type", "props")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 4321 ORDER BY event_id LIMIT 50")
def events_keyset_page(spark, d):
    return paging.keyset_page(Tables(spark, d).events.select("event_id", "event_type", "user_id"), "event_id", 4321, 50)


@query("SELECT p.event_id, p.user_id, t.total FROM (SELECT count(*) AS total FROM events WHERE event_type = 'error') t LEFT JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20 OFFSET 40) p ON true")
def events_offset_page_total(spark, d):
    return paging.page_with_total(Tables(spark, d).events.where("event_type = 'error'").select("event_id", "user_id"), [F.desc("event_id")], 20, 40)


@query("SELECT p.event_id, p.user_id, t.total FROM (SELECT count(*) AS total FROM events WHERE event_type = 'error') t LEFT JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20 OFFSET 1000000) p ON true")
def events_empty_page_total(spark, d):
    """An empty page still tells the total."""
    return paging.page_with_total(Tables(spark, d).events.where("event_type = 'error'").select("event_id", "user_id"), [F.asc("event_id")], 20, 1_000_000)


@query("SELECT event_id, event_type, props FROM events WHERE contains(lower(concat_ws(' ', event_type, user_id, props)), 'signup 7')")
def events_search(spark, d):
    text = F.lower(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), "props"))
    return Tables(spark, d).events.where(F.contains(text, F.lit("signup 7"))).select("event_id", "event_type", "props")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25 OFFSET 50")
def events_page_number(spark, d):
    limit, offset = paging.page_offset(3, 25)
    return paging.offset_page(Tables(spark, d).events.select("event_id", "event_type"), [F.asc("event_id")], limit, offset)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN ('nation_3', 'nation_7'))")
def events_dimension_in(spark, d):
    """A token is looked up in the catalogues, then restricts the events by semi-join."""
    t = Tables(spark, d)
    ids = t.customer.join(t.nation.where(F.lower("n_name").isin("nation_3", "nation_7")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t.events.join(ids, F.col("user_id") == F.col("c_custkey"), "left_semi").select("event_id", "user_id")


def runs(t: Tables):
    return t.events.groupBy(day().alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("heartbeat_at"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))


RUNS = f"SELECT {DAY} AS run_id, min(ts) AS started_at, max(ts) AS finished_at, max(ts) FILTER (WHERE event_type = 'view') AS heartbeat_at, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1"


@query(f"WITH r AS ({RUNS}) SELECT run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at, CAST(round_even((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0, 0) AS BIGINT) AS duration_ms, strftime(greatest(started_at, finished_at, heartbeat_at), '%Y-%m-%d %H:%M:%S.%f') AS last_updated, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS place FROM r")
def run_list_newest(spark, d):
    """Runs, newest first."""
    from pyspark.sql import Window as W

    r = runs(Tables(spark, d))
    place = F.row_number().over(W.orderBy(F.col("started_at").desc_nulls_last(), F.desc("run_id")))  # one row a run
    return r.select("run_id", stamp("started_at").alias("started_at"), dates.duration_ms(F.col("started_at"), F.col("finished_at")).alias("duration_ms"), stamp(F.greatest("started_at", "finished_at", "heartbeat_at")).alias("last_updated"), place.cast("long").alias("place"))


KINDS = {"discovered": "view", "fetched": "click", "stored": "purchase", "known": "signup", "errors": "error"}
SUMMARY = f"""WITH s AS (
  SELECT {DAY} AS run_id, user_id % 10 AS publisher, user_id,
         count(*) FILTER (WHERE event_type = 'view') AS discovered, count(*) FILTER (WHERE event_type = 'click') AS fetched, count(*) FILTER (WHERE event_type = 'purchase') AS stored, count(*) FILTER (WHERE event_type = 'signup') AS known, count(*) FILTER (WHERE event_type = 'error') AS errors,
         bool_and(event_type <> 'error') AS done, min((ts, event_id, event_type)) FILTER (WHERE event_type IN ('error', 'purchase')) AS stop
  FROM events GROUP BY ALL),
p AS (SELECT run_id, publisher, sum(discovered) AS discovered, sum(fetched) AS fetched, sum(stored) AS stored, sum(known) AS known, sum(errors) AS errors, bool_and(done) AS all_done, count(*) FILTER (WHERE done) AS sources_done, count(*) AS sources, min(stop) AS stop FROM s GROUP BY ALL)
SELECT run_id, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(known) AS BIGINT) AS known, CAST(sum(errors) AS BIGINT) AS errors, count(*) AS publishers, CAST(sum(sources) AS BIGINT) AS sources,
       count(*) FILTER (WHERE all_done) AS publishers_completed, CAST(sum(sources_done) AS BIGINT) AS sources_completed, min(stop)[3] AS stop_reason
FROM p GROUP BY run_id"""


@query(SUMMARY)
def run_summary(spark, d):
    metrics = {name: F.when(F.col("event_type") == kind, 1) for name, kind in KINDS.items()}
    stats = Tables(spark, d).events.withColumn("run_id", day()).withColumn("publisher", F.col("user_id") % 10).withColumn("stop", F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")))
    return rollups.run_summary(stats, "run_id", metrics, "publisher", "user_id", F.col("event_type") != "error", "stop", [F.col("ts"), F.col("event_id")])


@query(SUMMARY)
def run_summary_maintained(spark, d):
    """The same summaries, kept under changes: a third of the events arrives late, every seventh is mended, and a run of false ones goes."""
    kind = F.col("event_type")
    events = Tables(spark, d).events.select(
        day().alias("run_id"), (F.col("user_id") % 10).alias("publisher_id"), F.col("user_id").alias("source_id"), F.col("event_id").alias("id"),
        *[F.when(kind == k, 1).alias(name) for name, k in KINDS.items()],
        (kind != "error").alias("completed"), F.when(kind.isin("error", "purchase"), kind).alias("stop_reason"), "ts",
    )
    late, mended = F.col("id") % 3 == 0, F.col("id") % 7 == 0
    wrong = events.where(mended & ~late).withColumn("discovered", F.lit(5)).withColumn("completed", F.lit(False)).withColumn("stop_reason", F.lit("wrong"))
    false = events.where(mended).withColumn("id", -1 - F.col("id")).withColumn("run_id", F.when(F.col("id") % 2 == 0, "none").otherwise(F.col("run_id")))
    kept = maintained.RunSummaries(spark, f"{scratch_dir(spark).rstrip('/')}/broadsheet-summaries-{uuid.uuid4().hex}", list(KINDS), {"ts": "timestamp"})
    kept.change(events.where(~mended & ~late).unionByName(wrong).unionByName(false))
    kept.change(events.where(mended | late), false)
    return kept.read()


@query(f"""WITH e AS (SELECT u.user_id, r.run_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0) u CROSS JOIN (SELECT DISTINCT {DAY} AS run_id FROM events) r),
g AS (SELECT user_id, {DAY} AS run_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, run_id, coalesce(n, 0) AS n, CASE WHEN e.user_id IS NULL THEN 'extra' WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'exactly_one' END AS state
FROM (SELECT *, 1 AS here FROM e) e FULL JOIN g USING (user_id, run_id)""".replace("CASE WHEN e.user_id IS NULL", "CASE WHEN here IS NULL"))
def run_coverage(spark, d):
    """Each enabled source is expected to have exactly one result in each run."""
    e = Tables(spark, d).events.withColumn("run_id", day())
    days = e.select("run_id").distinct().agg(F.array_sort(F.collect_set("run_id")).alias("days"))  # the runs of a report
    expected = e.where("user_id % 2 = 0").select("user_id").distinct().join(F.broadcast(days), F.lit(True)).select("user_id", F.explode("days").alias("run_id"))
    return joins.coverage(expected, e.where("event_type = 'purchase'"), ["user_id", "run_id"])


RAW = "CASE {x} % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'In-Progress' WHEN 4 THEN 'ok' WHEN 5 THEN NULL ELSE 'mystery' END"
STOP = "CASE {x} % 5 WHEN 0 THEN 'article_limit' WHEN 1 THEN 'http-error' WHEN 2 THEN 'exhausted' WHEN 3 THEN 'no_new_urls' ELSE NULL END"


def _states(t: Tables):
    o = t.orders
    return o.select("o_orderkey", F.expr(RAW.format(x="o_orderkey")).alias("raw"), F.expr(STOP.format(x="o_orderkey")).alias("stop"), (F.col("o_orderpriority") == "1-URGENT").alias("has_error"))


_TOKEN = "replace(replace(lower(trim(coalesce({x}, ''))), '-', '_'), ' ', '_')"


def _status_sql(budget):
    b = ", ".join(f"'{x}'" for x in budget)
    f = ", ".join(f"'{x}'" for x in classify.FAILURE_STOPS)
    return f"""SELECT o_orderkey, CASE
  WHEN raw IN ('running', 'active', 'in_progress', 'started', 'pending') THEN 'running' WHEN raw = 'stale' THEN 'stale'
  WHEN raw IN ('', 'unknown', 'not_recorded', 'not_observable') THEN CASE WHEN err OR stop IN ({f}) THEN 'warning' ELSE 'unknown' END
  WHEN raw IN ('failed', 'failure', 'error', 'aborted', 'cancelled', 'canceled', 'stopped') THEN 'failed' WHEN raw IN ('completed_with_errors', 'partial', 'warning') THEN 'warning' WHEN raw = 'budget_hit' THEN 'budget_hit'
  WHEN err OR stop IN ({f}) THEN 'warning' WHEN stop IN ({b}) THEN 'budget_hit'
  WHEN raw IN ('completed', 'complete', 'finished', 'success', 'succeeded', 'success_no_items', 'ok', 'done') THEN 'success' ELSE 'unknown' END AS status
FROM (SELECT o_orderkey, {_TOKEN.format(x="raw")} AS raw, {_TOKEN.format(x="stop")} AS stop, err FROM (SELECT o_orderkey, {RAW.format(x="o_orderkey")} AS raw, {STOP.format(x="o_orderkey")} AS stop, o_orderpriority = '1-URGENT' AS err FROM orders))"""


@query(_status_sql(classify.BUDGET_STOPS))
def run_status_classified(spark, d):
    return _states(Tables(spark, d)).select("o_orderkey", classify.display_status(F.col("raw"), F.col("has_error"), F.col("stop")).alias("status"))


@query(f"SELECT status, label, count(*) AS n FROM (SELECT status, CASE status WHEN 'running' THEN 'Running' WHEN 'stale' THEN 'Stale' WHEN 'success' THEN 'Success' WHEN 'warning' THEN 'Warning' WHEN 'failed' THEN 'Failed' WHEN 'budget_hit' THEN 'Budget Hit' ELSE 'Unknown' END AS label FROM ({_status_sql(classify.SERVICE_BUDGET_STOPS)})) GROUP BY ALL")
def status_labels(spark, d):
    """Labels of statuses, where the service counts one more stop reason as a budget."""
    s = _states(Tables(spark, d)).select(classify.display_status(F.col("raw"), F.col("has_error"), F.col("stop"), classify.SERVICE_BUDGET_STOPS).alias("status"))
    return s.groupBy("status", classify.status_label(F.col("status")).alias("label")).agg(F.count("*").alias("n"))


NOW = "2024-01-20 12:00:00"


def _live(t: Tables):
    r = t.events.groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("bought"), F.min("ts").alias("started"))
    r = r.where("started < timestamp '2024-01-20 12:00:00'")
    raw = F.when(F.col("user_id") % 4 == 0, "completed").when(F.col("user_id") % 4 == 1, "running").when(F.col("user_id") % 4 == 2, "active").otherwise("odd")
    beat = F.when(F.col("user_id") % 5 != 0, F.least("heartbeat", F.lit(NOW).cast("timestamp") - F.expr("make_interval(0, 0, 0, 0, 0, user_id % 10, 0)")))
    lease = F.when(F.col("user_id") % 3 == 0, F.col("bought"))
    status = F.when(F.col("user_id") % 11 == 0, "released")
    return r.select("user_id", "started", raw.alias("raw"), beat.alias("beat"), lease.alias("lease_until"), status.alias("lease_status"))


_LIVE = f"""l AS (SELECT user_id, started, CASE user_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' WHEN 2 THEN 'active' ELSE 'odd' END AS raw,
  CASE WHEN user_id % 5 <> 0 THEN least(heartbeat, TIMESTAMP '{NOW}' - to_minutes(CAST(user_id % 10 AS INTEGER))) END AS beat, CASE WHEN user_id % 3 = 0 THEN bought END AS lease_until, CASE WHEN user_id % 11 = 0 THEN 'released' END AS lease_status
  FROM (SELECT user_id, max(ts) AS heartbeat, max(ts) FILTER (WHERE event_type = 'purchase') AS bought, min(ts) AS started FROM events GROUP BY user_id) WHERE started < TIMESTAMP '{NOW}'),
s AS (SELECT *, CASE WHEN raw = 'completed' THEN 'terminal_state' WHEN raw NOT IN ('running', 'active') THEN 'unrecognized_run_status' WHEN beat IS NULL AND lease_until IS NULL THEN 'no_liveness_evidence' WHEN lease_status = 'released' THEN 'lease_inactive'
  WHEN lease_until <= TIMESTAMP '{NOW}' THEN 'lease_expired' WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(beat)) / 1e6 >= 300 THEN 'heartbeat_expired' WHEN beat IS NOT NULL THEN 'heartbeat_fresh' ELSE 'lease_fresh' END AS reason FROM l),
v AS (SELECT *, CASE WHEN reason = 'terminal_state' THEN 'terminal' WHEN reason IN ('unrecognized_run_status', 'no_liveness_evidence') THEN 'unknown' WHEN reason IN ('lease_inactive', 'lease_expired', 'heartbeat_expired') THEN 'stale' ELSE 'running' END AS state FROM s)"""


def _liveness(t: Tables):
    r = _live(t)
    state, reason = classify.liveness(F.col("raw"), F.lit(None).cast("timestamp"), F.col("beat"), F.col("lease_until"), F.col("lease_status"), F.lit(NOW).cast("timestamp"))
    return r.withColumn("state", state).withColumn("reason", reason)


@query(f"WITH {_LIVE} SELECT user_id, state, reason FROM v")
def run_liveness(spark, d):
    return _liveness(Tables(spark, d)).select("user_id", "state", "reason")


@query(f"WITH {_LIVE} SELECT user_id, state FROM v ORDER BY CASE state WHEN 'running' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END, started DESC, user_id DESC LIMIT 1")
def current_run_pick(spark, d):
    return latest.current_run(_liveness(Tables(spark, d)), "state", "started", "user_id").select("user_id", "state")


@query(f"""WITH r AS (SELECT {DAY} AS run_id, max(ts) AS last_ts FROM events GROUP BY 1), p AS (SELECT run_id, row_number() OVER (ORDER BY last_ts DESC) AS place FROM r),
m AS (SELECT place, event_type AS metric, count(*) AS n FROM events JOIN p ON p.run_id = {DAY} WHERE place <= 2 GROUP BY ALL)
SELECT metric, CAST(coalesce(sum(n) FILTER (WHERE place = 1), 0) AS BIGINT) AS latest, CAST(coalesce(sum(n) FILTER (WHERE place = 2), 0) AS BIGINT) AS previous, CAST(coalesce(sum(n) FILTER (WHERE place = 1), 0) - coalesce(sum(n) FILTER (WHERE place = 2), 0) AS BIGINT) AS change FROM m GROUP BY metric""")
def relative_change(spark, d):
    e = Tables(spark, d).events.withColumn("run_id", day())
    two = latest.latest_two(e.groupBy("run_id").agg(F.max("ts").alias("at")), [F.desc("at")])
    marked = e.join(F.broadcast(two), "run_id").select("place", *[F.when(F.col("event_type") == x, 1).otherwise(0).alias(x) for x in TYPES])
    return rollups.relative_change(marked.where("place = 1"), marked.where("place = 2"), TYPES)


@query("""WITH a AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS kind FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 9 <> 0 GROUP BY 1)
SELECT user_id, a.kind AS before, b.kind AS after, CASE WHEN a.kind IS NULL THEN 'added' WHEN b.kind IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (user_id) WHERE a.kind IS DISTINCT FROM b.kind""")
def kind_changes(spark, d):
    e, half = Tables(spark, d).events, F.lit("2024-01-15").cast("timestamp")
    kind = lambda x: latest.best_value(x, ["user_id"], F.col("event_type"), F.struct("ts", "event_id"), "kind")
    return joins.set_changes(kind(e.where(F.col("ts") < half)), kind(e.where((F.col("ts") >= half) & (F.col("user_id") % 9 != 0))), ["user_id"], "kind")


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {DAY} DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_stat_per_source(spark, d):
    return latest.top_per_key(Tables(spark, d).events, ["user_id"], [day().desc(), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH x AS (SELECT n_name, o_orderdate, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_name, strftime(o_orderdate, '%Y-%m-%d') AS run_date, orders, cents FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC) AS r FROM x) WHERE r = 1""")
def latest_run_per_publisher(spark, d):
    t = Tables(spark, d)
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.groupBy("n_name", "o_orderdate").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return latest.top_per_key(x, ["n_name"], [F.desc("o_orderdate")]).select("n_name", day("o_orderdate").alias("run_date"), "orders", "cents")


@query("SELECT l_suppkey, max((l_shipdate, l_partkey, l_orderkey))[2] AS l_partkey, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")
def latest_article_per_source(spark, d):
    x = Tables(spark, d).lineitem.where("l_shipdate is not null")
    return x.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey", "l_orderkey")).alias("l_partkey"), day(F.max("l_shipdate")).alias("latest"))


@query("SELECT n_name, o_orderkey, CAST(r AS BIGINT) AS place FROM (SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 3")
def top3_recent_per_publisher(spark, d):
    t = Tables(spark, d)
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return latest.top_per_key(x, ["n_name"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "place").select("n_name", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, min((o_orderdate, o_orderkey))[2] AS o_orderkey FROM orders GROUP BY 1")
def first_row_per_key(spark, d):
    return latest.top_per_key(Tables(spark, d).orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, max_by(p, (w, p)) AS reason FROM (SELECT o_custkey, o_orderpriority AS p, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 4 ELSE 0 END AS w FROM orders) GROUP BY 1")
def stop_reason_priority(spark, d):
    return latest.priority_value(Tables(spark, d).orders, ["o_custkey"], "o_orderpriority", {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 4}, "reason")


@query("""WITH a AS (SELECT o_orderkey AS run_id, 1 AS stored, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT l_orderkey AS run_id, CAST(count(*) AS INTEGER) AS stored, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem GROUP BY 1)
SELECT run_id, CASE WHEN a.stored IS NOT NULL THEN a.stored ELSE b.stored END AS stored, CASE WHEN a.stored IS NOT NULL THEN a.amount ELSE b.amount END AS amount, a.stored IS NOT NULL AS from_result FROM a FULL JOIN b USING (run_id)""")
def results_full_outer(spark, d):
    """Stored results win over what the stats add up to."""
    t = Tables(spark, d)
    a = t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), F.lit(1).alias("stored"), F.round("o_totalprice").cast("long").alias("amount"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").cast("int").alias("stored"), F.sum(F.col("l_quantity").cast("long")).alias("amount"))
    return joins.prefer(a, b, ["run_id"])


@query("""SELECT l_suppkey, coalesce(n_name, 'unknown') AS publisher, coalesce(r_name, 'none') AS grp, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 <> 0 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def source_results_enriched(spark, d):
    """Stats by source, enriched from catalogues after the aggregate, so few rows are joined."""
    t = Tables(spark, d)
    stats = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    s = joins.enrich(stats.withColumn("s_suppkey", F.col("l_suppkey")), t.supplier.where("s_suppkey % 7 <> 0"), "s_suppkey", {"s_nationkey": "n_nationkey"})
    s = joins.enrich(s, t.nation, "n_nationkey", {"n_name": "publisher", "n_regionkey": "r_regionkey"})
    s = joins.enrich(s, t.region, "r_regionkey", {"r_name": "grp"})
    return s.select("l_suppkey", F.coalesce("publisher", F.lit("unknown")).alias("publisher"), F.coalesce("grp", F.lit("none")).alias("grp"), "n", "quantity")


@query("SELECT p_partkey, l_orderkey, s_name, n_name FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE p_size = 7")
def article_rows_left_chain(spark, d):
    t = Tables(spark, d)
    x = t.part.where("p_size = 7").join(t.lineitem.where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left")
    x = x.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.select("p_partkey", "l_orderkey", "s_name", "n_name")


def _chain(t: Tables):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))


@query("SELECT DISTINCT n_name, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def canonical_sets(spark, d):
    return _chain(Tables(spark, d)).select("n_name", "l_partkey").distinct()


@query("SELECT n_name, count(DISTINCT l_partkey) AS articles FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def publisher_article_counts(spark, d):
    return _chain(Tables(spark, d)).groupBy("n_name").agg(F.countDistinct("l_partkey").alias("articles"))


@query("SELECT DISTINCT l_partkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND s_acctbal > 0 AND p_name <> ''")
def live_articles(spark, d):
    t = Tables(spark, d)
    x = _chain(t).where("l_returnflag = 'R' and s_acctbal > 0").join(t.part.where("p_name <> ''"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select("l_partkey", "n_name").distinct()


@query("SELECT p_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS sources, strftime(min(l_shipdate), '%Y-%m-%d') AS first_at, strftime(max(l_shipdate), '%Y-%m-%d') AS last_at FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def article_read_model(spark, d):
    """An article with all its sources and its first and last discovery."""
    t = Tables(spark, d)
    x = t.part.select("p_partkey").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey"))
    return x.groupBy("p_partkey").agg(rollups.joined_values(F.col("l_suppkey").cast("string"), ",").alias("sources"), day(F.min("l_shipdate")).alias("first_at"), day(F.max("l_shipdate")).alias("last_at"))


@query("SELECT l_orderkey, l_partkey, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS publishers, bool_or(l_returnflag = 'R') AS stored, strftime(max(greatest(l_shipdate, o_orderdate)), '%Y-%m-%d') AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 1, 2 HAVING bool_or(l_returnflag IN ('R', 'A'))")
def run_articles(spark, d):
    """Articles of a run whose outcomes match any of a list, with all their publishers."""
    t = Tables(spark, d)
    x = _chain(t).join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = x.groupBy("l_orderkey", "l_partkey").agg(rollups.joined_values(F.col("n_name")).alias("publishers"), F.bool_or(F.col("l_returnflag") == "R").alias("stored"), day(F.max(F.greatest("l_shipdate", "o_orderdate"))).alias("at"), F.bool_or(F.col("l_returnflag").isin("R", "A")).alias("_any"))
    return g.where("_any").drop("_any")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 100 END AS k, CASE WHEN c_custkey % 2 = 0 THEN 'supplier#' || lpad(CAST(c_custkey % 90 AS VARCHAR), 9, '0') END AS nm FROM customer),
m AS (SELECT c_custkey, s_suppkey, 0 AS place FROM c JOIN supplier ON k = s_suppkey UNION ALL SELECT c_custkey, s_suppkey, 1 FROM c JOIN supplier ON nm = lower(s_name))
SELECT c_custkey, min((place, s_suppkey))[2] AS s_suppkey, min((place, s_suppkey))[1] AS place FROM m GROUP BY 1""")
def any_key_match(spark, d):
    t = Tables(spark, d)
    c = t.customer.select("c_custkey", F.expr("case when c_custkey % 3 = 0 then c_custkey % 100 end").alias("k"), F.expr("case when c_custkey % 2 = 0 then 'supplier#' || lpad(cast(c_custkey % 90 as string), 9, '0') end").alias("nm"))
    return joins.any_key_match(c, t.supplier, "c_custkey", "s_suppkey", [(F.col("k"), F.col("s_suppkey")), (F.col("nm"), F.lower("s_name"))])


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 50 END AS k FROM orders), b AS (SELECT CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 50 END AS k, count(*) AS sources FROM supplier GROUP BY 1)
SELECT o_orderkey, a.k, sources FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_key_join(spark, d):
    t = Tables(spark, d)
    a = t.orders.select("o_orderkey", F.expr("case when o_orderkey % 4 <> 0 then o_custkey % 50 end").alias("k"))
    b = t.supplier.groupBy(F.expr("case when s_suppkey % 10 <> 0 then s_suppkey % 50 end").alias("k")).agg(F.count("*").alias("sources"))
    return joins.null_safe_join(a, b, ["k"])


@query("SELECT 'run_without_stats' AS finding, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'source_without_runs', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_semi_audit(spark, d):
    t = Tables(spark, d)
    a = joins.missing(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.select(F.col("l_orderkey").alias("id")), ["id"]).withColumn("finding", F.lit("run_without_stats"))
    b = joins.missing(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id")), ["id"]).withColumn("finding", F.lit("source_without_runs"))
    return a.unionByName(b).select("finding", "id")


@query("SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_shipdate >= o_orderdate - INTERVAL 1 SECOND AND l_shipdate <= o_orderdate + INTERVAL 30 DAY + INTERVAL 1 SECOND) AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def interval_evidence(spark, d):
    t = Tables(spark, d)
    w = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    return joins.within(t.lineitem, w, "l_orderkey", "l_shipdate", "start", "end").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if("inside").alias("inside"))


@query("WITH v AS (SELECT unnest(['rss', 'atom', 'sitemap', 'archive', 'json_api', 'custom_adapter', 'registry_only', 'unsupported']) AS kind), k AS (SELECT l_suppkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'atom' WHEN 'N' THEN 'archive' ELSE 'rss' END AS kind FROM lineitem) SELECT kind, count(l_partkey) AS associations, count(DISTINCT l_partkey) AS articles, count(DISTINCT l_suppkey) AS sources FROM v LEFT JOIN k USING (kind) GROUP BY 1")
def adapter_rollup(spark, d):
    """Counts for every kind of source, none left out; kinds come from several spellings."""
    raw = F.when(F.col("l_returnflag") == "A", "Atom Feed").when(F.col("l_returnflag") == "N", "html-list").otherwise("feed")
    x = Tables(spark, d).lineitem.select("l_suppkey", "l_partkey", candidates.canonical_kind(raw).alias("kind"))
    # Two aggregates by pair in place of two distinct counts, which would expand every row.
    by_article = x.groupBy("kind", "l_partkey").agg(F.count("*").alias("n"))
    by_source = x.select("kind", "l_suppkey").distinct().groupBy("kind").agg(F.count("*").alias("sources"))
    counted = rollups.zero_filled(by_article, "kind", list(candidates.KINDS), {"associations": F.sum("n"), "articles": F.count("*")})
    return counted.join(by_source, "kind", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


_CATEGORY = "CASE o_orderkey % 9 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'robots' WHEN 2 THEN 'js-required' WHEN 3 THEN 'unsupported kind' WHEN 4 THEN 'date parse error' WHEN 5 THEN 'blocked by host' ELSE NULL END"
_RESULT = "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'completed_with_errors' ELSE 'no items' END"


@query(f"""WITH c AS (SELECT CASE WHEN cat LIKE '%404%' THEN 'source_not_found' WHEN cat = 'robots' THEN 'robots_disallowed' WHEN cat = 'js_required' THEN 'javascript_required' WHEN cat LIKE '%unsupported%' THEN 'unsupported' WHEN cat LIKE '%parse%' THEN 'parse_error' WHEN cat LIKE '%blocked%' THEN 'blocked'
  WHEN st = 'no_items' THEN 'success_no_items' WHEN st = 'completed_with_errors' THEN 'partial' ELSE 'success' END AS category FROM (SELECT {_TOKEN.format(x=_CATEGORY)} AS cat, {_TOKEN.format(x=_RESULT)} AS st FROM orders)),
p AS (SELECT CASE category WHEN 'success' THEN 'SUPPORTED' WHEN 'success_no_items' THEN 'SUPPORTED_NO_CURRENT_NEWS' WHEN 'partial' THEN 'PARTIALLY_SUPPORTED' WHEN 'parse_error' THEN 'FAILED' ELSE upper(category) END AS public FROM c)
SELECT v.public, count(p.public) AS n FROM (SELECT unnest(['SUPPORTED', 'SUPPORTED_NO_CURRENT_NEWS', 'PARTIALLY_SUPPORTED', 'SOURCE_NOT_FOUND', 'ROBOTS_DISALLOWED', 'JAVASCRIPT_REQUIRED', 'BLOCKED', 'UNSUPPORTED', 'FAILED']) AS public) v LEFT JOIN p ON v.public = p.public GROUP BY 1""")
def zero_filled_histogram(spark, d):
    o = Tables(spark, d).orders.select(classify.public_class(classify.completion(F.expr(_CATEGORY), F.lit(None).cast("string"), F.expr(_RESULT))).alias("public"))
    return rollups.zero_filled(o, "public", list(dict.fromkeys(classify.PUBLIC.values())), {"n": F.count("*")})


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS good FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS results, count(*) AS publishers, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS excess, round(CAST(sum(good) AS BIGINT) * 100.0::DOUBLE / CAST(sum(n) AS BIGINT), 2) AS percent_good FROM g""")
def coverage_percent(spark, d):
    g = Tables(spark, d).orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("good"))
    return g.agg(F.sum("n").alias("results"), F.count("*").alias("publishers"), F.sum(rollups.excess(F.col("n"))).alias("excess"), rollups.percent(F.sum("good"), F.sum("n")).alias("percent_good"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT props, count(*) FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    e = Tables(spark, d).events
    return rollups.duplicate_groups(e, F.col("event_type")).unionByName(rollups.duplicate_groups(e, F.col("props")))


@query("SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS date FROM events WHERE event_id < 500 GROUP BY 1 HAVING count(*) >= 3 AND min(CAST(ts AS DATE)) = max(CAST(ts AS DATE))")
def same_date_anomaly(spark, d):
    """Sources of the first events that have at least three of them, all on one date."""
    found = rollups.same_date(Tables(spark, d).events.where("event_id < 500"), "user_id", F.col("ts"))
    return found.withColumn("date", day("date"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS statuses FROM orders GROUP BY 1")
def status_string_agg(spark, d):
    return Tables(spark, d).orders.groupBy("o_custkey").agg(rollups.joined_values(F.col("o_orderpriority")).alias("statuses"))


@query(f"WITH a AS (SELECT strftime(ts, '%Y-%m') AS batch, {DAY} AS run_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT batch, run_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS kinds, CAST(sum(n) AS BIGINT) AS events FROM a GROUP BY 1, 2")
def batch_run_rollup(spark, d):
    """Batch, run and kind, nested from the inside out so that each level is one partial aggregate."""
    a = Tables(spark, d).events.groupBy(F.date_format("ts", "yyyy-MM").alias("batch"), day().alias("run_id"), "event_type").agg(F.count("*").alias("n"))
    kinds = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    g = a.groupBy("batch", "run_id").agg(kinds.alias("k"), F.sum("n").alias("events"))
    return g.select("batch", "run_id", F.array_join(F.transform("k", lambda x: F.concat_ws("=", x["event_type"], x["n"].cast("string"))), " ").alias("kinds"), "events")


@query("""SELECT user_id, CAST(sum(CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS optional, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END) AS BIGINT) AS total,
  CAST(sum(greatest(CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END)) AS BIGINT) AS errors FROM events GROUP BY 1""")
def optional_metric(spark, d):
    """A metric that no row has stays null, a count is 0; errors are the larger of count and evidence."""
    k = F.when(F.col("user_id") % 3 != 0, coerce.safe_int(coerce.json_field(F.col("props"), "$.k")))
    errors = coerce.error_count(F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 3), F.when(F.col("event_id") % 4 == 0, '["a","b"]'), F.when(F.col("event_type") == "error", "failed"))
    return Tables(spark, d).events.groupBy("user_id").agg(rollups.optional_total(k).alias("optional"), rollups.total(k).alias("total"), F.sum(errors).cast("long").alias("errors"))


@query("""WITH c AS (SELECT 'all_have_customers' AS name, CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status UNION ALL SELECT 'unique_runs', CASE WHEN (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) = 0 THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'all_have_stats', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0 THEN 'PASS' ELSE 'FAIL' END)
SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c""")
def acceptance_checks(spark, d):
    t = Tables(spark, d)
    lost = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    twice = t.orders.groupBy("o_orderkey").agg(F.count("*").alias("n")).where("n > 1")
    bare = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    check = lambda name, df: df.agg(F.lit(name).alias("name"), F.when(F.count("*") == 0, "PASS").otherwise("FAIL").alias("status"))
    return rollups.verdict(check("all_have_customers", lost).unionByName(check("unique_runs", twice)).unionByName(check("all_have_stats", bare)))


@query("SELECT CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'exactly_one' ELSE 'duplicate' END AS state, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1) GROUP BY 1")
def exactly_one_result(spark, d):
    t = Tables(spark, d)
    c = joins.coverage(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])
    return c.groupBy("state").agg(F.count("*").alias("customers"))


@query("SELECT CASE WHEN b > 20 THEN 'FAILED' WHEN b > 10 THEN 'WARNING' WHEN b > 0 AND s > 3 THEN 'WARNING' WHEN n = 0 THEN 'NEVER CRAWLED' ELSE 'HEALTHY' END AS panel, n_name FROM (SELECT n_name, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS b, count(DISTINCT c_custkey) % 5 AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def dashboard_panels(spark, d):
    t = Tables(spark, d)
    x = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    g = x.groupBy("n_name").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("b"), (F.countDistinct("c_custkey") % 5).alias("s"))
    raw = F.when(F.col("n") == 0, None).when(F.col("b") > 20, "failed").otherwise("completed")
    return g.select("n_name", classify.panel_status(raw, F.when(F.col("b") > 10, F.col("b")).otherwise(0), F.when(F.col("s") > 3, F.col("b")).otherwise(0)).alias("panel"))


@query("""WITH x AS (SELECT s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'partial' WHEN 2 THEN 'ok' WHEN 3 THEN 'no_data' ELSE 'missing_result' END AS status, s_suppkey % 4 AS warnings FROM supplier)
SELECT name, CAST(row_number() OVER (ORDER BY CASE WHEN status IN ('error', 'missing_result') THEN 0 WHEN status IN ('partial', 'no_data') THEN 1 ELSE 2 END, -warnings, lower(name)) AS BIGINT) AS place FROM x""")
def publisher_priority_order(spark, d):
    from pyspark.sql import Window as W

    status = F.element_at(F.array(*[F.lit(x) for x in ("error", "partial", "ok", "no_data", "missing_result")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    x = Tables(spark, d).supplier.select(F.col("s_name").alias("name"), status.alias("status"), (F.col("s_suppkey") % 4).alias("warnings"))
    order = W.orderBy(classify.severity(F.col("status")), -F.col("warnings"), F.lower("name"))  # the publishers of a report
    return x.select("name", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id % 2 DESC, {DAY}, event_id) AS id FROM events)
SELECT sink, event_id, id FROM e, (SELECT unnest(['first', 'second']) AS sink)""")
def events_outbox(spark, d):
    """What two sinks have of the events of two batches, of which one comes twice, where one sink fails at first."""
    events = Tables(spark, d).events.select(day().alias("run_id"), F.col("event_id").alias("arrival"))
    folder = f"{scratch_dir(spark).rstrip('/')}/broadsheet-outbox-{uuid.uuid4().hex}"
    box, keep = outbox.Outbox(spark, f"{folder}/log", {"run_id": "string", "arrival": "bigint"}), {s: outbox.filed(f"{folder}/{s}") for s in ("first", "second")}

    def failing(rows, after, until):
        keep["second"](rows, after, until)
        raise OSError("the sink is full")

    for rest, batch in ((1, "odd"), (0, "even"), (1, "odd")):
        box.append(events.where(F.col("arrival") % 2 == rest), ["run_id", "arrival"], batch)
        box.deliver_all(keep | {"second": failing} if batch == "odd" else keep)
    box.deliver_all(keep)
    of = lambda sink: spark.read.parquet(f"{folder}/{sink}").select(F.lit(sink).alias("sink"), F.col("arrival").alias("event_id"), "id")
    return of("first").unionByName(of("second"))
