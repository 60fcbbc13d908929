import pytest
from pyspark.sql import functions as F

from broadsheet.operators import audit, console
from broadsheet.sources.store import logical

rows = lambda *a: pytest.rows(*a)


@pytest.fixture(scope="module")
def t(spark):
    make = lambda name, data, cols: logical(spark.createDataFrame(data, cols), name)
    return {
        "publishers": make("publishers", [("p1", "alpha", "Alpha", True, ["North"], None), ("p2", "beta", "Beta", True, [], "not_found"), ("p3", "off", "Off", False, ["north"], None)], "id string, slug string, name string, enabled boolean, groups array<string>, source_status string"),
        "sources": make("sources", [("s1", "p1", "https://u:pw@a.example.org/feed?token=x", "https://a.example.org/feed", "feed", True, "ok", True), ("s2", "p1", "https://a.example.org/b", "https://a.example.org/b", "html", False, None, None), ("s3", "p3", "https://o.example.org/", "https://o.example.org/", "rss", True, None, None), ("s4", "gone", "https://g.example.org/", "https://g.example.org/", "odd", True, None, None)], "id string, publisher_id string, url string, normalized_url string, kind string, enabled boolean, status string, success boolean"),
        "runs": make("runs", [("r1", "completed", "2025-01-01 00:00:00", "2025-01-01 00:10:00", None), ("r2", "running", "2025-01-02 00:00:00", None, None), ("r3", "running", "2025-01-03 00:00:00", None, "2025-01-03 00:01:00")], "id string, status string, started_at string, finished_at string, heartbeat_at string"),
        "stats": make("run_stats", [("1", "r1", "p1", "s1", "success", 5, 2, "2025-01-01 00:00:00"), ("2", "r2", "p1", "s1", "failed", 1, 0, "2025-01-02 00:00:00"), ("3", "r1", "p3", "s3", "ok", 1, 1, "2025-01-09 00:00:00")], "id string, run_id string, publisher_id string, source_id string, status string, discovered long, stored long, started_at string"),
        "results": make("publisher_results", [("1", "r1", "p1", "partial", "parse_error"), ("2", "r1", "p1", "partial", None)], "id string, run_id string, publisher_id string, status string, error_category string"),
        "leases": make("leases", [("run:r2", "o", "2025-01-03 00:10:00", "2025-01-03 00:01:00")], "name string, owner string, lease_until string, heartbeat_at string"),
        "articles": make("articles", [("a1", "https://a.example.org/n/1", "Story", "<p>Body</p>", "success", "h"), ("a2", "https://a.example.org/n/1", "Story", "", "failed", "h"), ("a3", "https://x.example.com/", "Contact us", "Contact us here", "success", None)], "id string, canonical_url string, title string, content string, parse_status string, content_hash string"),
        "discoveries": make("discoveries", [("1", "a1", "s1", "2025-01-01 00:00:00"), ("2", "a1", "s3", "2025-01-02 00:00:00"), ("3", "a2", "s1", "2025-01-03 00:00:00")], "id string, article_id string, source_id string, discovered_at string"),
    }


def test_selection(t):
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(console.select_publishers(t["publishers"])) == ["p1", "p2"] and ids(console.select_publishers(t["publishers"], ["ALPHA"])) == ["p1"]
    assert ids(console.select_publishers(t["publishers"], groups=["NORTH"])) == ["p1"] and ids(console.config_only_missing(t["publishers"], t["sources"])) == ["p2"]
    assert ids(console.selectable_sources(t["sources"], t["publishers"])) == ["s1"] and ids(console.active_run(t["runs"])) == ["r3"]
    assert console.resolve_source(t["sources"], t["publishers"], "https://A.example.org/feed")["id"] == "s1"
    for wanted, why in (("zzz", "unknown"), ("s2", "disabled"), ("s3", "enabled publisher")):
        with pytest.raises(ValueError, match=why):
            console.resolve_source(t["sources"], t["publishers"], wanted)


def test_runs(spark, t):
    found = console.classified_runs(t["runs"], t["leases"], t["stats"], t["results"], F.lit("2025-01-03 00:03:00").cast("timestamp"))
    by = {r.id: (r.state, r.reason, r.failures) for r in found.collect()}
    assert by == {"r1": ("warning", "terminal_state", 2), "r2": ("running", "heartbeat_fresh", 1), "r3": ("running", "heartbeat_fresh", 0)}
    assert rows(console.select_runs(found, "state", "terminal").select("id")) == [("r1",)] and console.select_runs(found, "state", "completed").count() == 1
    changes = spark.createDataFrame([("r", 1, "running", "2025-01-01 00:00:00", None, None, "2025-01-01 00:00:00"), ("r", 2, None, None, None, "{}", "2025-01-01 00:00:05"), ("r", 3, None, None, None, None, "2025-01-01 00:00:07"), ("r", 4, "completed", None, "2025-01-01 00:00:09", None, None)], "id string, seq int, status string, started_at string, finished_at string, progress string, heartbeat_at string")
    one = console.fold_runs(changes).first()
    assert (one.status, one.duration_ms, one.progress_at[-2:], one.heartbeat_at[-2:]) == ("completed", 9000, "05", "09")


def test_events_get_ids_in_order(spark):
    old = spark.createDataFrame([(7,)], "id long")
    new = spark.createDataFrame([("r", i, '{"raw_html": "x"}') for i in (3, 1, 2)], "run_id string, arrival int, metadata string")
    found = console.append_events(old, new).orderBy("arrival").collect()
    assert [r.id for r in found] == [8, 9, 10] and found[0].metadata == '{"raw_html": "[html omitted]"}'
    assert console.append_events(old, new.limit(0)).count() == 0


def test_lists(t):
    s = {r.id: r for r in console.source_list(t["sources"], t["publishers"], t["stats"], t["runs"]).collect()}
    assert s["s1"].status == "failed" and s["s1"].discovered == 1 and s["s1"].can_start and s["s1"].link == "https://a.example.org/feed?token=REDACTED" and not s["s3"].can_start and s["s4"].kind is None
    history = console.publisher_history(t["stats"], t["results"], t["runs"], "p1").collect()
    assert [(r.run_id, r.from_result, r.status) for r in history] == [("r2", False, "failed"), ("r1", True, "partial")]
    d = {r.publisher_id: r for r in console.publisher_detail(t["publishers"], t["sources"], t["results"], t["runs"]).collect()}
    assert (d["p1"].sources, d["p1"].enabled_sources, d["p1"].last_run_id, d["p2"].sources) == (2, 1, "r1", 0)
    listed = console.article_list(t["articles"], t["discoveries"], t["sources"])
    assert rows(console.article_list(t["articles"], t["discoveries"], t["sources"], "p3").select("id", "discoveries")) == [("a1", 2)] and "raw_html" not in listed.columns
    p = {r.id: r for r in console.article_projection(listed, ["a.example.org"], F.lit("2025-01-01").cast("timestamp")).collect()}
    assert p["a1"].warnings == ["duplicate_title", "duplicate_url"] and p["a1"].summary == "Body" and "navigation_content_suspect" in p["a3"].warnings and "empty_content" in p["a2"].warnings
    relations = t["stats"].select("run_id", F.lit("a1").alias("article_id"), F.lit("stored").alias("outcome"))
    found, seen, how = console.run_articles(relations, t["articles"], "r1")
    assert (found.count(), seen, how) == (1, True, "relation") and console.run_articles(None, t["articles"], "r1")[1] is False
    assert console.envelope([{"updated_at": "b"}, {"updated_at": "a"}], 5, 2, 0) == {"items": [{"updated_at": "b"}, {"updated_at": "a"}], "count": 2, "total": 5, "limit": 2, "offset": 0, "has_more": True, "next_offset": 2, "next_cursor": "2", "last_updated": "b"}


def test_audits(t):
    assert rows(audit.registry_audit(t["publishers"], t["sources"]).select("code", "subject")) == [("no_enabled_source", "p2"), ("unknown_publisher", "s4")]
    found = rows(audit.run_evidence_audit("r1", t["sources"], t["stats"], t["runs"]).select("code", "subject", "detail"))
    assert ("source_evidence", "s4", "missing") in found and found[0][:2] == ("outside_run", "s3")
    assert ("publisher_evidence", "p2", "missing") in rows(audit.result_audit("r1", t["publishers"], t["results"]).select("code", "subject", "detail"))
    assert {r.code for r in audit.duplicate_audit(t["articles"]).collect()} == {"duplicate_canonical_url", "duplicate_content_and_title"}
    judged, few = audit.article_audit(t["articles"].withColumn("publisher", F.substring("id", 2, 1)), "publisher", F.array(F.lit("a.example.org")))
    assert {r.id: sorted(r.reasons) for r in judged.collect()} == {"a1": [], "a2": ["no_content", "not_parsed"], "a3": ["navigation", "not_official", "root_page"]} and few.count() == 2
    a = t["articles"].select(F.lit("p").alias("p"), F.col("id").alias("k"))
    assert audit.two_run_acceptance(a.where("k < 'a3'"), a.where("k > 'a1'"), "p", "k").first() == ("p", 2, 2, 1, 1)
