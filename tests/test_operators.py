import json
import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import candidates, identity, joins, latest, merges, paging, reporting, rollups
from broadsheet.plans import report
from payloads import ARRIVALS
from broadsheet.sources.store import SCHEMAS, Conflict, Store, logical, safe, write_report

rows = lambda *a: pytest.rows(*a)


def test_pages(spark):
    df = spark.range(100).toDF("id")
    assert [r.id for r in paging.keyset_page(df, "id", 97).collect()] == [98, 99] and paging.clamp(9999, -1) == (500, 0) and paging.clamp(None)[0] == 50
    assert paging.page_with_total(df, [F.asc("id")], 2, 200).collect() == [(None, 100)] and paging.page_with_total(df, [F.asc("id")], 2, 98).count() == 2
    with pytest.raises(ValueError):
        paging.cursor_offset("5", 5)
    with pytest.raises(ValueError):
        paging.cursor_offset("x", None)


POLICY = dict(hosts=["example.org", "news.example.net"], allow=["/events/"], exclude=["/events/private"])


@pytest.mark.parametrize(
    "url, policy, expected",
    [
        ("https://news.example.net/events/public", POLICY, None),
        ("https://news.example.net/events/private", POLICY, "excluded"),
        ("https://foo.news.example.net/events/public", POLICY, "not_official"),
        ("https://news.example.net.evil/events/public", POLICY, "not_official"),
        ("ftp://news.example.net/events/public", POLICY, "not_official"),
        ("https://attacker@news.example.net/events/public", POLICY, "not_official"),
        ("https://example.org/", dict(hosts=["example.org"], allow=[".*"]), "root_page"),
        ("https://example.org/feed", dict(hosts=["example.org"], allow=[".*"], source="https://example.org/feed"), "source_page"),
        ("https://example.org/news/story", dict(hosts=["example.org"], allow=[".*"]), None),
        ("https://example.org/news/[", dict(hosts=["example.org"], allow=["/news/["]), "not_allowed"),
        ("https://example.org/shop/x", dict(hosts=["example.org"]), "default_navigation"),
        ("https://example.org/shop/x", dict(hosts=["example.org"], allow=["/shop/"]), None),
        ("https://example.org/shop/x", dict(hosts=["example.org"], allow=["/shop/"], navigation=["/shop"]), "navigation"),
        (None, POLICY, "not_official"),
    ],
)
def test_policy(spark, url, policy, expected):
    policy = dict(policy)
    if source := policy.pop("source", None):
        policy["source_url"] = F.lit(source)
    assert spark.createDataFrame([(url,)], "u string").select(candidates.policy_reason(F.col("u"), **policy)).first()[0] == expected


def test_candidates(spark):
    df = spark.createDataFrame([("a", "s", 1), ("a", "s", 2), ("b", "s", 3), ("c", "t", 4)], "k string, s string, n int")
    assert rows(candidates.distinct_candidates(df, "k", [F.asc("n")]).select("k", "n", "duplicates")) == [("a", 1, 1), ("b", 3, 0), ("c", 4, 0)]
    assert rows(candidates.capped(df, "s", [F.asc("n")], 2).select("n", "limited")) == [(1, True), (2, True), (4, False)]
    batch = candidates.next_batch(df, df.where("k = 'b'"), "k", ["n"], 1)
    assert batch.select("k", "n", "remaining").collect() == [("a", 1, 1)]
    kinds = spark.createDataFrame([("HTML List",), ("feed",), ("odd",)], "k string").select(candidates.canonical_kind(F.col("k")))
    assert [r[0] for r in kinds.collect()] == ["archive", "rss", None]
    allowed = spark.createDataFrame([("/a[b",), ("/c",)], "u string").where(candidates.explicitly_allowed(F.col("u"), ["A[B"]))
    assert allowed.count() == 1


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert rows(joins.prefer(a, b, ["k"])) == [(1, "x", True), (2, None, True), (3, "z", False)]
    assert rows(joins.set_changes(a, b, ["k"], "v")) == [(1, "x", None, "removed"), (2, None, "y", "changed"), (3, None, "z", "added")]
    twice = b.unionByName(b.limit(1))
    assert {r.k: r.state for r in joins.coverage(a, twice, ["k"]).collect()} == {1: "missing", 2: "duplicate", 3: "extra"}
    n = spark.createDataFrame([(None, 1), (1, 2)], "k int, w int")
    assert rows(joins.null_safe_join(n, n.withColumnRenamed("w", "x"), ["k"])) == [(None, 1, 1), (1, 2, 2)]


def test_merges(spark):
    df = spark.createDataFrame([("k", 1, None, "s1", 10), ("k", 2, "t2", None, 20), ("k", 3, None, "s3", 30)], "key string, id int, t string, s string, w int")
    assert merges.keeper_merge(df, "key", "id", ["t", "s"], F.col("w")).first() == ("k", 3, "t2", "s3", 3, [1, 2])
    late = spark.createDataFrame([(1, 5, None), (1, 3, "b"), (1, 4, "a")], "k int, t int, raw string").withColumn("o", F.col("t"))
    assert merges.discovery_fold(late, ["k"], "t", "raw", "o").first() == (1, 3, 5, "b", 3)
    last = spark.createDataFrame([(None, 1, "x"), (None, 2, "y")], "k string, t int, v string")
    assert merges.last_wins(last, ["k"], ["t"], ["v"], "t", "t").first() == ("", "y", 1, 2, 2)
    old = spark.createDataFrame([(1, "a", "h"), (2, "b", "h")], "id int, t string, raw string")
    new = spark.createDataFrame([(1, "", "h2"), (3, "c", None), (2, "b2", "h")], "id int, t string, raw string")
    assert rows(merges.upsert(old, new, "id", ["t"], ["raw"])) == [(1, "unchanged", "a", "h2"), (2, "updated", "b2", "h"), (3, "created", "c", None)]
    refs = spark.createDataFrame([(1, "x"), (2, "x"), (5, "y")], "a int, s string")
    assert rows(merges.remap(refs, spark.createDataFrame([(1, 2)], "donor int, keeper int"), "a")) == [(2, "x"), (5, "y")]
    sources = spark.createDataFrame([("s", "new", None, None, None)], "id string, status string, success boolean, last_checked int, last_success int")
    checks = spark.createDataFrame([("s", "ok", True, 1), ("s", "error", False, 2), ("s", "odd", None, 3)], "id string, status string, success boolean, checked_at int")
    assert merges.source_status(sources, checks, "id").first() == ("s", "odd", None, 3, 1)


def test_latest_and_rollups(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert rows(latest.top_per_key(df, ["k"], [F.desc("n")])) == [("a", 2, "y"), ("b", 1, None)]
    assert rows(rollups.zero_filled(df, "k", ["a", "z"], {"n": F.count("*")})) == [("a", 2), ("z", 0)]
    assert df.agg(rollups.optional_total(F.when(F.lit(False), 1)).alias("o"), rollups.total(F.lit(None)).alias("t"), rollups.joined_values(F.col("v")).alias("j")).first() == (None, 0, "x, y")
    same = spark.createDataFrame([("a", f"2025-01-01 0{i}:00:00") for i in range(3)] + [("b", f"2025-01-0{i + 1} 00:00:00") for i in range(3)], "k string, t string")
    assert [r.k for r in rollups.same_date(same, "k", F.col("t").cast("timestamp")).collect()] == ["a"]
    checks = spark.createDataFrame([("a", "PASS"), ("b", "OPEN")], "name string, status string")
    assert rollups.verdict(checks).first().verdict == "INCOMPLETE" and rollups.verdict(checks.where("name = 'a'")).first().verdict == "PASS"


def test_identity_order_and_idempotence(spark):
    arrivals = spark.createDataFrame(ARRIVALS, "arrival_seq long, publisher_id string, url string, title string, content_hash string")
    outcomes, articles = identity.resolve(arrivals)
    shuffled = spark.createDataFrame(random.Random(1).sample(ARRIVALS, len(ARRIVALS)), arrivals.schema)
    assert rows(outcomes) == rows(identity.resolve(shuffled)[0])
    merged = {r.article_id: r for r in articles.collect()}
    assert merged[601].merged_ids == [602] and merged[201].canonical_url is None and merged[201].normalized_url == "https://e.org/h1"
    assert merged[501].title == "After" and merged[501].source_url_raw == "https://e.org/k?utm_source=x"
    again = arrivals.unionByName(arrivals.withColumn("arrival_seq", F.col("arrival_seq") + 1000).where("url is not null and arrival_seq not in (1501, 1601)"))
    late = {r.outcome for r in identity.resolve(again)[0].where("arrival_seq > 1000").collect()}
    assert late <= {"unchanged", "updated"}
    assert identity.resolve(arrivals.limit(0))[0].count() == 0


def test_identity_of_a_hash_that_very_many_rows_share(spark):
    arrivals = [(1, "p", "https://e.org/t", "T", "own"), (2, None, "https://e.org/g", "G", "own")]
    arrivals += [(10 + i, None, f"https://e.org/{i}", f"Page {i}", "hot") for i in range(1200)]
    arrivals += [(5000, "p", None, "T", "hot"), (5001, None, "https://e.org/g", "G", "hot")]
    outcomes, articles = identity.resolve(spark.createDataFrame(arrivals, "arrival_seq long, publisher_id string, url string, title string, content_hash string"))
    found = {r.arrival_seq: (r.article_id, r.outcome) for r in outcomes.collect()}
    assert found[5000] == (5000, "created") and found[1][0] == 5000  # without URL, under a hash of other titles: created, then it takes the title
    assert found[5001] == (2, "updated") and articles.where("article_id = 2").first().content_hash == "own"  # other articles have the hash
    assert all(found[10 + i] == (10 + i, "created") for i in range(1200))


def test_identity_rechecks_and_titles(spark):
    new = identity.Resolver()
    row = lambda **k: identity._clean({"url": None, "publisher_id": None, "metadata_json": None, **k})
    assert new.add(1, row(url="https://e.org/a", title="T", content_hash="h", html_hash="x", publisher_id="p")) == (1, "created")
    assert new.add(2, row(url="https://e.org/a", html_hash="y", raw_html="")) == (1, "unchanged") and new.articles[1]["html_hash"] == "y"
    assert new.add(3, row(title="t", publisher_id="p")) == (1, "updated") and new.add(4, row(title="t", publisher_id="q")) == (4, "created")
    assert new.add(5, row(url="https://e.org/b", title="Other", publisher_id="p")) == (5, "created")
    assert new.add(6, row(url="https://e.org/b", title="T", publisher_id="p"))[0] == 5 and 1 not in new.articles  # the URL's article takes in the title's
    assert identity.identity_key("h", "") is None and identity._object("[1]") == {}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("runs").count() == 0
    first = spark.createDataFrame([("r1", "completed"), ("r2", "running")], "id string, status string")
    store.upsert("runs", first)
    store.upsert("runs", spark.createDataFrame([("r2", "failed"), ("r3", "ok")], "id string, status string"))
    assert rows(store.read("runs").select("id", "status")) == [("r1", "completed"), ("r2", "failed"), ("r3", "ok")]
    store.compact(["runs"], whole=True)
    assert store.vacuum() == 2 and store.read("runs").count() == 3 and store.read("runs").columns == list(SCHEMAS["runs"])
    legacy = spark.createDataFrame([("1", "z", '["g"]', "<p>")], "id string, zoo_id string, groups_json string, raw_html string")
    assert logical(legacy, "run_stats").first().publisher_id == "z" and logical(legacy, "publishers").first().groups == ["g"] and "raw_html" not in safe(legacy).columns
    manifest = write_report(str(tmp_path / "report"), {"a.txt": b"x"})
    assert manifest == json.loads((tmp_path / "report/manifest.json").read_text()) and manifest["a.txt"]["bytes"] == 1


def test_store_commits_are_atomic_and_partial(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    runs = lambda *r: spark.createDataFrame(list(r), "id string, status string")
    store.upsert("runs", runs(*[(f"r{i}", "old") for i in range(300)]))
    before = store.manifest()["runs"]
    after = store.upsert("runs", runs(("r7", "new")))["runs"]
    assert after[:1] == before and after[1]["rows"] == 1  # the new row is all that is written
    assert rows(store.read("runs").groupBy("status").count()) == [("new", 1), ("old", 299)]
    base = store.number()
    other = Store(spark, str(tmp_path / "s"))
    other.commit({"leases": spark.createDataFrame([("run:r1", "o")], "name string, owner string")})
    store.commit({"publishers": spark.createDataFrame([("p",)], "id string")}, base)  # another table's change is no conflict
    with pytest.raises(Conflict):
        store.commit({"leases": spark.createDataFrame([("run:r2", "o")], "name string, owner string")}, base)
    assert store.read("leases").count() == 1 and store.read("publishers").count() == 1 and store.read("runs").count() == 300
    assert len([n for n in store._names("manifests") if n.endswith(".json")]) == 4
    store.vacuum()
    assert len(store._names("manifests")) == 1 and store.read("runs").count() == 300 and store.upsert("runs", runs()) == store.manifest()


def test_report(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    make = lambda t, data, cols: store.upsert(t, spark.createDataFrame(data, cols))
    make("publishers", [("p1", "Alpha | <script>", True), ("p2", "Empty", True), ("p3", "Off", False)], "id string, name string, enabled boolean")
    make("sources", [("s1", "p1", "rss", True, "ok", True), ("s2", "p1", "archive", True, "error", False)], "id string, publisher_id string, kind string, enabled boolean, status string, success boolean")
    make("articles", [("a1", "T"), ("a2", "U")], "id string, title string")
    make("discoveries", [("d1", "a1", "s1", "k"), ("d2", "a1", "s2", "k"), ("d3", "a2", "s1", "k2")], "id string, article_id string, source_id string, discovered_key string")
    make("runs", [("r1", "b", "2025-01-01 00:00:00"), ("r2", "b", "2025-01-02 00:00:00")], "id string, batch_id string, started_at string")
    make("run_stats", [("1", "r1", "p1", "s1", 4, 1), ("2", "r2", "p1", "s1", 6, 2), ("3", "r2", "p1", "s2", 1, 0)], "id string, run_id string, publisher_id string, source_id string, discovered long, stored long")
    make("publisher_results", [("1", "r2", "p1", "partial")], "id string, run_id string, publisher_id string, status string")
    t = {n: store.read(n) for n in ("publishers", "sources", "articles", "discoveries", "runs", "run_stats", "publisher_results")}
    found = report.projection(t["publishers"], t["sources"], t["articles"], t["discoveries"], t["runs"], t["run_stats"], t["publisher_results"])
    by = {p["publisher_id"]: p for p in found["publishers"]}
    assert by["p1"]["status"] == "partial" and by["p1"]["articles"] == 2 and by["p2"]["status"] == "missing_result" and by["p3"]["status"] == "disabled"
    assert found["coverage"] == {"exactly_one": 1, "missing": 1} and found["verdict"] == "FAIL" and found["run_id"] == "r2"
    assert {c["metric"]: c["change"] for c in found["change"]}["discovered"] == 3
    files = report.render(found)
    assert b"<script>&" not in files["report.html"] and b"Alpha \\| " in files["report.md"] and files["publishers.csv"].count(b"\n") == 4 and json.loads(files["report.json"])["run_id"] == "r2"
    assert len(files["publishers.csv"].split(b"\n")[0].split(b",")) >= 60 and len(found["checks"]) == 13 and b"## End criteria" in files["report.md"] and json.loads(files["articles.json"])["articles"][0]["article_id"] == "a1"
    assert by["p1"]["discovered"] == 7 and by["p1"]["source_article_associations"] == 3 and found["quality"]["empty_content"] == 2 and found["scope"]["status"] == "not_provided"
    report.write_articles(reporting.safe_articles(t["articles"], t["discoveries"], t["sources"], spark.createDataFrame([("a1", "stale")], "article_id string, code string")), str(tmp_path / "articles"))
    written = {r.id: r for r in spark.read.json(str(tmp_path / "articles")).collect()}
    assert written["a1"].warnings == ["stale"] and written["a1"].publishers == ["p1"] and "raw_html" not in written["a1"].asDict()
    nested = report.batches(t["runs"], t["run_stats"]).first()
    assert nested.batch_id == "b" and [r.run_id for r in nested.runs] == ["r2", "r1"] and nested.runs[0].publishers[0].discovered == 7
    events = spark.createDataFrame([(i, "r1", "p1", "s1", "ERROR" if i == 3 else "INFO", "Café failed" if i == 2 else "m") for i in range(1, 6)], "id long, run_id string, publisher_id string, source_id string, level string, message string")
    events = logical(events, "run_events")
    page = lambda **k: [r.id for r in report.event_page(events, t["publishers"], t["sources"], "r1", **k).collect()]
    assert page(level="error") == [3] and page(text="CAFÉ") == [2] and page(after=3, limit=1) == [4] and page(level="none") == []


def test_components_are_folded_in_a_stream():
    """Components have no frame each: one pass over sorted rows folds them, also where a batch ends within one."""
    import pyarrow as pa

    columns = {c: None for c in (*identity.COLUMNS, "publisher_id", "metadata_json", "url")}
    said = [{**columns, "component": c, "arrival_seq": c * 10 + i, "url": f"https://e.org/{c}", "title": f"T{i}"} for c in range(30) for i in range(3)]
    schema = pa.schema([(n, pa.int64() if n in ("component", "arrival_seq") else pa.string()) for n in said[0]])
    got = [r for b in identity.fold_sorted(pa.RecordBatch.from_pylist(said[i : i + 7], schema) for i in range(0, 90, 7)) for r in b.to_pylist()]
    assert [(r["component"], r["article_id"], r["outcome"]) for r in got if r["kind"] == "arrival"] == [(c, c * 10, o) for c in range(30) for o in ("created", "updated", "updated")]
    assert sum(r["kind"] == "article" for r in got) == 30 and list(identity.fold_sorted([])) == []
