import pytest
from pyspark.sql import functions as F

from broadsheet.operators import consolidate, identity, ingest
import payloads as d
from broadsheet.sources import feeds, registry

SOURCES = "id string, publisher_id string, url string, kind string, enabled boolean, adapter string"


@pytest.fixture(scope="module")
def corpus(spark):
    sources = spark.createDataFrame(
        [("s1", "p1", "https://example.org/feed", "feed", True, None), ("s2", "p1", "https://example.org/s1.xml", "sitemap", True, None), ("s3", "p1", "https://example.org/api", "api", True, None), ("s4", "p1", "https://example.org/archive", "html", True, None)]
        + [("s5", "p2", "https://x.example.net/custom", "plugin", True, "mine"), ("s6", "p2", "https://x.example.net/check", "health", True, None), ("s7", "p2", "https://x.example.net/off", "rss", False, None), ("s8", "p2", "https://x.example.net/gone", "rss", True, None)],
        SOURCES,
    )
    page = lambda i: f"<title>Page {i}</title><article><p>Body {i}</p></article>"
    pages = {"https://example.org/feed": d.RSS, "https://example.org/s1.xml": d.SITEMAP, "https://example.org/api": d.API, "https://example.org/archive": d.PAGE1, "https://x.example.net/check": ""}
    pages |= {u: page(i) for i, u in enumerate(["https://example.org/article/young", "https://example.org/article/local/", "https://example.org/a", "https://example.org/n/1", "https://x.example.net/story/9"])}
    docs = spark.createDataFrame([(u, 200, c) for u, c in pages.items()] + [("https://x.example.net/gone", 404, "")], "url string, status int, content string")
    return sources, docs


def adapters():
    found = ingest.AdapterRegistry()
    found.register("mine", lambda sources, docs: sources.select(F.col("id").alias("source_id"), F.explode(F.array(F.lit("https://x.example.net/story/9"), F.lit("https://evil.example.com/x"))).alias("url")))
    with pytest.raises(ValueError):
        found.register("mine", None)
    return found


def test_ingest_end_to_end(spark, corpus):
    sources, docs = corpus
    found = ingest.discover(sources, docs, adapters(), archive_config=d.CARDS)
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"rss": 3, "sitemap": 2, "json_api": 2, "archive": 1, "custom_adapter": 2}
    policies = spark.createDataFrame([("p1", ["example.org"], []), ("p2", ["x.example.net"], [])], "publisher_id string, hosts array<string>, phrases array<string>")
    known = spark.createDataFrame([("https://example.org/b",)], "url string")
    chosen, fates = ingest.select_candidates(found, policies, known, limit=2, cutoff=F.lit("2025-03-20").cast("timestamp"))
    by = {(r.source_id, r.key): r.fate for r in fates.collect()}
    assert by["s1", "https://example.org/article/local"] == "too_old" and by["s2", "https://example.org/b"] == "known" and by["s5", "https://evil.example.com/x"] == "off_policy"
    assert sorted(f for (s, k), f in by.items() if k == "https://example.org/n/1") == ["duplicate", "new"]
    parsed = ingest.parse_new(chosen, docs)
    rows = {r.url: r for r in parsed.collect()}
    assert rows["https://example.org/article/young"].title == "Page 0" and rows["https://example.org/article/young"].author == "Ann"
    assert rows["https://example.org/article/guid"].parse_status == "failed"
    arrivals = parsed.withColumn("arrival_seq", F.monotonically_increasing_id()).withColumn("published_at", F.col("published_at").cast("string"))
    outcomes, articles = identity.resolve(arrivals.where("parse_status <> 'failed'"))
    assert articles.count() == 4 and {r.outcome for r in outcomes.collect()} == {"created"}
    told = parsed.select("source_id", F.lit("created").alias("outcome"), (F.col("parse_status") == "failed").alias("failed"))
    stats = {r.source_id: r for r in ingest.run_stats(fates, told, "r1").collect()}
    assert stats["s1"].discovered == 3 and stats["s1"].error_count == 1 and stats["s1"].status == "partial" and stats["s2"].already_known == 1
    assert ingest.run_events(spark.createDataFrame(list(stats.values())), "2025-01-01").where("event_type = 'source_failed'").count() == sum(s.error_count > 0 for s in stats.values())
    health = {r.source_id: r.status for r in ingest.source_health(sources, docs).collect()}
    assert health["s6"] == "success" and health["s8"] == "source_not_found" and "s7" not in health


def test_phrases(spark):
    found = spark.createDataFrame([("s", "p", "rss", "https://e.org/f", 0, "https://e.org/a", "Löwen im ZOO"), ("s", "p", "rss", "https://e.org/f", 1, "https://e.org/b", "Sport")], "source_id string, publisher_id string, kind string, source_url string, position int, url string, title string")
    policies = spark.createDataFrame([("p", ["e.org"], ["löwen"])], "publisher_id string, hosts array<string>, phrases array<string>")
    _, fates = ingest.select_candidates(ingest._shaped(found), policies, spark.createDataFrame([], "url string"))
    assert {r.position: r.fate for r in fates.collect()} == {0: "new", 1: "off_topic"}


def test_consolidation(spark):
    s = spark.createDataFrame([(1, "p", "u", None, "feed"), (2, "p", "u", "n", None), (3, "p", "v", "x", "y")], "id int, publisher_id string, normalized_url string, name string, kind string")
    kept, donors = consolidate.sources(s, ["publisher_id", "normalized_url", "name", "kind"])
    assert pytest.rows(kept) == [(1, "p", "u", "n", "feed"), (3, "p", "v", "x", "y")] and donors.collect() == [(2, 1)]
    disc = spark.createDataFrame([(10, "a", 2, None, "2025-01-02", None, "x"), (11, "a", 1, "", "2025-01-01", "2025-01-03", None)], "id int, article_id string, source_id int, discovered_key string, discovered_at string, last_discovered_at string, discovered_url string")
    assert consolidate.discoveries(disc, donors).collect() == [("a", 1, "", "2025-01-01", "2025-01-03", "x", 10)]
    l = spark.createDataFrame([("n", None, "2026-01-01", None), ("n", "o", "2025-01-01", None), ("n", "o2", "2025-06-01", None)], "name string, owner string, lease_until string, heartbeat_at string")
    assert consolidate.leases(l).first().owner == "o2"
    r = spark.createDataFrame([(1, "r", "p", "x", None), (2, "r", "p", "y", "e"), (3, "r", "q", None, None)], "id int, run_id string, publisher_id string, status string, error string").withColumn("finished_at", F.lit(None).cast("timestamp")).withColumn("started_at", F.lit(None).cast("timestamp"))
    assert pytest.rows(consolidate.results(r, ["status", "error"]).select("id")) == [(2,), (3,)]
    assert pytest.rows(consolidate.least_id(s, "name").select("id")) == [(1,), (2,), (3,)]
    p = spark.createDataFrame([("a", "list", "not_found", True), ("b", None, None, True), ("c", "list", None, True)], "id string, provenance string, source_status string, enabled boolean")
    assert consolidate.roster(p.where("provenance is not null"), 2).first().complete and not consolidate.roster(p, 3).first().complete
    assert pytest.rows(consolidate.empty_publishers(p, spark.createDataFrame([("c", True)], "publisher_id string, enabled boolean"))) == [("a", "success_no_items"), ("b", "configuration_error")]
    flags = spark.createDataFrame([(["parse_error"], "failed", 404), (["failed"], "error", 503), (["timeout"], "failed", None), (["odd thing"], "failed", 404)], "c array<string>, s string, h int")
    assert [(x.external, x.blocking) for x in consolidate.evidence_flags(flags, "c", "s", "h").collect()] == [(False, True), (True, False), (True, False), (False, True)]


def test_sources_have_settings_and_policies_of_their_own(spark):
    """Indexes and next links are followed by each source's settings; its patterns decide what is fetched."""
    text = """
publishers:
  alpha:
    name: Alpha
    website_url: https://a.example.org/
    metadata: {exclude_patterns: ["/private/", "["]}
    sources:
      - {id: m, url: "https://a.example.org/index.xml", kind: sitemap, config: {max_sitemaps: 3, allow_patterns: ["/n/", "["]}}
      - {id: h, url: "https://a.example.org/list", kind: html, config: {item_selector: "div.c", next_selector: "a.more", max_pages: 2, identity_filter: ["Lion"]}}
      - {id: j, url: "https://a.example.org/api", kind: json, config: {items_path: [deep, list], url: where}}
"""
    publishers, sources = registry.read(text)
    urlset = lambda *u: "<urlset>" + "".join(f"<url><loc>https://a.example.org{x}</loc></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example.org/{x}.xml</loc></sitemap>" for x in u) + "</sitemapindex>"
    card = lambda u, t: f'<div class="c"><a href="{u}">{t}</a></div>'
    pages = {
        "index.xml": index("index", "zz", "sub", "over"), "zz.xml": urlset("/n/1", "/private/n/2", "/other/3"), "sub.xml": index("zz", "leaf"), "over.xml": urlset("/n/9"), "leaf.xml": urlset("/n/8"),
        "list": card("/n/1", "Lion cub") + card("/x", "Tiger") + '<a class="more" href="/list?p=2">more</a>', "list?p=2": card("/n/5", "Old lion") + '<a class="more" href="/list?p=3">more</a>', "list?p=3": card("/n/6", "Lion"),
        "api": '{"deep": {"list": [{"where": "/n/7", "title": "Seven"}]}}',
    }
    docs = spark.createDataFrame([(f"https://a.example.org/{u}", 200, c) for u, c in pages.items()], "url string, status int, content string")
    frame = registry.frames(spark, publishers, sources)[1].withColumn("adapter", F.lit(None).cast("string"))
    found = ingest.discover(frame, docs)
    assert pytest.rows(found.select("source_id", "url")) == [("h", f"https://a.example.org/{x}") for x in ("n/1", "n/5", "x")] + [("j", "https://a.example.org/n/7")] + [("m", f"https://a.example.org/{x}") for x in ("n/1", "other/3", "private/n/2")]
    _, fates = ingest.select_candidates(found, registry.policies(spark, publishers, sources), spark.createDataFrame([], "url string"))
    by = {(r.source_id, r.key.rpartition("org/")[2]): r.fate for r in fates.collect()}
    assert by == {("m", "n/1"): "new", ("m", "other/3"): "off_policy", ("m", "private/n/2"): "off_policy", ("h", "n/1"): "duplicate", ("h", "n/5"): "new", ("h", "x"): "off_topic", ("j", "n/7"): "new"}


def test_each_root_has_its_own_budget(spark):
    urlset = lambda r, i: f"<urlset><url><loc>https://r{r}.example.org/a{i}</loc></url></urlset>"
    pages = [(f"https://r{r}.example.org/i.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://r{r}.example.org/s{99 - i}.xml</loc></sitemap>" for i in range(30)) + "</sitemapindex>") for r in range(2)]
    pages += [(f"https://r{r}.example.org/s{99 - i}.xml", urlset(r, i)) for r in range(2) for i in range(30)]
    docs = spark.createDataFrame(pages, "url string, content string")
    found = feeds.sitemap_walk(docs, docs.where("url like '%/i.xml'"))
    assert pytest.rows(found.groupBy("root_url").count()) == [("https://r0.example.org/i.xml", 19), ("https://r1.example.org/i.xml", 19)]
    assert {r.url.rpartition("/a")[2] for r in found.collect()} == {str(i) for i in range(19)}  # in the index's order, not that of URLs


def test_adapters_get_official_documents_only(spark):
    seen, found = [], ingest.AdapterRegistry()
    found.register("mine", lambda sources, docs: seen.extend(r.url for r in docs.collect()) or sources.select(F.col("id").alias("source_id"), "url"))
    sources = spark.createDataFrame([("s", "p", "https://x.example.net/c", "plugin", True, "mine")], SOURCES)
    docs = spark.createDataFrame([("https://x.example.net/a", 200, ""), ("https://y.example.net/a", 200, ""), ("https://z.example.net/a", 200, "")], "url string, status int, content string")
    ingest.discover(sources, docs, found).count()
    ingest.discover(sources, docs, found, policies=spark.createDataFrame([("s", ["y.example.net"])], "source_id string, hosts array<string>")).count()
    assert seen == ["https://x.example.net/a", "https://y.example.net/a"]


def test_sinks_and_storage_may_fail(spark):
    stats = spark.createDataFrame([("s", "success", 3, 2, 1, 0, 0, 0, "exhausted")], "source_id string, status string, discovered long, fetched long, stored long, updated long, already_known long, error_count long, stop_reason string")
    got = []

    def broken(df):
        raise OSError("full")

    assert ingest.emit(stats, {"a": broken, "b": got.append}) == {"a": "OSError: full", "b": None} and got == [stats]
    told, error = ingest.recorded(stats, broken)
    assert error == "OSError: full" and told.first().status == "failed" and ingest.recorded(stats, got.append) == (stats, None)
    assert ingest.progress(stats, "fetch", "p").first().asDict() == {"phase": "fetch", "publisher_id": "p", "source_id": None, "discovered": 3, "fetched": 2, "stored": 1, "updated": 0, "already_known": 0, "error_count": 0}


@pytest.mark.parametrize("n", [999, 1001])
def test_identity_has_one_rule_at_every_size(spark, n):
    """The same arrivals end alike, however many rows share their hash."""
    rows = [(1, "https://e.org/a", "A", "h"), (2, "https://e.org/b", "B", "g"), (3, "https://e.org/b", "B", "h"), (4, "https://e.org/c", "C", "h")]
    rows += [(10 + i, f"https://e.org/x{i}", f"X{i}", "h") for i in range(n)]
    _, articles = identity.resolve(spark.createDataFrame(rows, "arrival_seq long, url string, title string, content_hash string"))
    by = {r.article_id: r.content_hash for r in articles.where("article_id < 10").collect()}
    assert by == {1: "h", 2: "g", 4: "h"} and articles.count() == n + 3


def test_groups_provenance_and_vocabularies(spark):
    roster = {"source": "list.md", "version": "v1", "sha256": "0" * 64, "expanded_count": 2}
    base = {"id": "a", "slug": "a", "name": "A", "website_url": "https://a.example.org/", "country_code": "DE", "language": "de", "enabled": True}
    told = lambda p, **k: [(path.partition("].")[2], code) for path, code, _ in registry.issues([{**base, **p}], [], **k)]
    assert told({}) == [] and told({"country_code": "QQ"}) == [("country_code", "vocabulary")] and told({"language": "qq"}) == [("language", "vocabulary")]
    assert told({"groups": "x"}) == [("groups", "groups")] and told({"groups": ["x", " ", "x"]}) == [("groups[1]", "groups"), ("groups[2]", "groups")]
    assert told({"groups": ["x", "y"]}, pairs={frozenset("xz")}) == [("groups", "groups")] and told({"groups": ["x", "z"]}, pairs={frozenset("xz")}) == []
    gap = {"country_code": None}
    assert told(gap, roster=roster) == [("list_provenance", "provenance")] and told({**gap, "list_provenance": [{**roster, "source_line": 4}]}, roster=roster) == []
    assert told({**gap, "list_provenance": [{**roster, "version": "v2", "source_line": 0}]}, roster=roster) == [("list_provenance[0].version", "provenance"), ("list_provenance[0].source_line", "provenance")]


def test_sources_of_one_url_keep_their_own_settings(spark):
    """Two archives of one URL differ in selectors, two indexes of one URL in budget."""
    text = """
publishers:
  alpha:
    name: Alpha
    website_url: https://a.example.org/
    sources:
      - {id: s1, url: "https://a.example.org/list", kind: html, config: {item_selector: "div.a"}}
      - {id: s2, url: "https://a.example.org/list", kind: html, config: {item_selector: "div.b", next_selector: "a.more"}}
      - {id: m1, url: "https://a.example.org/index.xml", kind: sitemap, config: {max_sitemaps: 2}}
      - {id: m2, url: "https://a.example.org/index.xml", kind: sitemap, config: {max_sitemaps: 9}}
"""
    publishers, sources = registry.read(text)
    urlset = lambda u: f"<urlset><url><loc>https://a.example.org{u}</loc></url></urlset>"
    pages = {
        "list": '<div class="a"><a href="/x1">x</a></div><div class="b"><a href="/y1">y</a></div><a class="more" href="/list?p=2">more</a>', "list?p=2": '<div class="a"><a href="/x2">x</a></div><div class="b"><a href="/y2">y</a></div>',
        "index.xml": "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example.org/{i}.xml</loc></sitemap>" for i in range(3)) + "</sitemapindex>", **{f"{i}.xml": urlset(f"/n/{i}") for i in range(3)},
    }
    docs = spark.createDataFrame([(f"https://a.example.org/{u}", 200, c) for u, c in pages.items()], "url string, status int, content string")
    frame = registry.frames(spark, publishers, sources)[1].withColumn("adapter", F.lit(None).cast("string"))
    found = {(r.source_id, r.url.rpartition("example.org")[2]) for r in ingest.discover(frame, docs).collect()}
    assert found == {("s1", "/x1"), ("s2", "/y1"), ("s2", "/y2"), ("m1", "/n/0"), ("m2", "/n/0"), ("m2", "/n/1"), ("m2", "/n/2")}


def test_patterns_are_read_in_one_grammar(spark):
    """Named groups and the end of the text in Python's spelling work in both paths; what can't compile is an issue."""
    import re

    from broadsheet.functions.patterns import problem, translated
    from broadsheet.operators.candidates import policy_reason

    allow = [r"/(?P<kind>news)/(?P=kind)?(?#any)", r"[[a]/odd\\Z", r"/(?P<a_b>x)(?P<ab>y)\Z", "["]
    text = "publishers:\n  alpha:\n    name: A\n    website_url: https://a.example.org/\n    sources:\n      - {id: s, url: 'https://a.example.org/f', kind: rss}\n"
    publishers, sources = registry.read(text)
    sources[0]["config"] = {"allow_patterns": allow, "exclude_regex": ["(?P<n>draft)", r"(?<=a+)b"]}
    told = [(path, code) for path, code, _ in registry.issues(publishers, sources) if code == "regex"]
    assert told == [("sources[0].config.allow_patterns", "regex"), ("sources[0].config.exclude_regex", "regex")]
    urls = spark.createDataFrame([(f"https://a.example.org{u}",) for u in ("/news/1", "/news/news", "/draft/news/1", "/other", "/xy", "/xyz")], "url string")
    by_list = {r.url: r.why for r in urls.select("url", policy_reason(F.col("url"), ["a.example.org"], allow, ["(?P<n>draft)"]).alias("why")).collect()}
    found = urls.select(F.lit("s").alias("source_id"), F.lit("alpha").alias("publisher_id"), F.lit("rss").alias("kind"), F.lit("https://a.example.org/f").alias("source_url"), F.length("url").alias("position"), "url")
    _, fates = ingest.select_candidates(ingest._shaped(found), registry.policies(spark, publishers, sources), spark.createDataFrame([], "url string"))
    by_source = {r.url: r.fate for r in fates.collect()}
    ok = {f"https://a.example.org{u}" for u in ("/news/1", "/news/news", "/xy")}
    assert {u for u, why in by_list.items() if why is None} == ok == {u for u, fate in by_source.items() if fate == "new"}
    for pattern, said in [(r"(?P<q>a)(?P=q)\Z", ["aa", "a", "aa\n"]), ("[]x]+", ["]", "y"]), ("[a[b]", ["[", "c"]), ("[^]]", ["]", "x"]), (r"[\w&&[x]", ["&", "[", "-"]), (r"\(\?P<x>", ["(?P<x>", "x"])]:
        assert problem(pattern) is None
        for one in said:
            assert bool(re.search(pattern, one)) == spark.range(1).select(F.lit(one).rlike(translated(pattern))).first()[0], (pattern, one)
