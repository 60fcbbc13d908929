from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from broadsheet import functions
from broadsheet.functions import classify, coerce, dates, texts, urls


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("HTTPS://Example.COM/news///?utm_source=mail&b=2&a=1#comments", "https://example.com/news?a=1&b=2"),
        ("https://example.com/search?tag=z&tag=a", "https://example.com/search?tag=a&tag=z"),
        ("http://e.org:80", "http://e.org/"),
        ("https://e.org:8443/x/", "https://e.org:8443/x"),
        ("https://User:pw@E.org./x?q=a b&_ga=1&fbclid=2", "https://User:pw@e.org/x?q=a+b"),
        ("http://[2001:DB8::1]:80/a", "http://[2001:db8::1]/a"),
        ("/relative/path/?b=&a", "/relative/path?a=&b="),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize(raw, expected):
    assert urls.normalize(raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2025-04-03", datetime(2025, 4, 3)),
        ("2025-04-03T09:30:00Z", datetime(2025, 4, 3, 9, 30)),
        ("2025-04-03T09:30:00+02:00", datetime(2025, 4, 3, 7, 30)),
        ("Thu, 03 Apr 2025 09:30:00 GMT", datetime(2025, 4, 3, 9, 30)),
        ("7. März 2025", datetime(2025, 3, 7)),
        ("3 april 2025", datetime(2025, 4, 3)),
        ("5 février 2024", datetime(2024, 2, 5)),
        ("12 agosto 2022", datetime(2022, 8, 12)),
        ("lunes, 3 de marzo de 2025", datetime(2025, 3, 3)),
        ("March 3, 2025", datetime(2025, 3, 3)),
        ("2023-11-05T06:07:08.246813579Z", datetime(2023, 11, 5, 6, 7, 8, 246813)),
        ("2024-03-18T12:15:25.5Z", datetime(2024, 3, 18, 12, 15, 25, 500000)),
        ("03.04.2025", datetime(2025, 4, 3)),
        ("3.4.2025", datetime(2025, 4, 3)),
        ("29.02.2024", datetime(2024, 2, 29)),
    ],
)
def test_dates(raw, expected):
    assert dates.parse(raw) == expected.replace(tzinfo=UTC)


@pytest.mark.parametrize(
    "raw",
    ["", None, "not-a-date", "32 März 2025", "3 unknownmonth 2025", "2024-03-18T12:15:25.Z", "2024-03-18T12:15:25.1234567890Z", "2024-03-18T12:15:25.12+2:00", "2024-03-18T12:15:25.12+0200", "2024-03-18T12:15:25.12+02", "2024-03-18T12:15:25.12+99:00", "2024-03-18T12:15:25.12+02:60"]
    + ["29.02.2023", "31.04.2025", "00.01.2025", "01.13.2025", "01.01.25", "01-01-2025"],
)
def test_no_dates(raw):
    assert dates.parse(raw) is None


def test_missing_dates_are_no_problem():
    assert dates.problem("noch nicht veröffentlicht") is None and dates.problem("TBA") is None and dates.problem("") is None
    assert "soonish" in dates.problem("soonish")


def test_texts():
    assert texts.key("  Straße  ＡＢ ") == "strasse ab"
    assert texts.clean(" a &amp; \n b ") == "a & b" and texts.clean("  ") is None
    assert texts.language_tag("de_de") == "de-DE" and texts.language_tag("english") is None
    assert texts.safe_error("GET https://u:p@e.org/x?token=1 failed, password=abc Authorization: Bearer zzz") == "GET https://e.org/x failed, password=<redacted> Authorization: <redacted>"
    assert texts.overlay_json('{"a": 1, "b": 1}', '{"b": 2}') == '{"a": 1, "b": 2}' and texts.overlay_json("[", None) == "{}"
    assert texts.safe_metadata({"raw_html": "x", "api_key": 1, "n": float("nan"), "d": [1] * 200})["d"] == [1] * 100
    assert texts.decoded("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and texts.decoded(b"\xff", "x; charset=odd") == "\ufffd" and texts.decoded(None) is None
    assert texts.nested_text({"b": ["x", {"z": "y"}], "a": "w"}) == "w x y"


def test_resolution():
    assert urls.resolve("https://e.org/a/b", "../c?utm_source=1&x=2#f") == "https://e.org/c?x=2"
    assert urls.resolve_transport("https://e.org/a", "?page=2&cHash=A#x") == "https://e.org/a?page=2&cHash=A"
    assert urls.resolve("https://e.org", "javascript:alert(1)") is None and urls.resolve(None, "/x") is None
    assert urls.official_host("https://a@e.org/") is None and urls.official_host("http://e.org:99999/") is None
    assert urls.safe_target("https://u:p@E.org:443/x?q=1") == "https://e.org/x"


STATUSES = [("completed", None, False, "success"), ("warning", None, False, "warning"), ("failed", None, False, "failed"), ("running", None, False, "running"), ("stale", None, False, "stale"), ("mystery", None, False, "unknown")]
STATUSES += [("completed", "article_limit", False, "budget_hit"), ("completed", "http_error", False, "warning"), ("ok", None, True, "warning"), (None, None, True, "warning"), ("In Progress", None, True, "running")]


def test_display_status(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(STATUSES)], "i int, raw string, stop string, bad boolean, expected string")
    found = df.select("expected", classify.display_status(F.col("raw"), F.col("bad"), F.col("stop")).alias("s"), classify.status_label(F.lit("budget-hit")).alias("l")).collect()
    assert all(r.s == r.expected and r.l == "Budget Hit" for r in found)


def test_error_and_failure_classes(spark):
    cases = [("Read timed out", "timeout", "timeout"), ("robots.txt disallow", "robots_disallowed", None), ("HTTP 404", "http_error", "http_error"), ("HTTP status: 403", "blocked", None), ("getaddrinfo failed", "dns_error", None)]
    cases += [("SSL: wrong version number", "tls_error", None), ("no enabled sources configured", "unsupported", "failed"), ("config", "unsupported", "configuration_error"), ("date parse failed", "date_parse_error", None), ("", "unsupported", "failed"), ("partial", "unsupported", "partial")]
    df = spark.createDataFrame(cases, "m string, a string, b string").select("*", classify.error_class(F.col("m")).alias("x"), classify.failure_class(F.col("m")).alias("y"))
    for r in df.collect():
        assert r.x == r.a, r.m
        assert r.b is None or r.y == r.b, r.m
    one = df.select(classify.error_class(F.lit("x"), F.lit("Date-Parse-Error")).alias("e"), classify.error_class(F.lit("x"), status=F.lit(451)).alias("s"), classify.error_class(F.lit("x"), phase=F.lit("storage")).alias("p"), classify.http_class(F.lit(404)).alias("h")).first()
    assert tuple(one) == ("date_parse_error", "blocked", "configuration_error", "source_not_found")


def test_completion_and_quality(spark):
    one = spark.range(1).select(
        classify.completion(F.lit("HTTP 404"), F.lit(None).cast("string"), F.lit("failed")).alias("a"),
        classify.completion(F.lit(None).cast("string"), F.lit("success-no-items"), F.lit("completed")).alias("b"),
        classify.public_class(F.lit("parse_error")).alias("c"),
        classify.quality_warnings(F.lit(" "), F.lit("https://off.example.org/news/"), F.lit(False), F.lit(""), F.lit("2025-02-01").cast("timestamp"), F.lit("2020-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp"), F.lit(2), F.lit(2)).alias("w"),
        classify.retry_exhausted(F.lit("Retries were exhausted")).alias("r"),
    ).first()
    assert (one.a, one.b, one.c, one.r) == ("source_not_found", "success_no_items", "FAILED", True)
    assert one.w == ["duplicate_url", "empty_content", "empty_title", "future_date", "list_page_suspect", "non_official_host", "stale"]


def test_liveness(spark):
    now = "2025-01-01 12:00:00"
    cases = [("completed", None, None, None, "terminal_state"), ("running", None, None, None, "no_liveness_evidence"), ("running", "2025-01-01 11:59:00", None, None, "heartbeat_fresh"), ("running", "2025-01-01 11:55:00", None, None, "heartbeat_expired")]
    cases += [("active", None, "2025-01-01 12:01:00", None, "lease_fresh"), ("active", None, "2025-01-01 12:00:00", None, "lease_expired"), ("active", "2025-01-01 11:59:59", None, "Released", "lease_inactive"), ("odd", None, None, None, "unrecognized_run_status")]
    df = spark.createDataFrame(cases, "raw string, beat string, lease string, status string, expected string")
    _, reason = classify.liveness(F.col("raw"), F.lit(None).cast("timestamp"), F.col("beat").cast("timestamp"), F.col("lease").cast("timestamp"), F.col("status"), F.lit(now).cast("timestamp"))
    assert all(r.expected == r.r for r in df.select("expected", reason.alias("r")).collect())


def test_coercion(spark):
    df = spark.createDataFrame([("7", "yes", '["a","b"]', None), ("1.5", "off", "oops", "3"), (None, "?", "", "-2"), ("x", None, "[", "9" * 30)], "i string, b string, e string, c string")
    found = df.select(coerce.safe_int(F.col("i")).alias("i"), coerce.flag(F.col("b")).alias("b"), coerce.json_list(F.col("e")).alias("e"), coerce.count(F.col("c")).alias("c"), coerce.error_count(F.col("c"), F.col("e"), F.lit(None)).alias("n"), coerce.first_of(df, "missing", "I", default="d").alias("f")).collect()
    assert [r.i for r in found] == [7, None, None, None] and [r.b for r in found] == [True, False, None, None]
    assert [r.c for r in found] == [0, 3, 0, 0] and [r.n for r in found] == [2, 3, 0, 1] and found[2].f == "d"


def test_sql_registration(spark):
    assert "normalize_url" in functions.register(spark)
    assert spark.sql("SELECT normalize_url('HTTP://E.org/?utm_x=1') AS u, title_key('ＡＢ') AS k, parse_datetime('03.04.2025') AS t").first() == ("http://e.org/", "ab", datetime(2025, 4, 3))


def test_bounds(spark):
    df = spark.createDataFrame([("a", "2025-01-02", "2025-01-05"), ("a", "2025-01-01", None), ("b", "later", "2025-01-09"), ("b", "2025-01-01", None)], "k string, x string, y string")
    low, high = dates.bounds(F.col("x"), F.col("y"))
    assert pytest.rows(df.groupBy("k").agg(low.alias("a"), high.alias("b"))) == [("a", "2025-01-01", "2025-01-05"), ("b", "2025-01-01", "later")]


def test_links_and_display(spark):
    df = spark.createDataFrame([("https://c.example.org/start?x=1", "a b", "2025-01-02"), ("javascript:x", "a", "2025-01-02T03:04:05Z"), ("https://c.example.org/", "", "soon")], "b string, s string, t string")
    found = df.select(urls.control_link(F.col("b"), F.col("s")).alias("l"), dates.display(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in found] == [("https://c.example.org/start?x=1&source_id=a+b", "2025-01-02"), (None, "2025-01-02 03:04 UTC"), (None, "soon")]


def test_times_are_in_utc_whatever_the_session_says(spark):
    cases = [("2024-03-10 02:30:00", 1710037800.0, "2024-03-10T02:30:00.000000Z", "2024-03-10 02:30 UTC"), ("2024-03-10T02:30:00.000001-05:00", 1710055800.000001, "2024-03-10T07:30:00.000001Z", "2024-03-10 07:30 UTC")]
    cases += [("1969-12-31", -86400.0, "1969-12-31T00:00:00.000000Z", "1969-12-31"), ("10.03.2024", 1710028800.0, "2024-03-10T00:00:00.000000Z", "2024-03-10 00:00 UTC"), ("soon", float("-inf"), "soon", "soon")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = df.select("t", dates.score(F.col("t")), dates.stamp(F.col("t")), dates.display(F.col("t"))).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert [tuple(r) for r in found] == cases


def test_cut_references_stay_as_they_are():
    from broadsheet.sources.articles import article

    assert texts.ended("a &amp; b&ouml; &#38; &nosuch; &amp") == "a &amp; b&ouml; &#38; &amp;nosuch; &amp;amp" and texts.ended("<script>a && b</script>&") == "<script>a && b</script>&amp;"
    page = "<html><head><title>One &amp; two &amp</title></head><body></body></html>"
    assert article(page)["title"] == "One & two &" and article(page, None, {"ended_references": True})["title"] == "One & two &amp"
    assert article(page)["html_hash"] == article(page, None, {"ended_references": True})["html_hash"]


def test_title_keys_of_cut_references(spark):
    frame = spark.createDataFrame([("A &amp;&amp",), (None,)], "t string")
    assert [r[0] for r in frame.select(texts.title_key(texts.ended_text("t"))).collect()] == ["a &&amp", ""]
