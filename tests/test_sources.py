import json

import pytest

from broadsheet.sources import archives, articles, feeds, jsonapi, markup, registry


def test_tree_and_selectors():
    page = markup.parse('<div id=a class="x y"><p>one<p>two <b>three</b><ul><li>a<li>b</ul><img src=q><a href="/n?b=2">L</a></div><div class="y"><a data-k="v-1">M</a></div>')
    said = lambda s: [n.text() for n in page.select(s)]
    assert said("p") == ["one", "two three"] and said("div.x > ul li") == ["a", "b"]
    assert said("#a a, [data-k^=v]") == ["L", "M"] and said("div:not(.x) a") == ["M"] and said("a[href*='b=']") == ["L"]
    assert said("div > b") == [] and page.first("[data-k$='1']").text() == "M"
    with pytest.raises(ValueError):
        page.select("p >> !")


def test_feed_encodings_and_malformed():
    assert feeds.feed_items(b"\xff\xfe not xml", "https://e.org") == [] and feeds.feed_items(None, None) == []
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><link>/x</link><title>é</title></item></channel></rss>'.encode("latin-1")
    assert feeds.feed_items(latin, "https://e.org")[0]["title"] == "é"
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel/><item><link>/r</link><title>R</title></item></rdf:RDF>'
    assert [i["url"] for i in feeds.feed_items(rdf, "https://e.org")] == ["https://e.org/r"]
    twice = "<rss><channel><item><link>/a</link></item><item><link>/a</link></item></channel></rss>"
    assert len(feeds.feed_items(twice, "https://e.org")) == 2


def test_robots():
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: bot\nDisallow: /\n"
    assert feeds.robots_allows(text, "other", "/x") and not feeds.robots_allows(text, "other", "/private/x") and feeds.robots_allows(text, "other", "/private/open/1")
    assert not feeds.robots_allows(text, "MyBot/1.0", "/x") and feeds.robots_allows("", "x", "/")


def test_json_paths():
    value = {"A": [{"b/c": {"d~e": 5}}]}
    assert jsonapi.get(value, "a[0].b/c") == {"d~e": 5} and jsonapi.get(value, "/A/0/b~1c/d~0e") == 5 and jsonapi.get(value, ["A", 0]) == value["A"][0]
    assert jsonapi.get(value, "A.9") is None and jsonapi.parts(".".join("x" * 17)) == []
    items = [{"url": f"/n/{i}"} for i in range(5)]
    assert len(jsonapi.json_items('{"results": ' + str(items).replace("'", '"') + "}", "https://e.org", {"max_items": 3})) == 3
    assert jsonapi.json_items("{", "https://e.org") == []


def test_archive_next_link_is_kept_verbatim():
    assert archives.next_page('<a class=n href="/a?page=2&amp;utm_source=x&amp;cHash=Z">n</a>', "https://e.org/a", "a.n") == "https://e.org/a?page=2&utm_source=x&cHash=Z"


PAGE = """<html lang="de_de"><head><link rel="Canonical" href="/a?utm_x=1"><meta property="og:title" content="T &amp;amp; x"><meta name="date" content="bad"><meta name="description" content="D">
<script type="application/ld+json">{"@graph":[{"@type":"https://schema.org/NewsArticle","datePublished":"2025-04-03","dateModified":"2025-04-04T00:00:00Z","author":[{"name":"A"}],"image":{"url":"/i.png"}}]}</script><script type="application/ld+json">{broken</script></head>
<body><article class="news-card"><p>teaser</p></article><article><h1>H</h1><p onclick="x()">Body <a href="java&#10;script:alert(1)">b</a><custom>kept</custom><script>x</script><svg><p>no</p></svg><p>more</article></body></html>"""


def test_article():
    a = articles.article(PAGE, "https://e.org/q")
    assert a["canonical_url"] == "https://e.org/a" and a["title"] == "T & x" and a["author"] == "A" and a["summary"] == "D" and a["language"] == "de-DE"
    assert a["content"] == "H Body bkept more" and "script" not in a["content_html"] and "<a>b</a>" in a["content_html"] and "onclick" not in a["content_html"]
    assert a["image_url"] == "https://e.org/i.png" and a["parse_status"] == "success" and a["errors"] == [] and a["published_raw"] == "2025-04-03"


def test_article_errors():
    a = articles.article('<title>T</title><meta name="date" content="never"><p>x</p>', "https://e.org/q")
    assert a["parse_status"] == "content_parse_error" and [e.split(":")[0] for e in a["errors"]] == ["date_parse_error", "content_parse_error"]
    assert articles.article("<article>text</article>", None)["parse_status"] == "partial"
    assert articles.article(None, None)["content_hash"] is None


def test_configured_root():
    page = '<h1>Site</h1><section id="content"></section><section id="content"><h1>Own</h1><p>Body</p><div class="ad">no</div><p>Berlin, 7. März 2025</p></section><article>other</article>'
    config = {"article_content_selector": "section#content", "article_content_exclude_selector": [".ad"], "article_date_selector": "p", "article_date_pattern": r".*?(?P<day>\d+)\. (?P<month>\w+) (?P<year>\d{4})"}
    a = articles.article(page, None, config)
    assert a["content"] == "Own Body Berlin, 7. März 2025" and a["title"] == "Own" and a["date_only"] and a["published_at"].month == 3
    assert articles.article(page, None, {"article_content_selector": "#none"})["content"] is None
    main = "<main><nav>menu</nav><p>prose</p></main>"
    assert articles.article(main, None)["content"] == "prose" and articles.article("<main><a>x</a></main>", None)["content"] is None


def test_broken_pages_fail_alone(spark):
    deep = "<div>" * 5000 + "x"
    found = articles.article_scan(spark.createDataFrame([("https://e.org/1", f"<article>{deep}</article>"), ("https://e.org/2", PAGE), ("https://e.org/3", None)], "url string, content string")).collect()
    assert {r.url[-1]: r.parse_status for r in found} == {"1": "failed", "2": "success", "3": "content_parse_error"}


def test_registry():
    publishers, sources = registry.read("publishers:\n  - {id: a, website_url: 'https://A.example.org', enabled: 'no', metadata: {host_aliases: [b.example.org]}, sources: [{url: 'https://b.example.org/f', adapter: html-list}]}\n")
    assert not publishers[0]["enabled"] and sources[0]["kind"] == "archive" and registry.issues(publishers, sources) == []
    assert registry.policy(publishers[0], sources[0])["hosts"] == ["b.example.org"] and registry.source_id("a", "https://b.example.org/f/") == sources[0]["id"]
    assert registry.host("https://x") is None and registry.host("X.org.") == "x.org"


def test_small_tables_of_pages_are_work_for_all_cores(spark):
    from broadsheet import plans

    plans.load()
    assert plans.QUERIES["article_fields"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_articles_are_given_on_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"content": PAGE, "url": f"https://e.org/{i}"} for i in range(2 * articles.ROWS + 1)])
    found = list(articles.parse_articles([batch]))
    assert [b.num_rows for b in found] == [articles.ROWS, articles.ROWS, 1] and len({r["url"] for b in found for r in b.to_pylist()}) == batch.num_rows


def test_large_sitemaps_are_read_piece_by_piece():
    from types import GeneratorType

    said = "<urlset>" + "".join(f"<url><loc>/o/{i}</loc></url>" for i in range(10_000)) + "</urlset>"
    for payload in (said, said.encode()):
        found = feeds.sitemap_entries(payload, "https://e.org/s.xml")
        assert isinstance(found, GeneratorType) and [(e["position"], e["url"]) for e in found] == [(i, f"https://e.org/o/{i}") for i in range(10_000)]
    assert list(feeds.sitemap_entries(said[:-1], "https://e.org/s.xml")) == [] and list(feeds.sitemap_entries(None, None)) == []


def test_items_come_without_arrays(spark):
    docs = spark.createDataFrame([("https://e.org/api", json.dumps([{"url": f"/{i}"} for i in range(1200)])), ("https://e.org/none", "[]")], "url string, content string")
    found = jsonapi.json_scan(docs, {"max_items": 1000})
    assert found.count() == 1000 and "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_archive_pages_are_parsed_once(monkeypatch):
    seen, parse = [], archives.markup.parse
    monkeypatch.setattr(archives.markup, "parse", lambda text: seen.append(text) or parse(text))
    row = {"content": '<article><a href="/n">N</a></article><a class="next" href="?p=2">next</a>', "config": json.dumps({"next_selector": "a.next"}), "page_url": "https://e.org/a"}
    assert [(r.get("url"), r.get("next")) for r in archives._step(row, True)] == [("https://e.org/n", None), (None, "https://e.org/a?p=2")] and len(seen) == 1


def test_pages_are_walked_once_not_once_a_tag(monkeypatch):
    walked, walk = [], markup.Node.walk
    monkeypatch.setattr(markup.Node, "walk", lambda self: walked.append(self.tag) or walk(self))
    assert articles.article(PAGE, "https://e.org/1")["parse_status"] == "success" and "#document" not in walked


def test_plain_pieces_are_read_as_by_the_standard_parser(monkeypatch):
    from html.parser import HTMLParser

    def told(node):
        return [node.tag, *node.attrs.items(), "".join(c if isinstance(c, str) else str(told(c)) for c in node.children)]

    odd = ["<p>", "</p>", '<P class="x" class="y">', "<a href='/y&amp;z'>", "<a href=x>", '<a title="a>b"/>', '<a title="', '<a href="1"rel="2">', "<br/>", "<img alt='&quot;' />", "<script>", "</SCRIPT >", '<script type="x">a<b', "</script>", "<style/>", "<title>", "<!-- a > b -->", "<!--x-->", "<!-->", "<!doctype html>", "<![CDATA[", "<?php ?>", "</ >", "<", "&amp", "&lt;", "text ", '<p\x0bid="x">', "<li>", "<td>", "</b\n>", "<plaintext>"]
    pages = ["".join(odd[(i * j * j + i) % len(odd)] for j in range(1, 2 + i % 9)) for i in range(3000)]
    found = [told(markup.parse(p)) for p in pages]
    monkeypatch.setattr(markup._Builder, "goahead", HTMLParser.goahead)
    assert found == [told(markup.parse(p)) for p in pages]
    document = markup.parse("<p class=x>1</p><div><p>2</p><b>3</b></div>")
    assert [[n.text() for n in document.select(s)] for s in ("p", "P.x", "div > p", "p, b", "*", "div p:not(.x)", "i")] == [["1", "2"], ["1"], ["2"], ["1", "2", "3"], ["1", "2 3", "2", "3"], ["2"], []]


def test_plain_links_resolve_as_all_others(monkeypatch):
    import re

    from broadsheet.functions import urls

    links = ["/order/1?utm_source=x", "/a/./b", "/a/../b", "/a//b", "/a/", "/", "//e.net/x", "https://e.net/i.png", "HTTPS://e.net/x", "https://u@e.net/x", "https://e.net:443/x", "/x?utm_a=1&b=2", "/x?b=2", "/x#f", "/...", "/.x", "x", "ftp://e.net/x", "/é"]
    bases = ["https://e.org/p/1", "http://e.org", "https://E.org/", "https://e.org:443/", "https://[", "", None]
    found = [urls.resolve(b, link) for b in bases for link in links]
    monkeypatch.setattr(urls, "_PLAIN", re.compile("(?!)"))
    assert found == [urls.resolve(b, link) for b in bases for link in links] and found[0] == "https://e.org/order/1"
