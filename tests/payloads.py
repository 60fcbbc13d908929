"""Documents and arrivals that tests share."""

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>News</title>
<item><title>Young animal &amp;amp; friends</title><link>/article/young?utm_source=feed</link><guid>g1</guid><pubDate>Thu, 03 Apr 2025 09:30:00 GMT</pubDate><description>Short &lt;b&gt;text&lt;/b&gt;</description><dc:creator>Ann</dc:creator></item>
<item><title>Local date</title><link>https://EXAMPLE.org/article/local/</link><pubDate>7. März 2025</pubDate></item>
<item><title>By guid</title><guid>https://example.org/article/guid#x</guid><pubDate>TBA</pubDate></item>
<item><title>No link</title><pubDate>2025-04-03</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>urn:1</id><title>Entry</title><link rel="self" href="/self"/><link rel="alternate" href="/entry?b=2&amp;a=1"/><published>2023-11-05T06:07:08.246813579Z</published><author><name>Bo</name></author><summary>S</summary></entry></feed>"""
SITEMAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://example.org/a?utm_medium=x</loc><lastmod>2025-04-03</lastmod></url><url><loc>/b/</loc><lastmod>not-a-date</lastmod></url></urlset>"""
INDEX = """<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://example.org/s1.xml</loc></sitemap><sitemap><loc>https://example.org/index.xml</loc></sitemap></sitemapindex>"""
API = """{"data": {"items": [{"id": 7, "headline": "One", "links": {"html": "/n/1?utm_campaign=z"}, "publishedAt": "2025-04-03T09:30:00Z", "author": {"name": "Cy"}}, {"Headline": "Two", "url": "/n/1"}, {"title": "Three", "href": "https://example.org/n/3", "date": "someday"}, {"title": "no link"}]}}"""
PAGE1 = """<main><article class="news-grid-item"><a href="/n/1"><h3 itemprop="headline">First</h3></a><time datetime="2025-04-03">3 April</time></article><article class="news-grid-item"><a href="/n/1?utm_source=x">again</a></article><article class="news-grid-item"><h3>no link</h3></article><a class="next" href="/archive?page=2&amp;cHash=A1">next</a></main>"""
PAGE2 = """<main><article class="news-grid-item"><a href="/n/2">Second</a><time>12 agosto 2022</time></article><article class="news-grid-item"><a href="/n/1">First again</a></article><a class="next" href="/archive">first</a></main>"""
CARDS = {"item_selector": "article.news-grid-item", "title_selector": "[itemprop=headline]"}

#: arrival, publisher, url, title, content hash; each hundred is one case.
ARRIVALS = [
    (101, None, "https://e.org/one", "First story", "card-a"), (102, None, "https://e.org/two", "Second story", "card-a"),
    (201, None, "https://e.org/h1", "Shared story", "card-b"), (202, None, "https://e.org/h2", "Shared story", "card-b"),
    (301, None, None, "First title", "card-c"), (302, None, None, "Second title", "card-c"), (303, None, None, " first   TITLE ", "card-c"),
    (401, None, None, None, "card-d"), (402, None, None, None, "card-d"),
    (501, None, "https://e.org/k?utm_source=x", "Before", "old-hash"), (502, None, "https://e.org/k", "After", "new-hash"),
    (601, None, "https://e.org/c1", "One", "shared"), (602, None, "https://e.org/c2", "Two", "shared"), (603, None, "https://e.org/c1", "Two", "shared"),
    (701, "p1", "https://e.org/t1", "Straße", "x1"), (702, "p1", None, "STRASSE", "x2"), (703, "p2", "https://e.org/t3", "Straße", "x3"),
]
