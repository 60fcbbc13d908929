"""Document queries: scans of feeds, sitemaps, APIs and archives, registries, and identity resolution.

The tables hold no such documents, so Spark writes them out of orders and suppliers: a feed, an API answer and an archive a
customer, indexes of sitemaps, a registry of suppliers. The SQL states what must come out, from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.operators import corpus, identity
from broadsheet.sources import archives, feeds, jsonapi, registry
from broadsheet.sources.scratch import scratch_dir, staged

from .registry import Tables, query

GERMAN = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
CARDS = {"item_selector": "article.news-grid-item", "title_selector": "[itemprop=headline]"}


def order_key():
    return F.col("o_orderkey")


def order_day():
    return F.col("o_orderdate")


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def text(*parts):
    """Parts one after the other: columns, numbers as text, and plain strings."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def named_day(months: tuple[str, ...] = GERMAN, between: str = ". "):
    return text(F.dayofmonth(order_day()), between, F.element_at(F.array(*map(F.lit, months)), F.month(order_day())), " ", F.year(order_day()))


def documents(rows: DataFrame, url, before: str, after: str, between: str = "") -> DataFrame:
    """(url, content): the pieces of rows (o_orderkey, piece) that share a URL, in order of the key."""
    pieces = rows.groupBy(url.alias("url")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "piece"))).alias("all"))
    return pieces.select("url", text(before, F.array_join("all.piece", between), after).alias("content"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate AS t, o_custkey % 3 = 0 AS atom FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 4 < 3)
SELECT 'https://example.org/c/' || c AS feed_url, CAST(row_number() OVER (PARTITION BY c ORDER BY k) - 1 AS INTEGER) AS position, 'https://example.org/order/' || k || CASE WHEN atom THEN '?a=1&b=2' ELSE '' END AS url, 'Order & ' || k AS title,
  CASE WHEN atom THEN 'Bo' WHEN k % 4 = 0 THEN 'Ann' END AS author, CASE WHEN atom OR k % 4 < 2 THEN strftime(t, '%Y-%m-%d 00:00:00.000000') END AS published, NOT atom AND k % 8 = 6 AS bad_date FROM o""")
def feed_items(spark, d):
    """Items of RSS and Atom feeds, one a customer: links, identifiers as links, dates of several forms; a missing date on purpose is no error."""
    o = Tables(spark, d).orders
    dated = F.when(order_key() % 4 == 0, F.date_format(order_day(), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(order_key() % 4 == 1, named_day()).otherwise(F.when(order_key() % 8 == 2, "TBA").otherwise("someday"))
    link = F.when(order_key() % 4 == 0, text("<link>/order/", order_key(), "?utm_source=feed</link><dc:creator>Ann</dc:creator>")).when(order_key() % 4 == 1, text("<link>https://EXAMPLE.org/order/", order_key(), "/</link>")).when(order_key() % 4 == 2, text("<guid>https://example.org/order/", order_key(), "#x</guid>")).otherwise("")
    rss = o.where("o_custkey % 3 <> 0").withColumn("piece", text("<item><title>Order &amp;amp; ", order_key(), "</title>", link, "<pubDate>", dated, "</pubDate></item>"))
    atom = o.where("o_custkey % 3 = 0").withColumn("piece", text("<entry><id>urn:", order_key(), "</id><title>Order &amp;amp; ", order_key(), '</title><link rel="self" href="/self"/><link rel="alternate" href="/order/', order_key(), '?b=2&amp;a=1"/><published>', F.date_format(order_day(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</published><author><name>Bo</name></author></entry>"))
    url = text("https://example.org/c/", F.col("o_custkey"))
    docs = documents(rss, url, '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>', "</channel></rss>").unionByName(documents(atom, url, "<feed>", "</feed>"))
    return feeds.feed_scan(docs).select("feed_url", "position", "url", "title", "author", _time("published_at").alias("published"), F.col("date_problem").isNotNull().alias("bad_date"))


@query("""SELECT 'https://example.org/i' || o_custkey % 40 || '.xml' AS root_url, 'https://example.org/s' || o_custkey % 40 || '-' || o_orderkey % 5 || '.xml' AS sitemap_url, 'https://example.org/o/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'not-a-date' END AS last_modified_raw, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00.000000') END AS modified FROM orders""")
def sitemap_entries(spark, d):
    """Entries of the sitemaps that indexes lead to, although each index names itself as well."""
    o = Tables(spark, d).orders
    leaf = text("https://example.org/s", F.col("o_custkey") % 40, "-", order_key() % 5, ".xml")
    place = F.when(order_key() % 2 == 0, text("https://example.org/o/", order_key(), "?utm_medium=x")).otherwise(text("/o/", order_key(), "/"))
    entries = o.withColumn("piece", text("<url><loc>", place, "</loc><lastmod>", F.when(order_key() % 3 > 0, F.date_format(order_day(), "yyyy-MM-dd")).otherwise("not-a-date"), "</lastmod></url>"))
    maps = documents(entries, leaf, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
    root = text("https://example.org/i", F.col("o_custkey") % 40, ".xml")
    of = o.groupBy(root.alias("root")).agg(F.array_sort(F.collect_set(leaf)).alias("leaves"))
    named = F.array_join(F.transform(F.concat("leaves", F.array("root")), lambda u: text("<sitemap><loc>", u, "</loc></sitemap>")), "")
    roots = of.select(F.col("root").alias("url"), text("<sitemapindex>", named, "</sitemapindex>").alias("content"))
    docs = staged(maps.unionByName(roots), "sitemaps")
    x = feeds.sitemap_walk(docs, docs.where("url like '%/i%'").select("url"))
    return x.select("root_url", "sitemap_url", "url", "last_modified_raw", _time("last_modified").alias("modified"))


@query("""SELECT 'https://example.org/api/' || o_custkey AS api_url, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, 'https://example.org/n/' || o_orderkey AS url, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Cy' END AS author, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS identifier, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00.000000') END AS published,
  CASE WHEN o_orderkey % 3 = 1 THEN 'date could not be parsed: ' || chr(39) || 'someday' || chr(39) END AS date_problem FROM orders WHERE o_orderkey % 3 < 2""")
def json_items(spark, d):
    """Items of API answers, one a customer: fields by several names, repeats and items without a link left out."""
    full = text('{"id": ', order_key(), ', "headline": "Order ', order_key(), '", "links": {"html": "/n/', order_key(), '?utm_campaign=z"}, "publishedAt": "', F.date_format(order_day(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), '", "author": {"name": "Cy"}}, {"Headline": "again", "url": "/n/', order_key(), '"}')
    piece = F.when(order_key() % 3 == 0, full).when(order_key() % 3 == 1, text('{"title": "Order ', order_key(), '", "href": "https://example.org/n/', order_key(), '", "date": "someday"}')).otherwise('{"title": "no link"}')
    docs = documents(Tables(spark, d).orders.withColumn("piece", piece), text("https://example.org/api/", F.col("o_custkey")), '{"data": {"items": [', "]}}", ", ")
    x = jsonapi.json_scan(docs, {"max_items": 1000})
    return x.select("api_url", "position", "url", "title", "author", "identifier", _time("published_at").alias("published"), "date_problem")


@query("""SELECT 'https://example.org/a/' || o_custkey AS root_url, 'https://example.org/n/' || o_orderkey AS url, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS INTEGER) AS page, 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d 00:00:00.000000') AS published FROM orders""")
def archive_items(spark, d):
    """Cards of archives, one a customer with eight cards a page, along next links; repeats within and across pages left out."""
    place = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = Tables(spark, d).orders.select("*", F.floor((F.row_number().over(place) - 1) / 8).alias("p"), F.lag("o_orderkey", 1, 0).over(place).alias("was"), F.floor((F.count("*").over(W.partitionBy("o_custkey")) - 1) / 8).alias("last"))
    card = text('<article class="news-grid-item"><a href="/n/', order_key(), '"><h3 itemprop="headline">Order ', order_key(), '</h3></a><time datetime="', F.date_format(order_day(), "yyyy-MM-dd"), '">x</time></article><article class="news-grid-item"><a href="/n/', order_key(), '?utm_source=x">again</a></article><article class="news-grid-item"><h3>no link</h3></article>')
    at = lambda p: text("/a/", F.col("o_custkey"), F.when(p == 0, "").otherwise(text("?page=", p, "&cHash=A", p)))
    follow = F.when(F.col("p") < F.col("last"), text('<a class="next" href="', F.replace(at(F.col("p") + 1), F.lit("&"), F.lit("&amp;")), '">next</a>')).otherwise(text('<a class="next" href="/a/', F.col("o_custkey"), '">first</a>'))
    docs = staged(documents(o.withColumn("piece", F.concat(card, follow)), text("https://example.org", at(F.col("p"))), "<main>", "</main>"), "archives")
    x = archives.archive_walk(docs, docs.where("not contains(url, '?')").select("url"), "a.next", CARDS)
    return x.select("root_url", "url", "page", "title", _time("published_at").alias("published"))


#: Within each supplier: arrival, publisher, path, title, content hash, and what becomes of it. Each hundred is one case.
CASES = [
    (101, None, "one", "First story", "card-a", 101, "created"), (102, None, "two", "Second story", "card-a", 102, "created"),
    (201, None, "h1", "Shared story", "card-b", 201, "created"), (202, None, "h2", "Shared story", "card-b", 201, "unchanged"),
    (301, None, None, "First title", "card-c", 301, "created"), (302, None, None, "Second title", "card-c", 302, "created"), (303, None, None, " first   TITLE ", "card-c", 301, "updated"),
    (401, None, None, None, "card-d", 401, "created"), (402, None, None, None, "card-d", 402, "created"),
    (501, None, "k?utm_source=x", "Before", "old-hash", 501, "created"), (502, None, "k", "After", "new-hash", 501, "updated"),
    (601, None, "c1", "One", "shared", 601, "created"), (602, None, "c2", "Two", "shared", 601, "created"), (603, None, "c1", "Two", "shared", 601, "updated"),
    (701, "p1", "t1", "Straße", "x1", 701, "created"), (702, "p1", None, "STRASSE", "x2", 701, "updated"), (703, "p2", "t3", "Straße", "x3", 703, "created"),
]


@query(f"""SELECT s_suppkey * 1000 + n AS arrival_seq, s_suppkey * 1000 + a AS article_id, outcome FROM supplier CROSS JOIN (VALUES {", ".join(f"({c[0]}, {c[5]}, '{c[6]}')" for c in CASES)}) v(n, a, outcome)""")
def identity_resolution(spark, d):
    """Outcome of each arrival under the ordered rule of identity: every case once for each supplier, with URLs, hashes and publishers of its own."""
    cases = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for n, t, x in zip(("n", "p", "path", "title", "hash"), ("long", *["string"] * 4), c[:5], strict=True)]) for c in CASES])
    x = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("s"), F.inline(cases))
    own = lambda c: text(F.col(c), "-", F.col("s"))
    rows = x.select((F.col("s") * 1000 + F.col("n")).alias("arrival_seq"), own("p").alias("publisher_id"), text("https://s", F.col("s"), ".example.org/", F.col("path")).alias("url"), "title", own("hash").alias("content_hash"))
    outcomes, _ = identity.resolve(rows)
    return outcomes.select("arrival_seq", "article_id", "outcome")


BY_URL = """WITH x AS (SELECT doc_id, 'https://' || source || '.example.org/' || CAST(doc_id % 400 AS VARCHAR) AS url, lang || ' ' || CAST(doc_id % 400 AS VARCHAR) AS title FROM documents),
k AS (SELECT url, count(DISTINCT title) AS t, min(doc_id) AS first_id FROM x GROUP BY 1) SELECT x.doc_id, k.first_id AS article_id, CASE WHEN x.doc_id = k.first_id THEN 'created' WHEN lag(title) OVER (PARTITION BY x.url ORDER BY x.doc_id) = title THEN 'unchanged' ELSE 'updated' END AS outcome FROM x JOIN k USING (url)"""


def _by_url(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), (F.col("doc_id") % 400).cast("string"))
    return x.select(F.col("doc_id").alias("arrival_seq"), url.alias("url"), F.concat("lang", F.lit(" "), (F.col("doc_id") % 400).cast("string")).alias("title"))


@query(BY_URL)
def identity_by_url(spark, d):
    """The same resolution over a whole table, where URLs alone decide, which SQL can check."""
    outcomes, _ = identity.resolve(_by_url(spark, d))
    return outcomes.select(F.col("arrival_seq").alias("doc_id"), "article_id", "outcome")


@query(BY_URL)
def identity_two_loads(spark, d):
    """The same arrivals, the later half of them loaded into a stored corpus of the earlier half."""
    rows = _by_url(spark, d)
    half = rows.agg(F.percentile_approx("arrival_seq", 0.5)).first()[0]
    stored = corpus.Corpus(spark, f"{scratch_dir(spark).rstrip('/')}/broadsheet-corpus-{uuid.uuid4().hex}")
    stored.load(rows.where(F.col("arrival_seq") <= half))
    stored.load(rows.where(F.col("arrival_seq") > half))
    return stored.outcomes().select(F.col("arrival_seq").alias("doc_id"), "article_id", "outcome")


def registry_text(spark, d) -> str:
    """A registry of suppliers: every tenth has an id of wrong form, every fourth a source of unknown kind elsewhere."""
    suppliers = Tables(spark, d).supplier.select("s_suppkey").orderBy("s_suppkey").collect()  # a registry is read on the driver
    said = "publishers:\n"
    for (k,) in suppliers:
        said += f"  {'S_' if k % 10 == 3 else 's'}{k}:\n    name: Supplier {k}\n    website_url: https://s{k}.example.org/\n    language: de\n    sources:\n      - {{url: 'https://s{k}.example.org/feed', kind: feed}}\n"
        if k % 4 == 0:
            said += f"      - {{url: 'https://evil{k}.example.net/feed', kind: mystery, config: {{exclude_regex: '['}}}}\n"
    return said + "sources:\n  - {publisher_id: gamma, url: 'https://g.example.org/map.xml', kind: sitemap}\n"


_REGISTRY = """WITH p AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
s AS (SELECT k, odd, row_number() OVER (ORDER BY k, odd) - 1 AS j FROM (SELECT k, false AS odd FROM p UNION ALL SELECT k, true FROM p WHERE k % 4 = 0))
"""


@query(_REGISTRY + """SELECT 'publishers[' || i || '].' || c AS path, 'format' AS code FROM p CROSS JOIN (VALUES ('id'), ('slug')) v(c) WHERE k % 10 = 3
UNION ALL SELECT 'sources[' || j || '].' || c, code FROM s CROSS JOIN (VALUES ('kind', 'vocabulary'), ('url', 'host'), ('config.exclude_regex', 'regex')) v(c, code) WHERE odd
UNION ALL SELECT 'sources[' || (SELECT count(*) FROM s) || '].publisher_id', 'association'""")
def registry_issues(spark, d):
    """Broken rules of a registry of all suppliers."""
    return spark.createDataFrame(registry.issues(*registry.read(registry_text(spark, d))), "path string, code string, message string").select("path", "code")


@query(_REGISTRY + """SELECT CASE WHEN k % 10 = 3 THEN 'S_' ELSE 's' END || k AS publisher_id, CASE WHEN odd THEN 'mystery' ELSE 'rss' END AS kind, CASE WHEN odd THEN 'https://evil' || k || '.example.net/feed' ELSE 'https://s' || k || '.example.org/feed' END AS normalized_url, true AS enabled FROM s
UNION ALL SELECT 'gamma', 'sitemap', 'https://g.example.org/map.xml', true""")
def registry_sources(spark, d):
    """The sources of a registry of all suppliers."""
    return registry.frames(spark, *registry.read(registry_text(spark, d)))[1].select("publisher_id", "kind", "normalized_url", "enabled")
