"""Article pages: one record for each page, from what the page says about itself and from its body.

Each field has a list of places to look, in order of trust; the first that gives something usable wins. The body is a
configured root or a reliable one, rebuilt from allowed elements and attributes only.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from broadsheet.functions import dates, texts, urls

from .markup import Node, parse

_S, _TS = T.StringType(), T.TimestampType()
ARTICLE = T.StructType(
    [T.StructField(n, _S) for n in ("canonical_url", "title", "author", "summary", "content", "content_html", "image_url", "language", "parse_status", "content_hash", "html_hash", "published_raw")]
    + [T.StructField("published_at", _TS), T.StructField("date_only", T.BooleanType()), T.StructField("updated_at", _TS)]
    + [T.StructField("errors", T.ArrayType(_S)), T.StructField("metadata", T.MapType(_S, _S)), T.StructField("links", T.IntegerType())]
)

# Elements and attributes that an article's markup may keep, and elements that go with all they hold.
ALLOWED = frozenset("a abbr b blockquote br caption cite code dd del div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li ol p pre q s small span strong sub sup table tbody td tfoot th thead time tr u ul".split())
DROPPED = frozenset("base button canvas embed form iframe input link math meta noscript object option script select source style svg template textarea track video audio".split())
ATTRIBUTES = frozenset("alt aria-label class cite colspan datetime dir height id lang loading name role rowspan scope start title width href src".split())
LINKS = frozenset("cite href src".split())
# Class and id words of teasers and listings.
TEASERS = frozenset("card cards article-card news-card post-card teaser related related-post related-article news-grid-item grid-item list-item news-list-item post-highlights-block highlight-card recommend recommended highlights news-list archive navigation navbar menu breadcrumb".split())
TEASER_PARTS = ("related", "recommend", "highlight", "card", "teaser", "grid-item", "list-item", "news-grid", "news-item")
# Where pages say things.
PUBLISHED = ("article:published_time", "datepublished", "publish_date", "date", "pubdate")
UPDATED = ("article:modified_time", "datemodified", "lastmod", "updated")
IMAGES = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")
ARTICLE_TYPES = frozenset({"article", "newsarticle", "blogposting"})
#: Least length of a body without paragraphs.
PLAIN_BODY = 160


def teaser(node: Node) -> bool:
    for value in (node.attrs.get("class", "").split(), [node.attrs.get("id", "")]):
        for word in value:
            token = re.sub(r"[^a-z0-9]+", "-", word.casefold()).strip("-")
            if token and (token in TEASERS or any(p in token for p in TEASER_PARTS)):
                return True
    return False


def safe_reference(value: str | None) -> str | None:
    """An http(s) or relative reference; None for other schemes, however they are disguised."""
    said = html.unescape(value or "").strip()
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/?#]+)?", re.sub(r"[\x00-\x20]+", "", said))
    return None if not said or (m and (m[1].lower() not in ("http", "https") or not m[2])) else said


def _pruned(node: Node, gone) -> Node:
    """A copy without the nodes that ``gone`` names."""
    copy = Node(node.tag, dict(node.attrs))
    for child in node.children:
        if isinstance(child, str):
            copy.children.append(child)
        elif not gone(child):
            below = _pruned(child, gone)
            below.parent = copy
            copy.children.append(below)
    return copy


def _markup(node: Node) -> str:
    """Markup of what is below a node, from allowed elements and attributes; other elements leave their content."""
    out = []
    for child in node.children:
        if isinstance(child, str):
            out.append(html.escape(child, quote=False))
        elif child.tag in DROPPED:
            continue
        elif child.tag not in ALLOWED:
            out.append(_markup(child))
        else:
            kept = {k: safe_reference(v) if k in LINKS else v for k, v in child.attrs.items() if k in ATTRIBUTES}
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in kept.items() if v is not None)
            inner = _markup(child)
            out.append(f"<{child.tag}{attrs}/>" if child.tag in ("br", "hr", "img") else f"<{child.tag}{attrs}>{inner}</{child.tag}>")
    return "".join(out)


class Page:
    """What a page offers, by place."""

    def __init__(self, text: str, url: str | None, config: dict):
        self.root, self.url, self.config = parse(texts.ended(text) if config.get("ended_references") else text), url, config
        #: Where cut references are text, no text is resolved twice.
        self.clean = texts.tidy if config.get("ended_references") else texts.clean
        self.meta: dict[str, list[str]] = {}
        self.named: dict[str, str] = {}
        for m in self.root.select("meta[content]"):
            name = m.attrs.get("property") or m.attrs.get("name") or m.attrs.get("itemprop")
            if name and m.attrs["content"].strip():
                self.meta.setdefault(name.lower(), []).append(m.attrs["content"])
                self.named[name] = self.clean(m.attrs["content"])
        self.linked = list(self._linked())

    def _linked(self) -> Iterator[dict]:
        """Objects of structured data; what can't be read is skipped."""
        for script in self.root.select("script"):
            if "ld+json" in script.attrs.get("type", "").lower():
                try:
                    found = json.loads(script.raw())
                except ValueError:
                    continue
                for item in found if isinstance(found, list) else [found]:
                    if isinstance(item, dict):
                        graph = item.get("@graph")
                        yield from (g for g in (graph if isinstance(graph, list) else [item]) if isinstance(g, dict))

    def said(self, *names: str) -> Iterator[str]:
        for n in names:
            yield from self.meta.get(n, ())

    def typed(self, *also: str) -> Iterator[dict]:
        for item in self.linked:
            kinds = item.get("@type")
            kinds = {str(k).rsplit("/", 1)[-1].casefold() for k in (kinds if isinstance(kinds, list) else [kinds]) if k}
            if kinds & (ARTICLE_TYPES | set(also)):
                yield item

    def _matched(self, selector) -> list[Node]:
        try:
            return self.root.select(selector) if isinstance(selector, str) and selector.strip() else []
        except ValueError:
            return []

    def body(self) -> Node | None:
        """The configured root, the first with text; without configuration the first article that is no teaser, or a main with prose."""
        selector = self.config.get("article_content_selector")
        if isinstance(selector, str) and selector.strip():
            found = self._matched(selector)
            return next((n for n in found if n.text()), found[0] if found else None)
        for node in self.root.select("article"):
            if not teaser(node):
                return node
        for node in self.root.select("main"):
            if not teaser(node):
                prose = _pruned(node, lambda n: n.tag in ("aside", "nav", "footer", "header") or teaser(n))
                said = prose.text()
                if said and (prose.first("p, blockquote, figure, table, pre") or (len(said) >= PLAIN_BODY and not prose.first("a"))):
                    return prose
        return None

    def excluded(self, body: Node) -> Node:
        selectors = self.config.get("article_content_exclude_selector") or []
        gone: set[int] = set()
        for s in [selectors] if isinstance(selectors, str) else selectors:
            try:
                gone |= {id(n) for n in body.select(s)}
            except (ValueError, AttributeError):
                continue
        return _pruned(body, lambda n: id(n) in gone or n.tag in DROPPED)

    def dateline(self) -> tuple[datetime | None, str | None]:
        """A date in one of the first three nodes of a configured selector, by a configured pattern with day, month, year."""
        try:
            pattern = re.compile(self.config.get("article_date_pattern") or "(?!)", re.IGNORECASE)
        except re.error:
            return None, None
        for node in self._matched(self.config.get("article_date_selector"))[:3]:
            m = pattern.match(node.text())
            try:
                if m and (month := dates.MONTHS.get(texts.month_key(m["month"]))):
                    return datetime(int(m["year"]), month, int(m["day"]), tzinfo=UTC), node.text()
            except (IndexError, ValueError):
                continue
        return None, None


def _image(value) -> str | None:
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, dict):
        return next((i for k in ("url", "contentUrl", "thumbnailUrl") if (i := _image(value.get(k)))), None)
    return next((i for v in value if (i := _image(v))), None) if isinstance(value, list) else None


def _author(value) -> str | None:
    if isinstance(value, list):
        return next((a for v in value if isinstance(v, dict) and (a := _author(v))), None)
    value = value.get("name") if isinstance(value, dict) else value
    return value if isinstance(value, str) else None


def _dated(candidates: Iterator[str | None], field: str) -> tuple[datetime | None, str | None, list[str]]:
    """(time, its text, problems) of the first candidate that can be read; without one, the first text."""
    first, problems = None, []
    for value in candidates:
        raw = html.unescape(str(value)).strip() if value is not None else ""
        if not raw:
            continue
        found = dates.parse(raw)
        if found:
            return found, raw, []
        first = first or raw
        if (p := dates.problem(raw)) and (p := f"{field}: {p}") not in problems:
            problems.append(p)
    return None, first, problems


def article(payload: bytes | str | None, url: str | None = None, config: dict | None = None) -> dict:
    text = payload.decode("utf-8", "replace") if isinstance(payload, bytes) else payload or ""
    page, config = Page(text, url, config or {}), config or {}
    resolved = lambda values: next((u for v in values if (u := urls.resolve(url, v))), None)
    canonical = resolved([n.attrs.get("href") for n in page.root.select("link[rel]") if "canonical" in n.attrs["rel"].lower().split()] + [*page.said("og:url", "twitter:url")])
    root = page.body()
    configured = bool(str(config.get("article_content_selector") or "").strip())
    headings = ([root.first("h1")] if configured and root is not None else []) + [page.root.first("h1"), page.root.first("title")]
    title = next((t for t in [*map(page.clean, page.said("og:title", "twitter:title")), *(h.text() for h in headings if h)] if t), None)

    def published() -> Iterator[str | None]:
        yield from page.said(*PUBLISHED)
        yield from (i.get("datePublished") for i in page.typed())
        for n in page.root.select("time"):
            yield n.attrs.get("datetime")
            yield n.text()

    at, raw, problems = _dated(published(), "published_at")
    date_only = False
    if at is None:
        line, said = page.dateline()
        if line:
            at, raw, problems, date_only = line, said, [], True
    updated, _, late = _dated([*page.said(*UPDATED), *(i.get("dateModified") for i in page.typed())], "updated_at")

    content = markup = None
    if root is not None:
        body = page.excluded(root)
        content, markup = body.text() or None, _markup(body).strip() or None
        shown = [body, page.root] if body.first("img") else [page.root]
    else:
        shown = [page.root]
    images = [*page.said(*IMAGES), *(_image(i.get("image") or i.get("thumbnailUrl")) for i in page.typed())]
    for n in shown[0].select("img"):
        images.append(next((v for v in (n.attrs.get("src"), n.attrs.get("data-src"), n.attrs.get("data-lazy-src"), n.attrs.get("srcset", "").split(",")[0].split(" ")[0]) if v), None))
    errors = [f"date_parse_error: {p}" for p in problems + late]
    if not content:
        errors.append("content_parse_error: " + ("no usable text" if root is not None else "no article content"))
    spoken = [*page.said("content-language", "language", "article:language", "og:locale"), *(i.get("inLanguage") for i in page.typed("webpage"))]
    top = page.root.first("html")
    language = next((t for t in map(texts.language_tag, [top.attrs.get("lang") if top else None, *(s for s in spoken if isinstance(s, str))]) if t), None)
    status = "content_parse_error" if not content else "success" if title and at else "partial"
    identity = content or markup
    naive = lambda v: v.astimezone(UTC).replace(tzinfo=None) if v else None
    return {
        "canonical_url": canonical, "title": page.clean(title), "author": page.clean(next((a for a in [*page.said("author", "article:author", "byline"), *(_author(i.get("author")) for i in page.linked)] if a), None)),
        "summary": page.clean(next((s for s in [*page.said("og:description", "twitter:description", "description"), *(i.get("description") for i in page.linked)] if isinstance(s, str) and s.strip()), None)),
        "content": content, "content_html": markup, "image_url": resolved(images), "language": language, "parse_status": status,
        "content_hash": hashlib.sha256(identity.encode("utf-8", "surrogatepass")).hexdigest() if identity else None, "html_hash": hashlib.sha256(payload if isinstance(payload, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest(),
        "published_raw": raw, "published_at": naive(at), "date_only": date_only, "updated_at": naive(updated), "errors": errors, "metadata": page.named, "links": len(page.root.select("a[href]")),
    }


#: What an article is to Arrow.
_ARROW = {"string": pa.string(), "timestamp": pa.timestamp("us", tz="UTC"), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_RECORD = pa.schema([("url", pa.string()), *[(f.name, _ARROW[f.dataType.simpleString()]) for f in ARTICLE.fields]])
#: Articles that are given on at once.
ROWS = 100


def parse_articles(batches: Iterable[pa.RecordBatch], config: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Articles of (url, content), a few at a time; a page that breaks the parser yields a failed record, never a failed task."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            out = []
            for row in batch.slice(at, ROWS).to_pylist():
                try:
                    found = article(row["content"], row["url"], config)
                except (ValueError, RecursionError, TypeError, AttributeError) as e:
                    found = dict.fromkeys(ARTICLE.names) | {"parse_status": "failed", "errors": [f"parse_error: {type(e).__name__}"], "metadata": {}, "links": 0, "date_only": False}
                out.append(found | {"url": row["url"], "metadata": list(found["metadata"].items())})
            yield pa.RecordBatch.from_pylist(out, _RECORD)


def article_scan(documents: DataFrame, config: dict | None = None) -> DataFrame:
    """documents (url, content) -> one row a page. Filter and cap documents first: no filter moves below the parser."""
    schema = T.StructType([T.StructField("url", _S), *ARTICLE.fields])
    return documents.select("url", "content").mapInArrow(lambda batches: parse_articles(batches, config), schema)
