"""Feeds and sitemaps: items of RSS, RDF and Atom documents, entries of sitemaps and their indexes."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import dates, texts, urls
from broadsheet.operators.joins import missing

from .scratch import staged

_S, _TS = T.StringType(), T.TimestampType()
ITEM = T.StructType(
    [T.StructField("position", T.IntegerType())]
    + [T.StructField(n, _S) for n in ("url", "canonical_url", "title", "summary", "author", "identifier")]
    + [T.StructField("published_at", _TS), T.StructField("published_raw", _S), T.StructField("updated_at", _TS), T.StructField("date_problem", _S)]
)
ENTRY = T.StructType(
    [T.StructField("position", T.IntegerType()), T.StructField("url", _S), T.StructField("last_modified", _TS), T.StructField("last_modified_raw", _S), T.StructField("is_index", T.BooleanType())]
)


def root(payload: bytes | str | None) -> ET.Element | None:
    """Root of an XML document; bytes that aren't what they declare are read as UTF-8 with replacement. None if malformed."""
    if not payload:
        return None
    for attempt in (payload, payload.decode("utf-8", "replace") if isinstance(payload, bytes) else None):
        try:
            if attempt is not None:
                return ET.fromstring(attempt)
        except (ET.ParseError, LookupError, ValueError):
            continue
    return None


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""


def _child(element: ET.Element, *names: str) -> ET.Element | None:
    """The first child that has one of the names, in order of the names."""
    for name in names:
        for c in element:
            if _name(c) == name:
                return c
    return None


def _said(element: ET.Element | None) -> str | None:
    return None if element is None else texts.clean("".join(element.itertext()))


def _items(document: ET.Element) -> list[ET.Element]:
    kind = _name(document)
    if kind == "feed":
        return [c for c in document if _name(c) == "entry"]
    if kind == "rss":
        channel = _child(document, "channel")
        return [c for c in (channel if channel is not None else ()) if _name(c) == "item"]
    if kind == "rdf":
        return [c for c in document if _name(c) == "item"]
    return [c for c in document.iter() if _name(c) in ("item", "entry")]


def _link(item: ET.Element, base: str | None) -> str | None:
    """The link that leads to the article itself, else the first that leads anywhere, else an identifier that is a URL."""
    found = []
    for c in item:
        if _name(c) == "link":
            target = urls.resolve(base, c.get("href") or (c.text or ""))
            if target:
                found.append((c.get("rel", "alternate").lower() not in ("alternate", "canonical"), target))
    if found:
        return min(found, key=lambda f: f[0])[1]
    guid = (_said(_child(item, "guid", "id")) or "").strip()
    return urls.resolve(base, guid) if guid.startswith(("http://", "https://", "/")) else None


def feed_items(payload, base: str | None) -> list[dict]:
    """Items of a feed in order, repeats included; items without a link are left out."""
    document, out = root(payload), []
    for item in _items(document) if document is not None else ():
        link = _link(item, base)
        if not link:
            continue
        raw, updated = _said(_child(item, "published", "pubdate", "date")), _said(_child(item, "updated", "lastbuilddate", "modified"))
        author = _child(item, "author", "creator")
        name = _child(author, "name") if author is not None else None
        out.append({
            "position": len(out), "url": link, "canonical_url": link, "title": _said(_child(item, "title")), "summary": _said(_child(item, "summary", "description", "content")),
            "author": _said(name if name is not None else author), "identifier": _said(_child(item, "guid", "id")), "published_at": dates.parse(raw), "published_raw": raw, "updated_at": dates.parse(updated), "date_problem": dates.problem(raw),
        })
    return out


class _Nothing:
    """Takes in what a parser reads and keeps none of it."""

    def start(self, tag, attrs):
        pass

    def end(self, tag):
        pass

    def data(self, text):
        pass

    def close(self):
        return True


def _readable(payload: bytes | str | None) -> bytes | str | None:
    """The payload in the form that root() reads, without a tree; None if malformed."""
    for attempt in (payload, payload.decode("utf-8", "replace") if isinstance(payload, bytes) else None):
        try:
            if attempt:
                parser = ET.XMLParser(target=_Nothing())
                parser.feed(attempt)
                parser.close()
                return attempt
        except (ET.ParseError, LookupError, ValueError):
            continue
    return None


#: Bytes or characters of a sitemap that are parsed at once.
PIECE = 65536


def sitemap_entries(payload, base: str | None) -> Iterator[dict]:
    """Entries of a sitemap or of an index of sitemaps, one by one: no tree of the whole is made. A malformed one has none."""
    said, position, open_ = _readable(payload), 0, []
    parser = ET.XMLPullParser(("start", "end"))
    for at in range(0, len(said) + PIECE, PIECE) if said else ():
        if at < len(said):
            parser.feed(said[at : at + PIECE])
        else:
            parser.close()  # gives what the parser has held back
        for event, element in parser.read_events():
            if event == "start":
                open_.append(element)
                continue
            open_.pop()
            if len(open_) != 1:
                continue
            index = _name(open_[0]) == "sitemapindex"
            if _name(element) == ("sitemap" if index else "url"):
                target, raw = urls.resolve(base, _said(_child(element, "loc")), identity=not index), _said(_child(element, "lastmod"))
                if target:
                    yield {"position": position, "url": target, "last_modified": dates.parse(raw), "last_modified_raw": raw, "is_index": index}
                    position += 1
            open_[0].remove(element)


def _frame(rows: list[list[dict]]) -> pd.Series:
    return pd.Series([[{k: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for k, v in r.items()} for r in one] for one in rows], dtype=object)


@F.pandas_udf(T.ArrayType(ITEM))
def parse_feed(payload: pd.Series, base: pd.Series) -> pd.Series:
    return _frame([feed_items(p, b) for p, b in zip(payload, base, strict=True)])


#: Items that are given on at once.
ROWS = 500
_ARROW = {T.StringType(): pa.string(), T.TimestampType(): pa.timestamp("us", tz="UTC"), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}


def items_of(documents: DataFrame, parse: Callable[[dict], Iterable[dict]], schema: T.StructType, kept: list[str]) -> DataFrame:
    """kept columns of documents, and one row for each item of parse(row), whatever their number: documents are read one by one, items given on a few at a time."""
    out = T.StructType([*[documents.schema[k] for k in kept], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, ready = pa.schema([(f.name, _ARROW[f.dataType]) for f in out.fields]), []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                carried = {k: row[k] for k in kept}
                for item in parse(row):
                    ready.append(carried | item)
                    if len(ready) == ROWS:
                        yield pa.RecordBatch.from_pylist(ready, arrow)
                        ready = []
        yield pa.RecordBatch.from_pylist(ready, arrow)

    return documents.mapInArrow(run, out)


def feed_scan(documents: DataFrame) -> DataFrame:
    """documents (url, content) -> one row for each item."""
    return items_of(documents.select(F.col("url").alias("feed_url"), "content"), lambda row: feed_items(row["content"], row["feed_url"]), ITEM, ["feed_url"])


def sitemap_scan(documents: DataFrame) -> DataFrame:
    return items_of(documents.select(F.col("url").alias("sitemap_url"), "content"), lambda row: sitemap_entries(row["content"], row["sitemap_url"]), ENTRY, ["sitemap_url"])


def sitemap_walk(documents: DataFrame, roots: DataFrame, max_sitemaps: int = 20) -> DataFrame:
    """Entries of all sitemaps that indexes lead to from roots (url; root, max_sitemaps, if it has those columns), with ``root_url``.

    Each root, named by ``root`` or else by its url, has a budget of its own: so many documents, itself among them, in order
    of their discovery: breadth first, in the order of the indexes' entries. What a root has visited isn't visited again for
    it, so an index that names itself ends. Roots of one url may differ in budget. Each turn parses the documents of its
    frontier alone, once for all roots, and writes them out. Turns are as many as indexes are nested.
    """
    named = "root" in roots.columns
    budget = F.greatest(F.coalesce(F.col("max_sitemaps").cast("int") if "max_sitemaps" in roots.columns else F.lit(None), F.lit(max_sitemaps)), F.lit(1))
    root = F.col("root" if named else "url").alias("root")
    frontier = staged(roots.select(root, F.col("url").alias("root_url"), "url", budget.alias("budget"), F.lit(0).cast("long").alias("place")).dropDuplicates(["root"]), "frontier")
    visited, found = frontier.select("root", "url"), None
    while True:
        entries = sitemap_scan(documents.join(frontier.select("url").distinct(), "url", "left_semi")).withColumnRenamed("url", "target")
        entries = staged(entries.join(frontier.withColumnRenamed("url", "sitemap_url"), "sitemap_url"), "sitemaps")
        here = entries.where("not is_index")
        found = here if found is None else found.unionByName(here)
        next_ones = entries.where("is_index").groupBy("root", "root_url", "budget", F.col("target").alias("url")).agg(F.min(F.struct("place", "position")).alias("at"))
        next_ones = missing(next_ones, visited, ["root", "url"]).join(visited.groupBy("root").agg(F.count("*").alias("used")), "root")
        next_ones = next_ones.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy("at")).cast("long")).where(F.col("place") + F.col("used") <= F.col("budget"))
        frontier = staged(next_ones.select("root", "root_url", "url", "budget", "place"), "frontier")
        if frontier.isEmpty():
            return found.drop("budget", "place", *([] if named else ["root"])).withColumnRenamed("target", "url")
        visited = visited.unionByName(frontier.select("root", "url"))


def robots_allows(text: str | None, agent: str, path: str) -> bool:
    """Whether a robots file lets the agent fetch a path: the longest rule of its most specific group decides."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    names, rules_began = [], False
    for line in (text or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names, rules_began = ([] if rules_began else names) + [value.lower()], False
            for n in names:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow"):
            rules_began = True
            for n in names:
                if value:
                    groups[n].append((value, key == "allow"))
    mine = max((n for n in groups if n != "*" and n in agent.lower()), key=len, default="*")
    hits = [(len(p), ok) for p, ok in groups.get(mine, []) if path.startswith(p.rstrip("*"))]
    return max(hits, default=(0, True))[1]
