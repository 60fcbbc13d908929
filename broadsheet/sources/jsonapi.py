"""JSON APIs: items by configured or usual paths."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import dates, texts, urls

from .feeds import ITEM, _frame, items_of

# Usual names of the list of items, and of its fields.
LISTS = ("items", "results", "articles", "news", "entries", "records", "data")
FIELDS = {
    "url": ("url", "link", "href", "permalink", "links.html", "links.self"),
    "title": ("title", "headline", "name"),
    "published_at": ("published_at", "publishedAt", "datePublished", "date", "published", "pubDate", "created_at"),
    "summary": ("summary", "description", "excerpt", "teaser"),
    "author": ("author.name", "author", "creator", "byline"),
    "identifier": ("id", "guid", "uuid"),
}
MAX_PARTS, DEFAULT_ITEMS, MAX_ITEMS = 16, 500, 1000


def parts(path) -> list:
    """Steps of a path: dotted with [n], a JSON pointer, or a list."""
    if isinstance(path, list | tuple):
        steps = list(path)
    elif str(path).startswith("/"):
        steps = [p.replace("~1", "/").replace("~0", "~") for p in str(path)[1:].split("/")]
    else:
        steps = [p for p in str(path).replace("[", ".").replace("]", "").split(".") if p]
    return steps if len(steps) <= MAX_PARTS else []


def get(value, path):
    """The value at a path; keys that aren't there as written are looked up whatever their case."""
    steps = parts(path)
    for step in steps:
        if isinstance(value, dict):
            if step not in value:
                step = next((k for k in value if str(k).casefold() == str(step).casefold()), None)
            value = value.get(step)
        elif isinstance(value, list) and str(step).isdigit() and int(step) < len(value):
            value = value[int(step)]
        else:
            return None
    return value if steps else None


def _text(value) -> str | None:
    if isinstance(value, dict):
        value = next((value[k] for k in ("href", "url", "html", "name", "value", "rendered") if isinstance(value.get(k), str)), None)
    return texts.clean(str(value)) if isinstance(value, str | int | float) and not isinstance(value, bool) else None


def _first(item: dict, wanted) -> str | None:
    return next((t for t in (_text(get(item, p)) for p in wanted) if t), None)


def _list(document, path=None) -> list:
    if path:
        found = get(document, path)
        return found if isinstance(found, list) else []
    if isinstance(document, list):
        return document
    if isinstance(document, dict):
        for name in LISTS:
            found = get(document, name)
            if isinstance(found, list):
                return found
            if isinstance(found, dict):
                for inner in LISTS:
                    if isinstance(get(found, inner), list):
                        return get(found, inner)
    return []


def json_items(payload, base: str | None, config: dict | None = None, deduplicate: bool = True) -> list[dict]:
    """Items of a JSON document. config: items_path, max_items, and a path or list of paths for each field."""
    config = config or {}
    try:
        document = json.loads(payload.decode("utf-8", "replace") if isinstance(payload, bytes) else payload or "null")
    except ValueError:
        return []
    wanted = {f: [c] if isinstance(c := config.get(f, d), str) else c for f, d in FIELDS.items()}
    most = min(max(int(config.get("max_items", DEFAULT_ITEMS)), 1), MAX_ITEMS)
    out, seen = [], set()
    for item in _list(document, config.get("items_path")):
        link = urls.resolve(base, _first(item, wanted["url"])) if isinstance(item, dict) else None
        if not link or (deduplicate and link in seen) or len(out) == most:
            continue
        seen.add(link)
        raw = _first(item, wanted["published_at"])
        out.append({
            "position": len(out), "url": link, "canonical_url": link, "title": _first(item, wanted["title"]), "summary": _first(item, wanted["summary"]), "author": _first(item, wanted["author"]),
            "identifier": _first(item, wanted["identifier"]), "published_at": dates.parse(raw), "published_raw": raw, "updated_at": None, "date_problem": dates.problem(raw),
        })
    return out


def parse_json_api(payload: Column, base: Column, config: dict | Column | None = None, deduplicate: bool = True) -> Column:
    """Items of a document; config is one for all documents, or a column of JSON objects."""

    @F.pandas_udf(T.ArrayType(ITEM))
    def parse(payload: pd.Series, base: pd.Series, said: pd.Series) -> pd.Series:
        return _frame([json_items(p, b, _config(c), deduplicate) for p, b, c in zip(payload, base, said, strict=True)])

    return parse(payload, base, config if isinstance(config, Column) else F.lit(json.dumps(config or {})))


@lru_cache(1024)
def _config(text: str | None) -> dict:
    """A configuration; lists and objects may be JSON texts themselves, as a map of texts holds them."""

    def value(text):
        try:
            return json.loads(text)
        except ValueError:
            return None

    found = value(text or "{}")
    if not isinstance(found, dict):
        return {}
    nested = {k: value(v) for k, v in found.items() if isinstance(v, str) and v[:1] in ("[", "{")}
    return {k: v if nested.get(k) is None else nested[k] for k, v in found.items() if v}


def json_scan(documents: DataFrame, config: dict | None = None, deduplicate: bool = True) -> DataFrame:
    said = _config(json.dumps(config or {}))
    parse = lambda row: json_items(row["content"], row["api_url"], said, deduplicate)
    return items_of(documents.select(F.col("url").alias("api_url"), "content"), parse, ITEM, ["api_url"])
