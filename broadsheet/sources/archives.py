"""Archive pages: cards by selectors, and walks along next links."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import dates, texts, urls

from . import markup
from .feeds import ITEM, _frame, items_of
from .jsonapi import _config
from .scratch import staged

MAX_PAGES = 100
#: Selectors that hold where a registry names none.
DEFAULTS = {"item_selector": "article", "link_selector": "a[href]", "title_selector": "h1, h2, h3, [itemprop=headline]", "date_selector": "time"}


def archive_items(page: str | None, base: str | None, config: dict | None = None, deduplicate: bool = True) -> list[dict]:
    """Candidates of one page in order; cards without a link are left out, repeats within the page as well."""
    return _cards(markup.parse(page or ""), base, config, deduplicate)


def _cards(page: markup.Node, base: str | None, config: dict | None, deduplicate: bool) -> list[dict]:
    config, out, seen = DEFAULTS | (config or {}), [], set()
    for card in page.select(config["item_selector"]):
        link = card if card.tag == "a" and "href" in card.attrs else card.first(config["link_selector"])
        target = urls.resolve(base, link.attrs.get("href")) if link is not None else None
        if not target or (deduplicate and target in seen):
            continue
        seen.add(target)
        title, when = card.first(config["title_selector"]), card.first(config["date_selector"])
        raw = texts.clean((when.attrs.get("datetime") or when.text()) if when is not None else None)
        said = title.text() if title is not None else ""
        out.append({
            "position": len(out), "url": target, "canonical_url": target, "title": texts.clean(said or link.text()), "summary": None, "author": None,
            "identifier": None, "published_at": dates.parse(raw), "published_raw": raw, "updated_at": None, "date_problem": dates.problem(raw),
        })
    return out


def next_page(page: str | None, base: str | None, selector: str) -> str | None:
    """Target of the next link as it would be fetched: its query stays as it is."""
    return _next(markup.parse(page or ""), base, selector)


def _next(page: markup.Node, base: str | None, selector: str) -> str | None:
    link = page.first(selector)
    return urls.resolve(base, link.attrs.get("href"), identity=False) if link is not None else None


def parse_archive(page: Column, base: Column, config: dict | Column | None = None, deduplicate: bool = True) -> Column:
    """Candidates of a page; config is one for all pages, or a column of JSON objects."""

    @F.pandas_udf(T.ArrayType(ITEM))
    def parse(page: pd.Series, base: pd.Series, said: pd.Series) -> pd.Series:
        return _frame([archive_items(p, b, _config(c), deduplicate) for p, b, c in zip(page, base, said, strict=True)])

    return parse(page, base, config if isinstance(config, Column) else F.lit(json.dumps(config or {})))


def archive_scan(documents: DataFrame, config: dict | None = None, deduplicate: bool = True) -> DataFrame:
    return documents.select("url", F.explode(parse_archive(F.col("content"), F.col("url"), config, deduplicate)).alias("i")).select(F.col("url").alias("page_url"), "i.*")


_STEP = T.StructType([*ITEM.fields, T.StructField("next", T.StringType())])


def _step(row: dict, deduplicate: bool) -> Iterator[dict]:
    """The candidates of a page, then where it leads to, from one tree."""
    page, config = markup.parse(row["content"] or ""), _config(row["config"])
    yield from _cards(page, row["page_url"], config, deduplicate)
    if (selector := config.get("next_selector")) and (target := _next(page, row["page_url"], selector)):
        yield {"next": target}


def archive_walk(documents: DataFrame, roots: DataFrame, selector: str | None = None, config: dict | None = None, max_pages: int = 10, preserve_duplicates: bool = False) -> DataFrame:
    """Candidates of the pages that next links lead to from roots (url), with ``root_url``; of a root's candidates the first of a URL stays.

    roots may have a column ``config`` of JSON objects, whose selectors, next_selector and max_pages go before those given,
    and a column ``root`` that names them: roots of one url then keep settings and candidates of their own. Each turn parses the pages of its frontier alone, cards and next link at once, and writes them out.
    """
    base = {**(config or {}), "next_selector": selector, "max_pages": max_pages}
    own = F.coalesce(F.col("config"), F.lit("{}")) if "config" in roots.columns else F.lit("{}")

    @F.pandas_udf(T.StringType())
    def merged(said: pd.Series) -> pd.Series:
        return said.map(lambda text: json.dumps({**base, **_config(text)}))

    named = "root" in roots.columns
    root = F.col("root" if named else "url").alias("root")
    frontier = staged(roots.select(root, F.col("url").alias("root_url"), "url", merged(own).alias("config")).dropDuplicates(["root"]), "frontier")
    most = F.least(F.coalesce(F.get_json_object("config", "$.max_pages").cast("int"), F.lit(max_pages)), F.lit(MAX_PAGES))
    visited, found, number = frontier.select("root", "url"), None, 0
    while True:
        pages = documents.select("url", "content").join(frontier, "url")
        pages = pages.select("root", "root_url", "config", F.col("url").alias("page_url"), "content")
        pages = staged(items_of(pages, lambda row: _step(row, not preserve_duplicates), _STEP, ["root", "root_url", "config", "page_url"]), "pages")
        items = pages.where("next is null").select("root", "root_url", "page_url", F.lit(number).alias("page"), *ITEM.names)
        found = items if found is None else found.unionByName(items)
        number += 1
        following = pages.where("next is not null").where(F.lit(number) < most).select("root", "root_url", F.col("next").alias("url"), "config")
        frontier = staged(following.join(visited, ["root", "url"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("root", "url"))
    out = [] if named else ["root"]
    if preserve_duplicates:
        return found.drop(*out)
    first = found.groupBy("root", "root_url", "url").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("root", "root_url", "url")]), F.struct("page", "page_url", "position")).alias("i"))
    return first.select("root", "root_url", "url", "i.*").drop(*out)
