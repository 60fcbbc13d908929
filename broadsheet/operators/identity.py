"""Article identity: which arrivals are one article, resolved exactly in order of arrival.

The rule depends on order, so it can't be one join. But rows that share no URL, no content hash and no title within a
publisher never meet in it. Their connected components are therefore independent, and each is folded by itself, row after
row, in parallel. A component comes from a few copies of one story; a hash that very many rows share makes a large one, as
the rule looks at all rows of a hash, those of other titles too. Look-ups go by index, so a component is folded in time that
grows with its rows; but it is folded by one task, which holds its rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import texts, urls
from broadsheet.sources.scratch import spread, staged

from .components import components

IDENTITY = ("canonical_url", "normalized_url", "source_url", "source_url_raw")
BUSINESS = ("title", "published_at", "published_raw", "updated_at_source", "author", "summary", "content", "content_html", "image_url", "parse_status", "content_hash", "language", "crawl_status")
EVIDENCE = ("html_hash", "raw_html", "http_status", "last_fetched_at")
COLUMNS = (*IDENTITY, *BUSINESS, *EVIDENCE)
#: Changes in these make an article updated; raw evidence doesn't.
STATE = (*IDENTITY, *BUSINESS, "content_identity_key", "http_status", "metadata_json")

INPUT = "arrival_seq long, publisher_id string, source_id string, url string, " + ", ".join(f"{c} string" for c in COLUMNS if c not in ("normalized_url", "source_url", "source_url_raw")) + ", metadata_json string"
OUTPUT = "kind string, article_id long, arrival_seq long, outcome string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", content_identity_key string, metadata_json string, merged_ids array<bigint>, names string"


def identity_key(content_hash: str | None, title: str | None) -> str | None:
    key = texts.key(title)
    return hashlib.sha256(f"{content_hash}\0{key}".encode()).hexdigest() if content_hash and key else None


def _object(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


class _Index:
    """Articles by a value they have; of several, the one created first."""

    def __init__(self):
        self.having: dict = {}
        self.order: dict = {}  # heaps of the same ids; those that left are skipped when they come up

    def put(self, value, i: int) -> None:
        self.having.setdefault(value, set()).add(i)
        heapq.heappush(self.order.setdefault(value, []), i)

    def drop(self, value, i: int) -> None:
        having = self.having[value]
        having.discard(i)
        if not having:
            del self.having[value], self.order[value]

    def first(self, value, besides: int | None = None) -> int | None:
        having, order = self.having.get(value, ()), self.order.get(value, [])
        if len(having) <= (besides in having):
            return None
        while order[0] not in having:
            heapq.heappop(order)
        if order[0] != besides:
            return order[0]
        while order[0] not in having or order[0] == besides:
            heapq.heappop(order)
        found = order[0]
        heapq.heappush(order, besides)
        return found


class Resolver:
    """Articles of one component while arrivals are folded into them. An article's id is the arrival that created it."""

    KEYS = ("canonical_url", "normalized_url", "content_hash", "content_identity_key")

    def __init__(self):
        self.articles: dict[int, dict] = {}
        self.titles: dict[tuple[str, str], int] = {}  # (publisher, title key) -> article
        self.titled: dict[int, set[tuple[str, str]]] = {}  # article -> its keys in titles
        self.merged: dict[int, list[int]] = {}
        self.indexes = {c: _Index() for c in (*self.KEYS, "hash_and_title")}
        self.indexed: dict[int, dict] = {}  # article -> the values it is indexed by

    def restore(self, at: int, article: dict, names: list, merged: list[int]) -> None:
        """Takes in an article of an earlier fold: its values, the (publisher, title) keys that lead to it, and what it absorbed."""
        self._put(at, article)
        for publisher, title in names:
            self._name((publisher, title), at)
        if merged:
            self.merged[at] = merged

    def _put(self, at: int, article: dict | None) -> None:
        """Sets an article, or removes it (None)."""
        values = {}
        if article is None:
            del self.articles[at]
        else:
            self.articles[at] = article
            values = {c: article[c] for c in self.KEYS if article[c]}
            if article["content_hash"]:
                values["hash_and_title"] = (article["content_hash"], texts.key(article["title"]))
        was = self.indexed.pop(at, {})
        for c, value in was.items() - values.items():
            self.indexes[c].drop(value, at)
        for c, value in values.items() - was.items():
            self.indexes[c].put(value, at)
        if values:
            self.indexed[at] = values

    def _name(self, key: tuple[str, str], at: int) -> None:
        if key in self.titles:
            self.titled[self.titles[key]].discard(key)
        self.titles[key] = at
        self.titled.setdefault(at, set()).add(key)

    def _having(self, column: str, value, besides: int | None = None) -> int | None:
        return self.indexes[column].first(value, besides) if value else None

    def _find(self, new: dict) -> int | None:
        """By URL; else by hash where titles agree (or both lack one and there is a URL); else by title within the publisher."""
        for column in ("canonical_url", "normalized_url"):
            if (found := self._having(column, new[column])) is not None:
                return found
        key, located = texts.key(new["title"]), bool(new["canonical_url"] or new["normalized_url"])
        if new["content_hash"] and (key or located):
            agreed = self._having("hash_and_title", (new["content_hash"], key))
            if agreed is not None or (not located and self._having("content_hash", new["content_hash"]) is not None):
                return agreed
        return self.titles.get((new["publisher_id"], key)) if new["publisher_id"] and key else None

    def _merge(self, donor: int, keeper: int) -> None:
        """The donor's values fill what the keeper lacks; its URLs and hash stay out where a third article has them."""
        gone, kept = self.articles[donor], dict(self.articles[keeper])
        self._put(donor, None)
        for c in COLUMNS:
            if not kept[c] and gone[c] and not (c in ("canonical_url", "normalized_url", "content_hash") and self._having(c, gone[c], keeper)):
                kept[c] = gone[c]
        kept["metadata"] = gone["metadata"] | kept["metadata"]
        kept["content_identity_key"] = identity_key(kept["content_hash"], kept["title"])
        self._put(keeper, kept)
        self.merged.setdefault(keeper, []).extend([donor, *self.merged.pop(donor, [])])
        for key in list(self.titled.pop(donor, ())):
            self.titles[key] = keeper
            self.titled.setdefault(keeper, set()).add(key)

    def add(self, arrival: int, new: dict) -> tuple[int, str]:
        at = self._find(new)
        if at is None:
            at, outcome = arrival, "created"
            self._put(at, {c: new[c] for c in COLUMNS} | {"metadata": new["metadata"], "content_identity_key": identity_key(new["content_hash"], new["title"])})
        else:
            old = self.articles[at]
            key = identity_key(new["content_hash"] or old["content_hash"], new["title"] or old["title"])
            if (other := self._having("content_identity_key", key, at)) is not None:
                self._merge(other, at)
                old = self.articles[at]
            state = {c: old[c] or new[c] for c in IDENTITY} | {c: new[c] or old[c] for c in BUSINESS} | {c: old[c] if new[c] is None else new[c] for c in EVIDENCE}
            state["content_identity_key"], state["metadata"] = identity_key(state["content_hash"], state["title"]), old["metadata"] | new["metadata"]
            for c in ("canonical_url", "normalized_url", "content_hash"):
                if self._having(c, state[c], at) is not None:
                    state[c] = old[c]  # another article has it
            outcome = "updated" if any(state[c if c != "metadata_json" else "metadata"] != old[c if c != "metadata_json" else "metadata"] for c in STATE) else "unchanged"
            self._put(at, state)
        key = texts.key(new["title"])
        if new["publisher_id"] and key:
            other = self.titles.get((new["publisher_id"], key))
            if other is not None and other != at:
                self._merge(other, at)
            for held in [k for k in self.titled.get(at, ()) if k[0] == new["publisher_id"]]:
                self.titled[at].discard(held)
                del self.titles[held]
            self._name((new["publisher_id"], key), at)
        return at, outcome


def _clean(row: dict) -> dict:
    out = {k: None if v is None or v != v else v for k, v in row.items()}
    raw = out.get("url") or out.get("canonical_url")
    link = urls.normalize_or_none(out.get("url"))
    return {c: out.get(c) for c in COLUMNS} | {
        "publisher_id": out.get("publisher_id"), "canonical_url": urls.normalize_or_none(out.get("canonical_url")), "normalized_url": link, "source_url": link, "source_url_raw": raw,
        "content_hash": out.get("content_hash") or None, "metadata": _object(out.get("metadata_json")),
    }


def fold_rows(rows: Iterable[dict], before: Iterable[dict] = ()) -> list[dict]:
    """Outcome of each arrival of one component, in order of arrival, and the articles that are left.

    before: articles that earlier arrivals left (article_id, COLUMNS, metadata_json, content_identity_key, merged_ids, names).
    """
    resolver, out = Resolver(), []
    for row in before:
        article = {c: row[c] for c in (*COLUMNS, "content_identity_key")} | {"metadata": _object(row["metadata_json"])}
        resolver.restore(int(row["article_id"]), article, json.loads(row["names"]), [int(i) for i in row["merged_ids"]])
    for row in rows:
        at, outcome = resolver.add(int(row["arrival_seq"]), _clean(row))
        out.append({"kind": "arrival", "article_id": at, "arrival_seq": int(row["arrival_seq"]), "outcome": outcome})
    final = {d: k for k, donors in resolver.merged.items() for d in donors}
    for row in out:
        row["article_id"] = final.get(row["article_id"], row["article_id"])
    for at, a in resolver.articles.items():
        names = json.dumps(sorted(resolver.titled.get(at, ())))
        out.append({"kind": "article", "article_id": at, "outcome": None, **{c: a[c] for c in COLUMNS}, "content_identity_key": a["content_identity_key"], "metadata_json": json.dumps(a["metadata"], sort_keys=True), "merged_ids": sorted(resolver.merged.get(at, [])), "names": names})
    return out


def fold(rows: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
    """fold_rows() of frames, whose rows may stand in any order."""
    out = fold_rows(rows.sort_values("arrival_seq").to_dict("records"), before.to_dict("records") if before is not None else ())
    columns = ["kind", "article_id", "arrival_seq", "outcome", *COLUMNS, "content_identity_key", "metadata_json", "merged_ids", "names"]
    frame = pd.DataFrame(out, columns=columns)
    frame["arrival_seq"] = frame["arrival_seq"].astype("Int64")
    return frame.astype(object).where(frame.notna(), None) if len(frame) else frame


#: Rows that are taken from a batch, and given on, at once.
ROWS = 1000
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
_FOLDED = pa.schema([(n, _ARROW[t]) for n, t in (x.strip().split(" ") for x in f"component long, {OUTPUT}".split(","))])


def fold_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold_rows() of one component after the other. Rows come sorted by component, what is stored first, then by arrival.

    Components are small and many, so none has a frame or a batch of its own; held are the rows of one component.
    """
    component, stored, arrived, out = None, [], [], []
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for row in batch.slice(at, ROWS).to_pylist():
                if row["component"] != component:
                    out += [{"component": component, **r} for r in fold_rows(arrived, stored)]
                    component, stored, arrived = row["component"], [], []
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_pylist(out, _FOLDED)
                        out = []
                (stored if row["arrival_seq"] is None else arrived).append(row)
    out += [{"component": component, **r} for r in fold_rows(arrived, stored)]
    for at in range(0, len(out), ROWS):
        yield pa.RecordBatch.from_pylist(out[at : at + ROWS], _FOLDED)


def folded(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """component and OUTPUT: each component of arrivals (INPUT, component) folded into the articles that it has stored."""
    rows = arrivals.unionByName(stored, allowMissingColumns=True) if stored is not None else arrivals
    rows = rows.repartition(spread(rows.sparkSession), "component").sortWithinPartitions("component", "arrival_seq")
    return rows.mapInArrow(fold_sorted, f"component long, {OUTPUT}")


def identity_edges(rows: DataFrame) -> DataFrame:
    """(arrival_seq, key) for all keys by which the rule may link two rows."""
    link = urls.normalize_url
    title = texts.title_key("title")
    hashed = F.nullif("content_hash", F.lit(""))
    keyed = rows.select("arrival_seq", link("url").alias("u"), link("canonical_url").alias("c"), hashed.alias("h"), title.alias("t"), F.nullif("publisher_id", F.lit("")).alias("p"))
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("u:"), "u"),
            F.concat(F.lit("u:"), "c"),
            F.concat(F.lit("h:"), "h"),
            F.when(F.coalesce("t", F.lit("")) != "", F.concat(F.lit("t:"), "p", F.lit(":"), "t")),
        )
    )
    return keyed.select("arrival_seq", F.explode(keys).alias("key"))


def label(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with ``component``, the least arrival that each hangs together with by edges (arrival_seq, key)."""
    edges = staged(edges.distinct(), "keys")
    # Written out, so that both sides of the join are plain shuffles, whose hot keys Spark splits.
    least = staged(edges.groupBy("key").agg(F.min("arrival_seq").alias("v")), "least")
    linked = edges.join(least, "key").select(F.col("arrival_seq").alias("u"), "v").where("u <> v")
    roots = components(linked, "identity").withColumnRenamed("node", "arrival_seq").withColumnRenamed("root", "component")
    return rows.join(roots, "arrival_seq", "left").withColumn("component", F.coalesce("component", "arrival_seq"))


def shaped(arrivals: DataFrame) -> DataFrame:
    """The columns of INPUT; those that arrivals lack are null."""
    have = {c.lower() for c in arrivals.columns}
    columns = [x.strip().split(" ") for x in INPUT.split(",")]
    return arrivals.select(*[(F.col(n) if n in have else F.lit(None)).cast("bigint" if t == "long" else t).alias(n) for n, t in columns])


def resolve(arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, articles) of arrivals, which have the columns of INPUT; missing ones count as null.

    outcomes: arrival_seq, article_id, outcome (created, updated, unchanged). articles: what is left, one row each. All rows
    of a hash are linked, however many.
    """
    rows = shaped(arrivals)
    placed = label(rows, identity_edges(rows))
    found = staged(folded(placed).drop("component"), "folded")
    outcomes = found.where("kind = 'arrival'").select("arrival_seq", "article_id", "outcome")
    return outcomes, found.where("kind = 'article'").drop("kind", "arrival_seq", "outcome", "names")


def identity_lookup(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates with the article_id of known articles: by canonical URL, else by normalised URL, else by hash and title.

    candidates and known have canonical_url, normalized_url, content_identity_key. Three equi-joins in order of precedence.
    """
    out = candidates
    for i, key in enumerate(("canonical_url", "normalized_url", "content_identity_key")):
        best = known.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("article_id").alias(f"_a{i}"))
        out = out.join(best, key, "left")
    return out.withColumn("article_id", F.coalesce("_a0", "_a1", "_a2")).drop("_a0", "_a1", "_a2")
