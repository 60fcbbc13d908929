"""The registry of publishers and sources: YAML on the driver, frames for Spark, and rules over both.

A registry is small, so it is read and checked on the driver; its frames are then joined like any table.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from broadsheet.functions import texts, urls
from broadsheet.functions.patterns import problem, usable
from broadsheet.operators.candidates import KIND_ALIASES, KINDS

from . import jsonapi, markup

PUBLISHERS = "id string, slug string, name string, website_url string, country_code string, language string, groups array<string>, region string, city string, source_status string, enabled boolean, metadata map<string,string>"
SOURCES = "id string, publisher_id string, url string, normalized_url string, kind string, name string, language string, enabled boolean, config map<string,string>"
# Keys that name official hosts, in order.
HOST_KEYS = ("official_host", "host", "official_hosts", "allowed_hosts", "allowed_domains", "host_aliases", "official_host_aliases")
PATTERN_KEYS = {"allow": ("allow_patterns", "article_allow", "allow_regex"), "exclude": ("exclude_patterns", "exclude_regex"), "navigation": ("navigation_patterns", "navigation_exclude")}
NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def _list(value) -> list:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def records(value) -> list[dict]:
    """A list of mappings, or a mapping by id, as a list of mappings."""
    if isinstance(value, dict):
        return [{"id": k, **(v or {})} for k, v in value.items()]
    return [dict(v) for v in value or [] if isinstance(v, dict)]


def flag(value, default: bool = True) -> bool:
    if isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on", "enabled")
    return default if value is None else bool(value)


def source_id(publisher: str, url: str) -> str:
    """A stable id for a source that has none."""
    return f"{publisher}-{hashlib.sha256((urls.normalize_or_none(url) or url).encode()).hexdigest()[:12]}"


def canonical_kind(value: str | None) -> str | None:
    word = (value or "").strip().lower().replace(" ", "_")
    return word if word in KINDS else KIND_ALIASES.get(word)


def host(value: str | None) -> str | None:
    """A bare host name in lower case; None for anything with a scheme, port, path or credentials."""
    said = (value or "").strip().lower().rstrip(".")
    return said if re.fullmatch(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?", said) else None


def policy(publisher: dict, source: dict | None = None) -> dict:
    """Hosts and patterns of a source: its own settings over its publisher's; else the website's host, else the source's."""
    config = (publisher.get("metadata") or {}) | ((source or {}).get("config") or {})
    hosts = list(dict.fromkeys(h for k in HOST_KEYS for v in _list(config.get(k)) if (h := host(str(v)))))
    if not hosts:
        hosts = [h for u in (publisher.get("website_url"), (source or {}).get("url")) if (h := urls.official_host(u or ""))][:1]
    found = {n: next((p for k in keys if (p := [str(x) for x in _list(config.get(k)) if str(x).strip()])), []) for n, keys in PATTERN_KEYS.items()}
    return {"hosts": hosts, **found}


def read(text_or_path: str) -> tuple[list[dict], list[dict]]:
    """(publishers, sources) of a YAML registry: sources nested in publishers or listed at the top."""
    import yaml

    if "\n" not in text_or_path and text_or_path.endswith((".yaml", ".yml")):
        with open(text_or_path, encoding="utf-8") as f:
            text_or_path = f.read()
    value = yaml.safe_load(text_or_path) or {}
    publishers, sources = [], []
    for p in records(value.get("publishers") or value.get("zoos")):
        nested = records(p.pop("sources", None))
        p["slug"] = p.get("slug") or p.get("id")
        p["id"], p["enabled"] = str(p.get("id") or p["slug"]), flag(p.get("enabled"))
        publishers.append(p)
        sources += [{"publisher_id": p["id"], **s} for s in nested]
    sources += [{**s, "publisher_id": s.get("publisher_id") or s.get("zoo_id")} for s in records(value.get("sources"))]
    for s in sources:
        s["kind"] = canonical_kind(s.get("kind") or s.get("adapter") or s.get("type")) or s.get("kind")
        s["normalized_url"], s["enabled"] = urls.normalize_or_none(s.get("url")), flag(s.get("enabled"))
        s["id"] = str(s.get("id") or source_id(str(s["publisher_id"]), str(s.get("url") or "")))
    return publishers, sources


def frames(spark: SparkSession, publishers: list[dict], sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    def shaped(rows: list[dict], schema: str, rest: str) -> DataFrame:
        names = [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", schema)]
        data = []
        for r in rows:
            more = {str(k): json.dumps(v) if isinstance(v, list | tuple | dict) else str(v) for k, v in {**(r.get(rest) or {}), **{k: v for k, v in r.items() if k not in names}}.items() if v is not None}
            data.append(tuple(more if n == rest else [str(x) for x in _list(r.get(n))] if n == "groups" else r.get(n) if n == "enabled" or r.get(n) is None else str(r[n]) for n in names))
        return spark.createDataFrame(data, schema)

    return shaped(publishers, PUBLISHERS, "metadata"), shaped(sources, SOURCES, "config")


POLICIES = "source_id string, hosts array<string>, allow array<string>, allow_text array<string>, exclude array<string>, navigation array<string>, phrases array<string>, restricted boolean"


def policies(spark: SparkSession, publishers: list[dict], sources: list[dict]) -> DataFrame:
    """What each source's candidates must satisfy, one row a source: see candidates.policy_by.

    A pattern that doesn't compile never matches; as an allowance it counts as plain text.
    """
    by_id, rows = {p["id"]: p for p in publishers}, []
    for s in sources:
        said, config = policy(by_id.get(s.get("publisher_id"), {}), s), s.get("config") or {}
        good = {n: usable(said[n]) for n in PATTERN_KEYS}
        text = [p.lower() for p in said["allow"] if p not in good["allow"]]
        identity = config.get("identity_filter")
        phrases = [k for x in _list(identity.get("any") if isinstance(identity, dict) else identity) if (k := texts.key(str(x)))]
        rows.append((s["id"], said["hosts"], list(good["allow"].values()), text, list(good["exclude"].values()), list(good["navigation"].values()), phrases, bool(said["allow"])))
    return spark.createDataFrame(rows, POLICIES)


def vocabulary(kind: str) -> set[str] | None:
    """ISO codes that the JVM knows: Countries or Languages. None without a session."""
    session = SparkSession.getActiveSession()
    return {str(c).upper() for c in getattr(session.sparkContext._jvm.java.util.Locale, f"getISO{kind}")()} if session else None


def group_issues(at: str, publisher: dict, pairs: set[frozenset] | None = None) -> list[tuple[str, str, str]]:
    """Groups are named, none twice, and no two of them are together unless their pair is allowed."""
    groups, found = publisher.get("groups", []), []
    if not isinstance(groups, list | tuple):
        return [(f"{at}.groups", "groups", "no list of group names")]
    names = []
    for i, g in enumerate(groups):
        if not isinstance(g, str) or not g.strip():
            found.append((f"{at}.groups[{i}]", "groups", "no group name"))
        elif g.strip() in names:
            found.append((f"{at}.groups[{i}]", "groups", f"{g!r} is named twice"))
        else:
            names.append(g.strip())
    if pairs is not None:
        found += [(f"{at}.groups", "groups", f"{a!r} doesn't go with {b!r}") for i, a in enumerate(names) for b in names[i + 1 :] if frozenset((a, b)) not in pairs]
    return found


def provenance_issues(at: str, publisher: dict, roster: dict) -> list[tuple[str, str, str]]:
    """What keeps a publisher from being vouched for by a roster: its one provenance record must state the roster's values and a line."""
    entries = publisher.get("list_provenance")
    if not isinstance(entries, list | tuple) or len(entries) != 1 or not isinstance(entries[0], dict):
        return [(f"{at}.list_provenance", "provenance", "not exactly one record")]
    entry, line = entries[0], entries[0].get("source_line")
    found = [(f"{at}.list_provenance[0].{k}", "provenance", f"must be {v!r}") for k, v in roster.items() if entry.get(k) != v]
    if not isinstance(line, int) or isinstance(line, bool) or line < 1:
        found.append((f"{at}.list_provenance[0].source_line", "provenance", "no line of the roster"))
    return found


def issues(publishers: list[dict], sources: list[dict], countries: set[str] | None = None, languages: set[str] | None = None, roster: dict | None = None, pairs: set[frozenset] | None = None) -> list[tuple[str, str, str]]:
    """(path, code, message) for each broken rule.

    Codes of countries and languages that are given must be in their vocabulary, by default that of ISO; with countries
    given, each publisher needs one. With a roster (source, version, sha256 and more), a publisher that lacks country,
    language or website, or is marked as having no source, must be vouched for by it.
    """
    found: list[tuple[str, str, str]] = []
    needed = countries is not None
    countries, languages = countries or vocabulary("Countries"), languages or vocabulary("Languages")
    seen: dict[str, set] = {"id": set(), "slug": set(), "website_url": set(), "source": set()}

    def unique(kind: str, value, path: str) -> None:
        if value and value in seen[kind]:
            found.append((path, "duplicate", f"{kind} {value!r} is used twice"))
        seen[kind].add(value)

    by_id = {}
    for i, p in enumerate(publishers):
        at = f"publishers[{i}]"
        by_id[p["id"]] = p
        for key in ("id", "slug"):
            if not NAME.fullmatch(str(p.get(key) or "")):
                found.append((f"{at}.{key}", "format", f"{p.get(key)!r} is no lower-case name"))
            unique(key, p.get(key), f"{at}.{key}")
        site = urls.normalize_or_none(p.get("website_url"))
        if not site or not urls.official_host(site):
            found.append((f"{at}.website_url", "url", "no http(s) URL"))
        unique("website_url", site, f"{at}.website_url")
        country = str(p.get("country_code") or "").upper()
        if countries is not None and (country or needed) and country not in countries:
            found.append((f"{at}.country_code", "vocabulary", f"unknown country {p.get('country_code')!r}"))
        tag = texts.language_tag(str(p["language"])) if p.get("language") else None
        if p.get("language") and (not tag or (languages is not None and len(tag.split("-")[0]) == 2 and tag.split("-")[0].upper() not in {x.upper() for x in languages})):
            found.append((f"{at}.language", "vocabulary", f"no language tag: {p['language']!r}"))
        found += group_issues(at, p, pairs)
        gap = any(not p.get(k) for k in ("country_code", "language", "website_url")) or p.get("source_status") in ("not_found", "source_not_found")
        if roster is not None and gap:
            found += provenance_issues(at, p, roster)
    for i, s in enumerate(sources):
        at = f"sources[{i}]"
        unique("source", s["id"], f"{at}.id")
        owner = by_id.get(s.get("publisher_id"))
        if owner is None:
            found.append((f"{at}.publisher_id", "association", f"unknown publisher {s.get('publisher_id')!r}"))
        if s.get("kind") not in KINDS:
            found.append((f"{at}.kind", "vocabulary", f"unknown kind {s.get('kind')!r}"))
        of = urls.official_host(str(s.get("url") or ""))
        if not of:
            found.append((f"{at}.url", "url", "no http(s) URL"))
        elif owner is not None and of not in {*policy(owner, s)["hosts"], urls.official_host(owner.get("website_url") or "")}:
            found.append((f"{at}.url", "host", f"{of} is neither the official host nor an alias"))
        config = s.get("config") or {}
        for key in (k for keys in PATTERN_KEYS.values() for k in keys):
            for pattern in _list(config.get(key)):
                if (why := problem(str(pattern))) is not None:
                    found.append((f"{at}.config.{key}", "regex", why))
        for key in (k for k in config if k.endswith("_selector")):
            for selector in _list(config[key]):
                try:
                    markup.parse("").select(str(selector))
                except ValueError as e:
                    found.append((f"{at}.config.{key}", "selector", str(e)))
        if "items_path" in config and not jsonapi.parts(config["items_path"]):
            found.append((f"{at}.config.items_path", "path", "empty or too long"))
        if "max_pages" in config and not (str(config["max_pages"]).isdigit() and 1 <= int(config["max_pages"]) <= 100):
            found.append((f"{at}.config.max_pages", "bounds", "1 to 100"))
    return found
