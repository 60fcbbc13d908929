"""Candidates: URL policy, identity filter, recency, dedup, known articles, caps and the next batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import urls
from broadsheet.functions.classify import any_of, ladder
from broadsheet.functions.patterns import usable

# Order in which kinds of sources are visited.
SOURCE_PRIORITY = {"rss": 0, "atom": 0, "sitemap": 1, "archive": 2}
# Kinds of sources, and other names for them.
KINDS = ("rss", "atom", "sitemap", "archive", "json_api", "custom_adapter", "registry_only", "unsupported")
KIND_ALIASES = {
    "feed": "rss", "rss_feed": "rss", "rssfeed": "rss", "atom_feed": "atom", "atomfeed": "atom",
    "generic_html": "archive", "generic-html": "archive", "html": "archive", "html_list": "archive", "html-list": "archive", "news_archive": "archive", "news-archive": "archive",
    "health_check": "registry_only", "health-check": "registry_only", "healthcheck": "registry_only", "health_check_only": "registry_only", "healthcheck_only": "registry_only",
    "health-check-only": "registry_only", "health_only": "registry_only", "check_only": "registry_only", "health": "registry_only", "registry": "registry_only", "press": "registry_only",
    "json": "json_api", "json-api": "json_api", "api": "json_api", "api_json": "json_api", "custom": "custom_adapter", "custom-adapter": "custom_adapter", "plugin": "custom_adapter",
    "not_supported": "unsupported", "not-supported": "unsupported", "unavailable": "unsupported", "disabled": "unsupported",
}


def canonical_kind(kind: Column) -> Column:
    """One of KINDS, or null for an unknown word."""
    word = F.translate(F.lower(F.trim(kind)), " ", "_")
    known = {k: k for k in KINDS} | KIND_ALIASES
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), word)


def source_order(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair]), kind), F.lit(3))


def usable_patterns(patterns: list[str] | None) -> list[str]:
    """The patterns that compile, as the JVM reads them; a malformed one never matches."""
    return list(usable(patterns).values())


def matches(text: Column, patterns: list[str] | None) -> Column:
    good = usable_patterns(patterns)
    return any_of(*[text.rlike(f"(?i){p}") for p in good]) if good else F.lit(False)


def explicitly_allowed(text: Column, patterns: list[str] | None) -> Column:
    """Like matches(), but a malformed pattern counts as plain text."""
    good = usable(patterns)
    plain = [F.contains(F.lower(text), F.lit(p.lower())) for p in patterns or [] if p not in good]
    return any_of(matches(text, list(good)), *plain)


def policy_reason(url: Column, hosts: list[str], allow: list[str] | None = None, exclude: list[str] | None = None, navigation: list[str] | None = None, source_url: Column | None = None) -> Column:
    """Why a normalised URL is no article of a publisher; null if it may be one."""
    path = urls.path(url)
    allowed = matches(url, allow)
    clean = url.rlike(r"^https?://[^/?#@]+(?:[/?#]|$)")
    same = (url == source_url) if source_url is not None else F.lit(False)
    return ladder(
        (url.isNull() | ~clean | ~urls.host(url).isin(*[h.lower().rstrip(".") for h in hosts]), "not_official"),
        (matches(url, exclude), "excluded"),
        (F.coalesce(same, F.lit(False)), "source_page"),
        (F.regexp_replace(path, "/+$", "") == "", "root_page"),
        (F.lit(bool(allow)) & ~allowed, "not_allowed"),
        (matches(path, navigation), "navigation"),
        (~allowed & matches(path, list(urls.NAVIGATION)), "default_navigation"),
    )


def policy_by(url: Column, hosts: Column, source_url: Column, allow: Column, allow_text: Column, exclude: Column, navigation: Column, restricted: Column) -> Column:
    """policy_reason() where hosts and patterns are columns of arrays, one set a source. Patterns compile; null counts as none.

    allow_text holds allowances that count as plain text, restricted says whether there is any allowance.
    """
    some = lambda array: F.coalesce(array, F.array().cast("array<string>"))
    any_in = lambda array, text: F.exists(some(array), lambda p: F.regexp_like(text, F.concat(F.lit("(?i)"), p)))
    path = urls.path(url)
    allowed = any_in(allow, url)
    told = allowed | F.exists(some(allow_text), lambda t: F.contains(F.lower(url), t))
    clean = url.rlike(r"^https?://[^/?#@]+(?:[/?#]|$)")
    return ladder(
        (url.isNull() | ~clean | ~F.array_contains(some(hosts), F.rtrim(F.lower(urls.host(url)), F.lit("."))), "not_official"),
        (any_in(exclude, url), "excluded"),
        (F.coalesce(url == source_url, F.lit(False)), "source_page"),
        (F.regexp_replace(path, "/+$", "") == "", "root_page"),
        (F.coalesce(restricted, F.lit(False)) & ~told, "not_allowed"),
        (any_in(navigation, path), "navigation"),
        (~told & matches(path, list(urls.NAVIGATION)), "default_navigation"),
    )


def accepted(df: DataFrame, url: str, **policy) -> DataFrame:
    return df.where(policy_reason(F.col(url), **policy).isNull())


def identity_match(text_key: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases, as comparison keys, occurs in the text's key; no phrases let all pass."""
    return any_of(*[F.contains(text_key, F.lit(p)) for p in phrases]) if phrases else F.lit(True)


def since(df: DataFrame, published: str, cutoff: Column) -> DataFrame:
    """Drops what is dated before the cutoff; undated rows stay."""
    return df.where(~F.coalesce(F.col(published) < cutoff, F.lit(False)))


def distinct_candidates(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first candidate of each key, with ``duplicates``, how many more there were."""
    w = W.partitionBy(key)
    return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1).where("_r = 1").drop("_r")


def capped(df: DataFrame, source: str, order: list[Column], limit: int = 10) -> DataFrame:
    """The first ``limit`` candidates of each source, and ``limited``, whether more were left."""
    w = W.partitionBy(source)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("limited", F.count("*").over(w) > limit)
    return ranked.where(F.col("_r") <= limit).drop("_r")


def next_batch(candidates: DataFrame, known: DataFrame, key: str, order: list[str], limit: int = 10) -> DataFrame:
    """The next ``limit`` candidates that are neither known nor repeated, each with ``remaining``, the number beyond them.

    Known ones and repeats go before the limit, so a batch is full while anything is left.
    """
    fresh = candidates.join(known.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(*order)).alias("_o"))
    left = first.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    batch = first.orderBy("_o", key).limit(limit).select(key, *[F.col(f"_o.{c}").alias(c) for c in order if c != key])
    return batch.join(F.broadcast(left), F.lit(True))


def run_order(df: DataFrame, run: str, key: str, order: list[Column], known: DataFrame) -> DataFrame:
    """Outcome of each meeting in a run: the first of a key is known or stored, later ones are duplicates."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(run, key).orderBy(*order)))
    marked = ranked.join(known.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    return marked.withColumn("outcome", F.when(F.col("_r") > 1, "duplicate").when(F.col("_known"), "already_known").otherwise("stored")).drop("_r", "_known")
