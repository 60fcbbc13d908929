"""Tables: logical columns over whatever is stored, and the store of them as a log."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.coerce import first_of

from .log import FILE_ROWS, Conflict, Log, Shape  # noqa: F401  Conflict for users of the store

_TS = "timestamp"
#: Logical tables: column -> type.
SCHEMAS = {
    "publishers": dict(id="string", slug="string", name="string", website_url="string", country_code="string", language="string", groups="array<string>", region="string", city="string", source_status="string", list_provenance="array<string>", enabled="boolean", metadata="string", created_at=_TS, updated_at=_TS),
    "sources": dict(id="string", publisher_id="string", url="string", normalized_url="string", kind="string", name="string", language="string", config="string", enabled="boolean", status="string", success="boolean", last_checked=_TS, last_success=_TS, last_error="string", last_http_status="int", created_at=_TS, updated_at=_TS),
    "articles": dict(id="string", canonical_url="string", normalized_url="string", source_url="string", source_url_raw="string", title="string", published_at=_TS, published_at_raw="string", updated_at_source=_TS, author="string", summary="string", content="string", content_html="string", image_url="string", parse_status="string", content_hash="string", content_identity_key="string", html_hash="string", raw_html="string", language="string", http_status="int", crawl_status="string", last_fetched_at=_TS, metadata="string", created_at=_TS, updated_at=_TS),
    "discoveries": dict(id="string", article_id="string", source_id="string", discovered_url="string", discovered_url_raw="string", discovered_key="string", discovered_at=_TS, last_discovered_at=_TS, metadata="string"),
    "identities": dict(article_id="string", publisher_id="string", title_key="string", created_at=_TS, updated_at=_TS),
    "runs": dict(id="string", batch_id="string", started_at=_TS, finished_at=_TS, duration_ms="bigint", status="string", error="string", metadata="string", heartbeat_at=_TS, progress_at=_TS, current_phase="string", current_publisher_id="string", current_source_id="string", progress="string", stop_reason="string"),
    "run_stats": dict(id="string", run_id="string", publisher_id="string", source_id="string", status="string", discovered="bigint", fetched="bigint", stored="bigint", already_known="bigint", duplicate_candidate="bigint", error_count="bigint", started_at=_TS, finished_at=_TS, duration_ms="bigint", error="string", stop_reason="string", errors="string", metadata="string"),
    "publisher_results": dict(id="string", run_id="string", publisher_id="string", publisher_slug="string", publisher_name="string", status="string", source_status="string", discovered="bigint", parsed="bigint", inserted="bigint", updated="bigint", failed="bigint", duplicate_filtered="bigint", duration_ms="bigint", source_url="string", http_status="int", error_category="string", error_summary="string", stop_reason="string", started_at=_TS, finished_at=_TS, metadata="string"),
    "run_events": dict(id="bigint", run_id="string", publisher_id="string", source_id="string", created_at=_TS, level="string", component="string", event_type="string", message="string", metadata="string"),
    "run_articles": dict(id="bigint", run_id="string", article_id="string", publisher_id="string", source_id="string", outcome="string", created_at=_TS, updated_at=_TS, metadata="string"),
    "leases": dict(name="string", owner="string", acquired_at=_TS, lease_until=_TS, heartbeat_at=_TS),
}
#: Keys of each table; null is a key of its own.
KEYS = {"publishers": ["id"], "sources": ["id"], "articles": ["id"], "discoveries": ["article_id", "source_id", "discovered_key"], "identities": ["article_id", "publisher_id"], "runs": ["id"], "run_stats": ["run_id", "publisher_id", "source_id"], "publisher_results": ["run_id", "publisher_id"], "run_events": ["id"], "run_articles": ["run_id", "article_id", "publisher_id", "source_id"], "leases": ["name"]}
#: Other names that stored tables have for logical columns.
ALIASES = {"publisher_id": ("zoo_id",), "publisher_slug": ("zoo_slug",), "publisher_name": ("zoo_name",), "run_id": ("crawl_run_id",), "metadata": ("metadata_json",), "config": ("config_json",), "groups": ("groups_json",), "errors": ("errors_json",), "progress": ("progress_json",), "discovered": ("discovered_count", "discovered_candidates"), "fetched": ("fetched_count",), "stored": ("stored_count",), "already_known": ("already_known_count",), "duplicate_candidate": ("duplicate_candidate_count", "duplicates"), "error_count": ("errors_count",)}
#: Never shown outside.
SENSITIVE = ("raw_html", "raw_html_json", "raw_html_text")


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in SCHEMAS[table].items()))


def logical(df: DataFrame, table: str) -> DataFrame:
    """The logical columns of a stored table: by name or alias, null where it has none."""
    out = []
    for column, kind in SCHEMAS[table].items():
        found = first_of(df, column, *ALIASES.get(column, ()))
        if kind == "array<string>" and dict(df.dtypes).get(column) != kind:
            found = F.from_json(found.cast("string"), kind)
        out.append((found.try_cast(kind) if kind != "array<string>" else found).alias(column))
    return df.select(*out)


def safe(df: DataFrame) -> DataFrame:
    """Without raw pages, whatever their columns' case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in SENSITIVE])


class Store(Log):
    """The logical tables as a log: see Log. Rows come in as they are stored, by any of their names."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = FILE_ROWS):
        super().__init__(spark, path, {t: Shape(columns, tuple(KEYS[t])) for t, columns in SCHEMAS.items()}, file_rows)

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> dict[str, list[dict]]:
        """Writes some tables anew and makes them count at once. Conflict if one has changed since manifest ``base``."""
        return self.replace({t: logical(df, t) for t, df in tables.items()}, base)

    def upsert(self, table: str, rows: DataFrame) -> dict[str, list[dict]]:
        """Rows replace those of the same key; others stay. Of several new rows with a key, one stays. Only the rows are written."""
        return self.append({table: (logical(rows, table), None)})

    def delete(self, table: str, keys: DataFrame) -> dict[str, list[dict]]:
        """Removes the rows of the keys."""
        return self.append({table: (None, keys)})


def atomic_write(path: str, content: bytes) -> None:
    """A local file, replaced as a whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        with suppress(OSError):
            os.unlink(temporary)
        raise


def write_report(folder: str, files: dict[str, bytes]) -> dict[str, dict]:
    """Report files of one projection, then a manifest of their sizes and hashes: without it, the report isn't there."""
    with suppress(FileNotFoundError):
        os.unlink(os.path.join(folder, "manifest.json"))
    manifest = {}
    for name, content in sorted(files.items()):
        atomic_write(os.path.join(folder, name), content)
        manifest[name] = {"sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)}
    atomic_write(os.path.join(folder, "manifest.json"), json.dumps(manifest, indent=2, sort_keys=True).encode())
    return manifest
