"""Coercion: first present value, integers, flags, JSON and counts, as expressions that never fail a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(df: DataFrame, *names: str, default=None) -> Column:
    """The first of several possible columns that df has and that is not null."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def safe_int(value: Column) -> Column:
    """Integer of a text or number; null for decimals and all else."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("bigint"))


def count(value: Column) -> Column:
    """A count: 0 where it is missing, never negative."""
    return F.greatest(F.coalesce(safe_int(value), F.lit(0)), F.lit(0))


# Words for yes and no.
TRUE, FALSE = ("1", "true", "yes", "on", "enabled"), ("0", "false", "no", "off", "disabled")


def flag(value: Column, unknown: bool | None = None) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).otherwise(F.lit(unknown).cast("boolean"))


def json_field(text: Column, path: str) -> Column:
    """Text of a field of a JSON object; null for malformed JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, "string")


def json_list(text: Column) -> Column:
    """Array of texts from a JSON list; a text that is no list is its only element, an empty one none."""
    parsed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    plain = F.nullif(F.trim(text), F.lit(""))
    return F.when(plain.isNull(), F.array().cast("array<string>")).when(plain.startswith("["), F.coalesce(parsed, F.array(plain))).otherwise(F.array(plain))


def error_count(explicit: Column, errors: Column, error: Column) -> Column:
    """The larger of the count that was stored and what the errors show."""
    listed = F.size(json_list(errors))
    shown = F.when(listed > 0, listed).when(F.coalesce(error, F.lit("")) != "", 1).otherwise(0)
    return F.greatest(count(explicit), shown.cast("long"))


def add_error(classes: Column, details: Column, name: Column, detail: Column) -> tuple[Column, Column, Column]:
    """(classes, details, first class) of a record with one more error; what it already has isn't repeated."""
    none = F.array().cast("array<string>")
    word = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    more = F.array_union(F.coalesce(classes, none), F.array(word))
    return more, F.array_union(F.coalesce(details, none), F.array(detail)), F.element_at(more, 1)


def stop_reason(column: Column, metadata: Column) -> Column:
    """Why a run stopped: its column, else what its metadata says under any of the usual names."""
    said = [F.nullif(F.trim(json_field(metadata, f"$.{k}")), F.lit("")) for k in ("stop_reason", "stopReason", "reason", "termination_reason", "terminationReason")]
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), *said)
