"""Merges: consolidation of records that are one, and upserts as folds over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence(columns: list[str]) -> Column:
    """How many of the columns hold something."""
    return sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in columns), F.lit(0))


def keeper_merge(df: DataFrame, key: str, row_id: str, fill: list[str], weight: Column) -> DataFrame:
    """One record for each key: the keeper's fields, what it lacks filled from the others, and who was merged.

    The keeper has most evidence, then most weight, then the least id. A field that it lacks comes from the first other
    row, by id, that has it. max_by and min_by need no list of a group's rows; only the ids are listed, as provenance.
    """
    ranked = df.withColumn("_rank", F.struct(evidence(fill).alias("e"), weight.alias("w"), (-F.col(row_id)).alias("i")))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    merged = ranked.groupBy(key).agg(
        F.max_by(row_id, "_rank").alias("keeper"),
        *[F.coalesce(F.max_by(F.when(has(c), F.col(c)), "_rank"), F.min_by(c, F.when(has(c), F.col(row_id)))).alias(c) for c in fill],
        F.count("*").alias("merged"),
        F.array_sort(F.collect_set(row_id)).alias("_ids"),
    )
    return merged.withColumn("donors", F.array_remove("_ids", F.col("keeper"))).drop("_ids")


def discovery_fold(df: DataFrame, keys: list[str], at: str, raw: str, order: str) -> DataFrame:
    """One row for each key: first and last time, and the first raw value that isn't null, whatever the order of arrival."""
    return df.groupBy(*keys).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by(raw, F.when(F.col(raw).isNotNull(), F.struct(at, order))).alias("raw"), F.count("*").alias("seen")
    )


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str], created: str, updated: str) -> DataFrame:
    """One row for each key, null keys as empty: the last row's values, the least creation and the greatest update."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return df.groupBy(*named).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values], F.min(created).alias("created_at"), F.max(updated).alias("updated_at"), F.count("*").alias("merged"))


def upsert(old: DataFrame, new: DataFrame, key: str, business: list[str], evidence_only: list[str] = ()) -> DataFrame:
    """key, outcome (created, updated, unchanged, kept) and the new state of every row.

    A new value that isn't empty wins in business columns; in evidence columns any value that isn't null does. Only business
    columns decide whether a row is updated.
    """
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, key, "full_outer")
    state = {c: F.coalesce(F.when(F.col(f"b.{c}").cast("string") != "", F.col(f"b.{c}")), F.col(f"a.{c}")) for c in business}
    state |= {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in evidence_only}
    changed = sum((F.when(~state[c].eqNullSafe(F.col(f"a.{c}")), 1).otherwise(0) for c in business), F.lit(0)) > 0
    outcome = F.when(F.col("b._new").isNull(), "kept").when(F.col("a._old").isNull(), "created").when(changed, "updated").otherwise("unchanged")
    return joined.select(key, outcome.alias("outcome"), *[v.alias(c) for c, v in state.items()])


def partial_update(old: DataFrame, new: DataFrame, key: str, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Registry upsert: null in new means unspecified and keeps the old value; an empty value clears; ``keep`` is never touched."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns], *[F.col(f"a.{c}").alias(c) for c in keep])


def source_status(old: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Latest check of a source: last_success moves only with a success, and an unknown success keeps the old flag."""
    last = checks.groupBy(key).agg(F.max_by(F.struct("status", "success", "checked_at"), "checked_at").alias("n"), F.max(F.when(F.col("success"), F.col("checked_at"))).alias("good_at"))
    joined = old.join(last, key, "left")
    return joined.select(
        key,
        F.coalesce("n.status", "status").alias("status"),
        F.coalesce("n.success", "success").alias("success"),
        F.coalesce("n.checked_at", "last_checked").alias("last_checked"),
        F.greatest("last_success", "good_at").alias("last_success"),
    )


def registry_dedup(df: DataFrame, keys: list[str], order: str, fill: list[str], enabled: str) -> DataFrame:
    """First identity of each key, missing fields filled from later rows, enabled only if all are."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill], F.bool_and(enabled).alias(enabled), F.count("*").alias("n"))


def remap(references: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """References to donors (donor, keeper) point to their keepers; rows that become equal stay once."""
    joined = references.join(merged, F.col(column) == F.col("donor"), "left")
    return joined.withColumn(column, F.coalesce("keeper", column)).select(*references.columns).distinct()
