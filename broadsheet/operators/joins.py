"""Joins with the semantics that audits and reports need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def any_key_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[tuple[Column, Column]]) -> DataFrame:
    """(left_id, right_id, place): for each left row the right row that matches on the first of several keys.

    Each key is an equi-join of its own, in place of one join with OR, which would compare all pairs. Among rows that match
    on the same key the least right_id wins.
    """
    found = []
    for place, (a, b) in enumerate(keys):
        x = left.select(F.col(left_id), a.alias("_k")).where("_k is not null")
        y = right.select(F.col(right_id), b.alias("_k")).where("_k is not null")
        found.append(x.join(y, "_k").select(left_id, right_id, F.lit(place).alias("place")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(left_id).agg(F.min(F.struct("place", right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.place")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; right columns other than the keys are added."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, on, how).select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in keys])


def prefer(result: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge: a key's stored result wins as a whole, else its fallback; ``from_result`` says which."""
    values = [c for c in result.columns if c not in keys]
    a, b = result.withColumn("_has", F.lit(True)).alias("a"), fallback.alias("b")
    joined = a.join(b, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("a._has"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values], F.coalesce(F.col("a._has"), F.lit(False)).alias("from_result"))


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of expected that actual lacks."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def coverage(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, state: whether each key has exactly one result, none, several, or wasn't expected."""
    counted = results.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).join(counted, keys, "full_outer")
    n = F.coalesce("n", F.lit(0))
    state = F.when(F.col("_e").isNull(), "extra").when(n == 0, "missing").when(n > 1, "duplicate").otherwise("exactly_one")
    return joined.select(*keys, n.alias("n"), state.alias("state"))


def set_changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after, change (added, removed, changed) of the keys whose value isn't the same in both."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("change", change).where("change is not null").select(*keys, "before", "after", "change")


def within(evidence: DataFrame, windows: DataFrame, key: str, at: str, start: str, end: str, tolerance: str = "1 second") -> DataFrame:
    """evidence with ``inside``: whether it lies in the window of its key, give or take the tolerance."""
    slack = F.expr(f"INTERVAL {tolerance}")
    joined = evidence.join(windows.select(key, start, end), key)
    return joined.withColumn("inside", (F.col(at) >= F.col(start) - slack) & (F.col(at) <= F.col(end) + slack))


def enrich(facts: DataFrame, dimension: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """facts left-joined to a dimension, whose columns get new names; its size decides whether Spark broadcasts it."""
    return facts.join(dimension.select(key, *[F.col(c).alias(n) for c, n in columns.items()]), key, "left")


def previous_and_next(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(f"previous_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))
