"""Latest, first and best rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Each task keeps n a key before the shuffle (window group limit)."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def best_value(df: DataFrame, keys: list[str], value: Column, by: Column, alias: str) -> DataFrame:
    """The value of the greatest ``by`` for each key, with partial sums in each task."""
    return df.groupBy(*keys).agg(F.max_by(value, by).alias(alias))


def priority_value(df: DataFrame, keys: list[str], value: str, priorities: dict[str, int], alias: str) -> DataFrame:
    """The value of highest priority for each key; unknown values have priority 0, ties go to the greater text."""
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in priorities.items() for x in pair]), F.col(value)), F.lit(0))
    return best_value(df, keys, F.col(value), F.struct(of, F.col(value)), alias)


def current_run(runs: DataFrame, state: str, started: str, run_id: str) -> DataFrame:
    """The first running run, else the first stale one, else the newest."""
    order = F.when(F.col(state) == "running", 0).when(F.col(state) == "stale", 1).otherwise(2)
    return runs.orderBy(order, F.col(started).desc_nulls_last(), F.col(run_id).desc()).limit(1)


def latest_two(runs: DataFrame, order: list[Column]) -> DataFrame:
    """The latest and the previous run, as place 1 and 2."""
    top = runs.orderBy(*order).limit(2)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))
