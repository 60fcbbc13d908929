"""Roll-ups: run summaries, histograms over a fixed vocabulary, coverage and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(value: Column) -> Column:
    """Sum of counts, missing ones as 0 and negative ones as 0."""
    return F.sum(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))).cast("long")


def optional_total(value: Column) -> Column:
    """Sum of counts that is null if no row has one."""
    return F.sum(value).cast("long")


def source_parts(stats: DataFrame, run: str, metrics: dict[str, Column], publisher: str, source: str, completed: Column, stop_reason: str, order: list[Column]) -> DataFrame:
    """What a run's summary needs of each of its sources: sums of metrics, whether all is done, the first stop reason."""
    stop = F.min(F.when(F.col(stop_reason).isNotNull(), F.struct(*order, F.col(stop_reason).alias("reason"))))
    return stats.groupBy(run, publisher, source).agg(*[total(v).alias(k) for k, v in metrics.items()], F.bool_and(completed).alias("done"), stop.alias("stop"))


def fold_parts(parts: DataFrame, run: str, publisher: str, metrics: list[str]) -> DataFrame:
    """The summaries of runs from the parts of all their sources."""
    by_publisher = parts.groupBy(run, publisher).agg(
        *[F.sum(k).alias(k) for k in metrics],
        F.bool_and("done").alias("all_done"),
        F.count_if("done").alias("sources_done"),
        F.count("*").alias("sources"),
        F.min("stop").alias("stop"),
    )
    return by_publisher.groupBy(run).agg(
        *[F.sum(k).cast("long").alias(k) for k in metrics],
        F.count("*").alias("publishers"),
        F.sum("sources").cast("long").alias("sources"),
        F.count_if("all_done").alias("publishers_completed"),
        F.sum("sources_done").cast("long").alias("sources_completed"),
        F.min("stop")["reason"].alias("stop_reason"),
    )


def run_summary(stats: DataFrame, run: str, metrics: dict[str, Column], publisher: str, source: str, completed: Column, stop_reason: str, order: list[Column]) -> DataFrame:
    """One row a run: sums of metrics, distinct publishers and sources, how many of them completed wholly, first stop reason."""
    return fold_parts(source_parts(stats, run, metrics, publisher, source, completed, stop_reason, order), run, publisher, list(metrics))


def zero_filled(df: DataFrame, key: str, vocabulary: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates for each word of a fixed vocabulary, 0 where none is seen; other values are left out."""
    words = df.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{key} string")
    counted = df.groupBy(key).agg(*[v.alias(k) for k, v in aggregates.items()])
    return words.join(counted, key, "left").select(key, *[F.coalesce(k, F.lit(0)).alias(k) for k in aggregates])


def percent(part: Column, whole: Column) -> Column:
    """Percentage of two places; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 2))


def excess(count: Column) -> Column:
    """How many of a group are more than one."""
    return F.greatest(count - 1, F.lit(0))


def duplicate_groups(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """Values that several rows share, with their number; empty values are none."""
    return df.select(key.alias(name)).where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "").groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def joined_values(value: Column, separator: str = ", ") -> Column:
    """Distinct values in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def same_date(df: DataFrame, key: str, at: Column, least: int = 3) -> DataFrame:
    """Keys with at least ``least`` dated rows that all have one date."""
    dated = df.where(at.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"))
    return dated.where((F.col("n") >= least) & (F.col("first") == F.col("last"))).select(key, "n", F.col("first").alias("date"))


def relative_change(latest: DataFrame, previous: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, latest, previous, change over two frames of rows."""

    def sums(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in metrics])
        return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics])))

    return sums(latest, "latest").join(sums(previous, "previous"), "metric").withColumn("change", F.col("latest") - F.col("previous"))


def suppressed(detail: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, without those of summary that only repeat a detail row's keys."""
    return detail.unionByName(summary.join(detail.select(*keys).distinct(), keys, "left_anti"))


def verdict(checks: DataFrame, status: str = "status") -> DataFrame:
    """PASS if all checks pass, FAIL if one fails, else INCOMPLETE."""
    failed, passed = F.count_if(F.col(status) == "FAIL"), F.bool_and(F.col(status) == "PASS")
    return checks.agg(F.count("*").alias("checks"), failed.alias("failed"), F.when(failed > 0, "FAIL").when(passed, "PASS").otherwise("INCOMPLETE").alias("verdict"))


def two_run_dedup(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of each run, keys new in the second, met again, and rows beyond the distinct ones."""
    seen = first.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    by_key = seen.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return by_key.agg(
        F.count_if(F.col("a") > 0).alias("first_distinct"),
        F.count_if(F.col("b") > 0).alias("second_distinct"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("new_keys"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("again"),
        F.coalesce(F.sum(excess(F.col("a")) + excess(F.col("b"))), F.lit(0)).cast("long").alias("repeated_rows"),
    )
