"""Consolidation of stored records that are one, each as one aggregate by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import classify
from broadsheet.functions.texts import present

from .merges import evidence, keeper_merge, remap


def sources(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sources, donors): one source for each publisher and URL, that with most evidence; donors: donor, keeper."""
    keyed = df.withColumn("_key", F.concat_ws("\x00", "publisher_id", "normalized_url"))
    merged = keeper_merge(keyed, "_key", "id", columns, F.lit(0))
    donors = merged.select(F.explode("donors").alias("donor"), F.col("keeper"))
    return merged.select(F.col("keeper").alias("id"), *columns), donors


def discoveries(df: DataFrame, donors: DataFrame | None = None) -> DataFrame:
    """One discovery for each article, source and key: first and last time, first URL; references to donors follow."""
    if donors is not None:
        df = remap(df, donors, "source_id")
    key = F.coalesce(present(F.col("discovered_key")), F.lit("")).alias("discovered_key")
    return df.groupBy("article_id", "source_id", key).agg(
        F.min("discovered_at").alias("discovered_at"), F.max(F.greatest("discovered_at", "last_discovered_at")).alias("last_discovered_at"), F.min_by("discovered_url", F.when(present(F.col("discovered_url")).isNotNull(), F.struct("discovered_at", "id"))).alias("discovered_url"), F.min("id").alias("id")
    )


def results(df: DataFrame, columns: list[str]) -> DataFrame:
    """One result for each run and publisher: most evidence, then finished last, started last, least id."""
    order = F.struct(evidence(columns).alias("e"), F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp")).alias("f"), F.coalesce("started_at", F.lit("1970-01-01").cast("timestamp")).alias("s"), (-F.col("id")).alias("i"))
    return df.groupBy("run_id", "publisher_id").agg(F.max_by(F.struct("id", *columns), order).alias("r")).select("run_id", "publisher_id", "r.*")


def leases(df: DataFrame) -> DataFrame:
    """One lease for each name: with an owner before without, furthest expiry, latest heartbeat."""
    order = F.struct(present(F.col("owner")).isNotNull().alias("o"), F.col("lease_until").isNotNull().alias("v"), "lease_until", "heartbeat_at")
    return df.groupBy("name").agg(F.max_by(F.struct("owner", "lease_until", "heartbeat_at"), order).alias("l")).select("name", "l.*")


def least_id(df: DataFrame, column: str, row_id: str = "id") -> DataFrame:
    """The row of least id for each value; rows without a value all stay."""
    columns = [c for c in df.columns if c != column]
    kept = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min_by(F.struct(*columns), row_id).alias("r")).select(column, "r.*")
    return kept.select(*df.columns).unionByName(df.where(F.col(column).isNull()))


def roster(publishers: DataFrame, declared: int | None) -> DataFrame:
    """One row: members, distinct ones, provenances, and whether the roster is complete: unique, of one origin, as many as declared."""
    x = publishers.agg(F.count("*").alias("members"), F.countDistinct("id").alias("distinct_members"), F.countDistinct("provenance").alias("provenances"), F.count_if(F.col("provenance").isNull()).alias("without"))
    whole = (F.col("members") == F.col("distinct_members")) & (F.col("provenances") == 1) & (F.col("without") == 0)
    return x.withColumn("complete", whole & (F.col("members") == declared) if declared is not None else F.lit(False))


def empty_publishers(publishers: DataFrame, sources_: DataFrame) -> DataFrame:
    """Publishers without an enabled source: no items where a provenance vouches for it, else a broken configuration."""
    bare = publishers.where("enabled").join(sources_.where("enabled").select(F.col("publisher_id").alias("id")).distinct(), "id", "left_anti")
    vouched = present(F.col("provenance")).isNotNull() & F.col("source_status").isin("not_found", "source_not_found", "success_no_items", "unsupported")
    return bare.select("id", F.when(vouched, "success_no_items").otherwise("configuration_error").alias("status"))


def evidence_flags(df: DataFrame, categories: str, status: str, http_status: str) -> DataFrame:
    """external and blocking for rows with an array of categories; an explicit one outweighs the response status."""
    classes = F.transform(categories, lambda v: classify.failure_class(v))
    named = F.exists(categories, lambda v: ~classify.token(v).isin(*classify.GENERIC))
    by_http = F.coalesce(classify.external(classify.http_class(F.col(http_status), "")), F.lit(False))
    generic = classify.token(F.col(status)).isin("failed", "failure", "error", "partial", "warning", "completed_with_errors")
    blocking = F.exists(classes, lambda v: classify.blocking(v)) & ~(by_http & ~named & generic)
    outside = F.exists(classes, lambda v: classify.external(v)) | (by_http & ~blocking)
    return df.withColumn("external", outside).withColumn("blocking", blocking)
