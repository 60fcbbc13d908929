"""Scalar functions. ``register`` makes those that need Python callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import dates, texts, urls


def register(spark: SparkSession) -> list[str]:
    found = urls.SQL_FUNCTIONS | texts.SQL_FUNCTIONS | dates.SQL_FUNCTIONS
    for name, function in found.items():
        spark.udf.register(name, function)
    return sorted(found)
