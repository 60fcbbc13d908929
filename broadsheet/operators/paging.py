"""Pages: by offset, by number and by key, each with its total from the same scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


def clamp(limit: int | None, offset: int | None = 0) -> tuple[int, int]:
    """Limit within 0 and MAX_LIMIT, offset not negative."""
    return min(max(DEFAULT_LIMIT if limit is None else int(limit), 0), MAX_LIMIT), max(int(offset or 0), 0)


def page_offset(page: int, page_size: int) -> tuple[int, int]:
    """(limit, offset) of a page, counted from 1."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    limit, _ = clamp(page_size)
    return limit, (page - 1) * limit


def cursor_offset(cursor: str | None, offset: int | None) -> int:
    """A cursor is an offset in decimal digits; both at once are an error."""
    if cursor is not None and offset is not None:
        raise ValueError("cursor and offset exclude each other")
    if cursor is not None and not cursor.isdigit():
        raise ValueError("cursor must be digits")
    return int(cursor or offset or 0)


def offset_page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = 0) -> DataFrame:
    """Rows offset to offset + limit. Each task keeps as many rows, so deep pages are for keyset_page()."""
    limit, offset = clamp(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = 0) -> DataFrame:
    """A page whose rows carry ``total``; an empty page is one row of nulls and the total.

    Total and page are one query, so they can't disagree. The total is one row and joins as a broadcast scalar.
    """
    page = offset_page(df, order, limit, offset)
    total = df.agg(F.count("*").alias("total"))
    return total.join(F.broadcast(page.withColumn("_here", F.lit(True))), F.lit(True), "left").select(*[F.col(f"`{c}`") for c in df.columns], "total")


def keyset_page(df: DataFrame, key: str, after, limit: int | None = None) -> DataFrame:
    """The rows after a key, in its order: the filter reaches the scan and top-k needs no full sort."""
    limit, _ = clamp(limit)
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
