"""The query catalogue on the driver's tables."""

from __future__ import annotations

from .registry import QUERIES, SQL  # noqa: F401


def load() -> None:
    from . import articles, console, documents, flagship, operations  # noqa: F401
