"""Analytics for multi-publisher news corpora, expressed as Spark plans."""

__version__ = "0.1.0"
