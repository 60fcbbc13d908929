"""A training corpus from raw documents: toxicity, line dedup, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents. Stages are written to the shared folder and read again, so that a lost executor never repeats an earlier stage;
what a stage has staged for itself goes once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm.common import bounded_batches, mark, release, staged, table
from broadsheet.llm.line_templates import drop_recurring_lines
from broadsheet.llm.mixing import mix_documents
from broadsheet.llm.ngram_join import drop_near_duplicates
from broadsheet.llm.packing import pack, vocabulary
from broadsheet.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Models come from the labelled documents outside the held-out fifth."""
    bounded_batches(spark)
    return drop_toxic(docs, train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go from all but the first document; n_chars follows the text."""
    return drop_recurring_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("packing", packing),
]

#: The models of the first stage are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, began = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        release(spark, keep=docs, since=began)
    return STAGES[-1][1](spark, docs, sf_dir)
