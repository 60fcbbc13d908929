"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles. The sketch of
a union is the bottom k of the sketches' union, so parts of a text, or texts of a group, can be sketched apart and merged.
Fewer than k hashes mean that the sketch holds the whole set, and then all estimates are exact.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, shingle_hashes, shuffle_partitions, table, words

K = 128
#: Ranges of neighbouring ids for each shuffle partition, so that partitions get equally many rows.
RANGES = 8


def sketch(text: Column, k: int = K) -> Column:
    """Null and empty texts, and texts without letters or digits, have the empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words(text)))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each group. Hashes are made distinct and cut to k a group in each task before they are shuffled."""
    hashes = df.select(*keys, F.explode_outer(sketch_col).alias("_h")).groupBy(*keys, "_h").agg(F.lit(1).alias("_one"))
    low = hashes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_r") <= k)
    return low.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))  # at most k for each group


def distinct_shingles(sk: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) / (the k-th hash as a share of the hash range)."""
    share = (F.element_at(sk, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sk) < k, F.size(sk).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the bottom k of both, the share that both hold. Two empty sketches are alike."""
    return let(merged(a, b, k), lambda low: F.when(F.size(low) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), low)) / F.size(low)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too: |a and b| / |a|. An empty a is contained in all."""
    shared = resemblance(a, b, k) * let(merged(a, b, k), lambda low: distinct_shingles(low, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def encoded(sk: Column) -> Column:
    """Text form: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _place(value: Column, marks: list[int]) -> Column:
    """How many of the ascending marks are at most the value: every so manieth mark first, then those in between."""
    if not marks:
        return F.lit(0)
    step = math.isqrt(len(marks)) + 1
    fixed = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")  # noqa: E731  folded to one constant
    under = lambda some: F.size(F.filter(some, lambda m: m <= value))
    return let(under(fixed(marks[::step])), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + under(F.slice(fixed(marks), (c - 1) * step + 1, F.lit(step)))))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``_next``, the text of the row after it in descending doc_id (then hash of the text); after the last row comes the first.

    Ids are dealt to ranges between quantiles; an id that fills more than a range, or many null ids, are parted by the hash of
    the text, so only rows that are equal in both stay together. A range is put in order by itself, and the first row of each
    range is lent to the range before it. So no task sees more than a range, and texts are shuffled once. Null ids come last.
    """
    n = RANGES * shuffle_partitions(docs.sparkSession)
    one = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("m"), F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    counted = Counter(one["m"] or [])  # at most n
    marks, large = sorted(counted), {i: m for i, m in counted.items() if m > 1}
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    share = (F.col("_hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    parts = F.when(F.col("doc_id").isNull(), -(-n * one["nulls"] // max(one["rows"], 1)))
    if large:
        parts = parts.otherwise(F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in large.items() for x in pair]), F.col("doc_id")))
    # Rows of a large id come after the others of its range, parted by hash.
    part = F.coalesce(1 + F.floor(share * parts), F.lit(0))
    of = F.when(F.col("doc_id").isNull(), -1).otherwise(_place(F.col("doc_id"), marks)) * (n + 2) + (n + 1 - part)
    heads = docs.groupBy(of.alias("range")).agg(F.min(F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("id"), "_hash", F.col("doc_id").alias("doc_id"))).alias("h")).orderBy(F.desc("range")).collect()  # at most 3 n
    if not heads:
        return docs.withColumn("_next", F.lit(None).cast("string"))
    lent = docs.sparkSession.createDataFrame([(h["h"]["doc_id"], h["h"]["_hash"], before["range"], True) for before, h in zip(heads, [*heads[1:], heads[0]], strict=True)], "_id long, _of long, _to long, _lent boolean")
    # The rows that start a range, again, one of those that are equal.
    first = docs.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))).dropDuplicates(["_to"]).withColumn("_range", F.col("_to"))
    rows = docs.withColumn("_lent", F.lit(False)).withColumn("_range", of.cast("long"))
    # What wraps around to the first row comes after all rows of its range.
    both = rows.unionByName(first.select(*docs.columns, "_lent", "_range"))
    return both.withColumn("_next", F.lead("text").over(_ordered()))


def _ordered():
    return W.partitionBy("_range").orderBy("_lent", F.col("doc_id").desc_nulls_last(), "_hash", "text")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and estimates, one row a document.

    docs: doc_id, text. Null text is empty. Repeated rows stay; among equal ids the order is by hash of the text. A single document is
    its own next one. The edited text swaps the last floor(n / 2) characters for the next text's first as many.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    if "_range" not in rows.columns:
        rows = rows.withColumn("_range", F.lit(0)).withColumn("_lent", F.lit(False))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = (
        rows.withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("sk", sketch(F.col("text"), k))
        .withColumn("next_sk", F.lead("sk").over(_ordered()))
        .where(~F.col("_lent"))
        .withColumn("edited_sk", sketch(F.col("edited"), k))
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("sk")).alias("fingerprint"),
        encoded(F.col("edited_sk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.coalesce("next_sk", "sk"), k).alias("near_next"),
        distinct_shingles(F.col("sk"), k).alias("shingles"),
        containment(F.col("sk"), F.col("edited_sk"), k).alias("kept_in_edited"),
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
