"""What the corpus operators share: table access, shared scratch tables, word and shingle expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.scratch import mark, release, scratch_dir, staged  # noqa: F401  for the operators

#: One word of a text: a maximal run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one Arrow batch carries to Python. Texts may be long, so batches stay short.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bits of one page of a filter, and most pages: 32 MB in all.
PAGE_BITS, MOST_PAGES = 32_768, 8192


def may_hold(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows, parted by a filter of one bit a hash: (those whose key may be in wanted's column, those whose key isn't there).

    key and the column ``name`` of wanted are 64-bit hashes. The filter has at least 16 bits for each wanted row, so one
    row in 16 is let through in vain; beyond 16 million rows its size stays and more are. What may be there is to be joined.
    """
    pages = 1
    count = wanted.count()
    while pages < MOST_PAGES and pages * PAGE_BITS < 16 * count:
        pages *= 2
    bit = lambda h: F.pmod(h, F.lit(pages * PAGE_BITS))
    page = lambda h: F.floor(bit(h) / PAGE_BITS).cast("int")
    at = lambda h: F.pmod(h, F.lit(PAGE_BITS)).cast("int")
    told = wanted.select(page(F.col(name)).alias("_page"), at(F.col(name)).alias("_at")).groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    marks = F.broadcast(told)  # at most 8192 rows of 4 KB
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at(key) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (page(key) == F.col("_page")) & (F.getbit(byte, F.pmod(key, F.lit(8)).cast("int")) == 1)
    return rows.join(marks, hit, "left_semi"), rows.join(marks, hit, "left_anti")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for long texts, unless the session already asks for smaller ones."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that a lambda repeats would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. Null counts as empty; an empty text has no words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(word_array: Column, width: int = 5) -> Column:
    """64-bit hashes of all runs of ``width`` words, repeats included; a shorter text is one shingle of all its words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)])
        return (
            F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), at))
            .when(n > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(word_array, runs)
