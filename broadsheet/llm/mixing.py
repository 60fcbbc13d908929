"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow, every document of it a packet. Documents are shuffled by a hash of their id, repeated for up to
``max_repeats`` passes, and get the virtual finish time (tokens of their source up to and with them) / (target of their
source). All packets are range-sorted by that time over the whole cluster, which interleaves the sources in proportion to
their targets, so cutting the sorted sequence at the total budget leaves each source near its target, whatever the size of
its documents.

Nothing is sorted in one task. Prefix sums in a source have two levels: a slice of the hash range, then the documents of
that slice, so a source with a third of all rows is spread over 4096 groups. Documents that tie (same source, hash, id
and size, as repeated rows do) are one entry there and are numbered apart, over PARTS shares of the tie. For the cut, the
range partitions are summed (one number each reaches the driver), the partition that the cut falls in is parted again until
it has FEW packets, and only those are summed document by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, may_hold, shuffle_partitions, staged, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slices of the hash range in each source (bits), and shares of a tie.
SLICE_BITS, PARTS = 12, 256
#: Packets that one task may sum one by one.
FEW = 100_000


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> (source, source_size, rank, target): water-filling of the whole budget, one row a source.

    Sources rank by code point, null last; weights repeat along the ranks. Resharing what sources above their cap give up
    ends at one common level: capped are the first sources by cap / weight, the rest share what remains by weight.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = W.orderBy("ratio", "rank")
    return (
        totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", w.cast("double"))
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(W.partitionBy()).cast("double") - F.col("before")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(W.partitionBy()))
        .select("source", "source_size", "rank", F.when(F.struct("ratio", "rank") < F.struct("level.ratio", "level.rank"), F.col("cap")).otherwise(F.col("weight") * F.col("level.level")).alias("target"))
    )


#: The order of the queue; ``cum`` parts the documents of a source.
ORDER = ("finish", "rank", "cum", "pass")


def _finish(number):
    return (number * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")


def _numbered(rows: DataFrame, tie: list[str]) -> DataFrame:
    """rows (tie, row, n), n rows in each tie, with ``k``: 1 to n within the tie. A tie is numbered by shares of its rows."""
    single = rows.where("n = 1").withColumn("k", F.lit(1).cast("long"))
    many = rows.where("n > 1").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    sums = many.groupBy(*tie, "part").agg(F.count("*").alias("m"))
    before = W.partitionBy(*tie).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = staged(sums.select(*tie, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before")), "ties").hint("merge")
    a, b = many.alias("a"), sums.alias("b")
    same = F.lit(True)
    for c in (*tie, "part"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    within = F.row_number().over(W.partitionBy(*[F.col(f"a.{c}") for c in tie], "a.part").orderBy("a.row"))
    return single.unionByName(a.join(b, same).select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("before") + within).alias("k")))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, key: list | None = None, times: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Null text has size 0. A null doc_id shuffles by its text; a null source is a source of its own, ranked last. Rows equal
    in id, source and size are numbered and taken one by one, so no tie goes past the target. ``key`` adds columns that are
    carried along; ``times`` adds ``queue``, the finish times of the passes that are taken, in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.md5(text)))
    h = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"), *(key or []))
    extra = [c for c in rows.columns if c not in ("doc_id", "source", "size", "h")]
    sk = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk")
    rows = staged(rows.select("*", sk, F.monotonically_increasing_id().alias("row")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    targets = staged(targets.select(sk, "source_size", "rank", "target"), "targets")  # one row a source

    tie = ["sk", "h", "doc_id", "size"]
    slot = F.shiftright("h", 60 - SLICE_BITS).alias("slice")  # h has 60 bits
    entries = staged(rows.where("size > 0").groupBy(*tie).agg(F.count("*").alias("n")).select("*", slot), "entries")
    sums = entries.groupBy("sk", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    sums = sums.select("sk", "slice", F.coalesce(F.sum("words").over(W.partitionBy("sk").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = W.partitionBy("sk", "slice").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = entries.join(sums, ["sk", "slice"]).select(*tie, "n", (F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0))).alias("start"))
    placed = staged(placed, "placed").hint("merge")
    r, p = rows.where("size > 0").alias("r"), placed.alias("p")
    same = (F.col("r.sk") == F.col("p.sk")) & (F.col("r.h") == F.col("p.h")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.size") == F.col("p.size"))
    sized = _numbered(r.join(p, same).select("r.*", "p.n", "p.start"), tie).withColumn("cum", F.col("start") + F.col("k") * F.col("size"))
    kept = ["doc_id", "source", "size", "sk", "row", *extra, "cum"]
    timed = sized.select(*kept).unionByName(rows.where("size = 0").withColumn("cum", F.lit(0).cast("long")).select(*kept))
    timed = staged(timed.join(targets, "sk"), "finish")

    cut = _cut(timed, max_repeats)
    numbers = range(max_repeats)
    goes = [F.lit(True) if cut is None else _before([_finish(F.lit(p)), F.col("rank"), F.col("cum"), F.lit(p)], cut) for p in numbers]
    taken = sum((F.when(g, 1).otherwise(0) for g in goes), F.lit(0))
    taken = F.when(F.col("size") > 0, F.col("size") * taken).otherwise(F.lit(0)).cast("long")
    queue = F.when(F.col("size") > 0, F.array_compact(F.array(*[F.when(g, _finish(F.lit(p))) for p, g in zip(numbers, goes, strict=True)]))).otherwise(F.array().cast("array<double>"))
    return timed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *extra, *([queue.alias("queue"), "rank", "cum", "row"] if times else []))


def _before(left: list, right: tuple):
    """left < right, column after column."""
    said = F.lit(False)
    for a, b in reversed(list(zip(left, right, strict=True))):
        said = (a < F.lit(b)) | ((a == F.lit(b)) & said)
    return said


def _cut(timed: DataFrame, max_repeats: int, few: int = FEW) -> tuple | None:
    """The first packet, in ORDER, that the budget no longer holds: from all packets, range-sorted.

    The range that the cut falls in is sorted into ranges again until it has few packets, and only these are summed in one task.
    """
    budget = timed.agg(F.sum("size")).first()[0] or 0
    packets = timed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("finish", _finish(F.col("pass")))
    packets, used = packets.select(*ORDER, "size"), 0
    while True:
        ranges = packets.repartitionByRange(shuffle_partitions(timed.sparkSession), *ORDER)
        ranges = staged(ranges.withColumn("range", F.spark_partition_id()), "queue")
        cut = None
        for r in ranges.groupBy("range").agg(F.sum("size").alias("words"), F.count("*").alias("n")).orderBy("range").collect():  # one row a partition
            if used + r["words"] > budget:
                cut = r
                break
            used += r["words"]
        if cut is None:
            return None
        packets = ranges.where(F.col("range") == cut["range"]).select(*ORDER, "size")
        if cut["n"] <= few:
            run = F.lit(used) + F.sum("size").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow))
            return tuple(packets.select(*ORDER, run.alias("run")).where(F.col("run") > budget).orderBy(*ORDER).select(*ORDER).first())


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix in the order of the queue, each as often as it is taken, with the columns of ``docs``.

    Rows are range-partitioned by finish time and sorted within, so partitions one after the other are the queue. Rows that
    are equal in id, source and text are one document, taken as often as all of them are, with the other columns of any.
    """
    name = fresh(docs, "fp")
    d = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = mixed_sizes(docs, weights, max_repeats, [F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("fp")], times=True)
    rows = staged(rows.where("taken > 0").select("doc_id", "source", "fp", F.explode("queue").alias("finish"), "rank", "cum", "row"), "mixed")
    again = staged(rows.groupBy("doc_id", "source", "fp").agg((F.min("row") < F.max("row")).alias("many")).where("many").select("fp").distinct(), "again")
    unsure, sure = may_hold(d, F.col(name), again, "fp")
    one, t = sure.unionByName(unsure.dropDuplicates(["doc_id", "source", name])).alias("d"), rows.hint("merge").alias("t")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col(f"d.{name}") == F.col("t.fp"))
    place = fresh(docs, "place")
    found = one.join(t, on).select(*[F.col(f"d.`{c}`") for c in docs.columns], F.struct("t.finish", "t.rank", "t.cum").alias(place))
    return found.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col(place)).sortWithinPartitions(place).drop(place)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP7_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'n' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM totals),
weighed AS (SELECT *, CAST([5, 2, 1][((rank - 1) % 3) + 1] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
best AS (SELECT ratio AS r, rank AS k, level AS l FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank, CASE WHEN (ratio, rank) < (r, k) THEN cap ELSE weight * l END AS target FROM levels CROSS JOIN best),
timed AS MATERIALIZED (
  SELECT rows.*, source_size, rank, target,
         sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         row_number() OVER () AS number
  FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source),
packets AS (
  SELECT *, CAST(pass * source_size + cum AS DOUBLE) / target AS finish FROM timed CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, cum, pass ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM packets),
kept AS (SELECT number, count(*) AS times FROM run WHERE run <= (SELECT sum(size) FROM rows) GROUP BY number)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(size * times, 0) AS BIGINT) AS taken FROM timed LEFT JOIN kept USING (number)
"""
