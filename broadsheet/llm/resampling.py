"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of words. Their strings are counted over all texts of both tables, each distinct string is hashed to a
bucket once, and the buckets' counts give each bucket a gain: how much likelier the target is to show it. The dictionary
(feature, gain) then goes back to the documents' own feature counts, and a document's weight is the mean gain of its
features. Gumbel noise from a hash of the id turns the weights into a draw without replacement: the largest sums win.

Counting adds up within each task before anything is shuffled. On the way back, the features that make up one in HOT of
all occurrences are at most HOT strings of bounded length, whatever the corpus; they are looked up where the text is read.
The others are shuffled, as (document, feature, count), and no key among them is frequent, unless it is very long. Ranks
come from a range sort: a task numbers its range, one count a range reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, staged, table

#: Buckets, longest run of words, least words of a document that takes part, percentage drawn, and seed of the noise.
BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: A feature is looked up without a shuffle if it is one in so many of all occurrences, and no longer than this.
HOT, HOT_CHARS = 20_000, 64

#: What each byte of a text reads as: digits, a to z and bytes of other letters themselves, A to Z in lower case, others a space.
READS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Distinct features that a task adds up before it hands them on.
HELD = 200_000


def features(text: bytes | None, run: int = RUN) -> tuple[int, Counter]:
    """Number of words of a UTF-8 text, and counts of its runs of 1 to ``run`` words."""
    words = (text or b"").translate(READS).split()
    found = Counter(words)
    for n in range(2, run + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _strings(texts) -> pa.Array:
    return pa.array(list(texts), pa.binary()).cast(pa.string())


def feature_counts(texts: DataFrame, run: int = RUN) -> DataFrame:
    """(feature, n) over all of texts (text), added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                total.update(features(text, run)[1])
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([_strings(total), pa.array(total.values(), pa.int64())], ["feature", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([_strings(total), pa.array(total.values(), pa.int64())], ["feature", "n"])

    return texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def bucket_gains(dictionary: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of dictionary (bucket, s, t): one row for each bucket that has a feature."""
    sums = dictionary.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    all_s, all_t = dictionary.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()  # two numbers
    ratio = ((F.col("t") + 1) * ((all_s or 0.0) + buckets)) / ((F.col("s") + 1) * ((all_t or 0.0) + buckets))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def feature_dictionary(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(feature, s, gain) for every distinct feature of docs; target (text) shows what is wanted."""
    counts = feature_counts(docs, run).select("feature", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.unionByName(feature_counts(target, run).select("feature", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    bucket = F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets)).cast("int").alias("bucket")
    dictionary = staged(counts.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("feature", bucket, "s", "t"), "features")
    gains = F.broadcast(bucket_gains(dictionary, buckets))  # a row a bucket
    return dictionary.where("s > 0").join(gains, "bucket").select("feature", "s", "gain")


def weights(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs (doc_id, text): the floored mean gain of its features."""
    bounded_batches(docs.sparkSession)
    dictionary = staged(feature_dictionary(docs, target, run, buckets), "gains")
    total = dictionary.agg(F.sum("s")).first()[0] or 0
    often = (F.col("s") * hot >= total) & (F.char_length("feature") <= HOT_CHARS)
    known = {r["feature"].encode(): r["gain"] for r in dictionary.where(often).collect()}  # at most ``hot`` strings of HOT_CHARS
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = shared.value
        for batch in batches:
            n_words, n_features, gained, ends, rest, counts = [], [], [], [0], [], []
            for text in _texts(batch):
                n, found = features(text, run)
                n_words.append(n)
                n_features.append(sum(found.values()))
                gained.append(sum(gain_of[f] * found[f] for f in found.keys() & gain_of.keys()))
                others = found.keys() - gain_of.keys()
                rest.extend(others)
                counts.extend(found[f] for f in others)
                ends.append(len(rest))
            pairs = pa.StructArray.from_arrays([_strings(rest), pa.array(counts, pa.int64())], ["feature", "n"])
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, gained)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *numbers, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "row", "n_words", "n_features", "gained", "rest"])

    schema = "doc_id long, row long, n_words long, n_features long, gained long, rest array<struct<feature string, n long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    counted = staged(rows.mapInArrow(look_up, schema), "counted")
    # Plain shuffles on both sides, whose large partitions Spark splits.
    rest = counted.select("row", F.explode("rest").alias("f")).select("row", "f.feature", "f.n")
    added = rest.join(dictionary.where(~often).select("feature", "gain").hint("merge"), "feature").groupBy("row").agg(F.sum(F.col("gain") * F.col("n")).alias("added"))
    joined = counted.drop("rest").join(added, "row", "left")
    mean = (F.col("gained") + F.coalesce("added", F.lit(0))).cast("double") / F.col("n_features")
    return joined.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, F.floor(mean)).otherwise(0).cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text); rank is null for what isn't drawn.

    target: text. Null texts have no words, and a document without features weighs 0. Rows that repeat are drawn one by
    one. A null id reads as an empty one in the noise and comes last among ties. An empty target, or empty docs, leave
    every gain as smoothing has it.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weights(docs, target, run, buckets).withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]  # beyond these, rows are equal
    ranged = scored.where(F.col("n_words") >= min_words).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the number of the partition, then the row's place in it
    ranged = staged(ranged.withColumn("at", at), "ranked").withColumn("range", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit(2**33 - 1)))
    before, starts = 0, []
    for r in ranged.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():  # one row a partition
        starts.append((r["range"], before))
        before += r["n"]
    drawn = before * percent // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame(starts, "range long, before long"))
    place = F.col("before") + F.col("place") + 1
    ranked = ranged.join(starts, "range").withColumn("rank", F.when(place <= drawn, place))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    few = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(few.select(*columns))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


# CRC-32 of the bytes of a string, which DuckDB lacks: a table of 256 remainders, then one step a byte.
def _remainders() -> str:
    step = "CAST(x AS BIGINT)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)[1]"
    return f"SELECT list_transform(range(256), lambda x: {step}) AS remainders"


CRC_TABLE_SQL = f"crc_table AS MATERIALIZED ({_remainders()})"


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned CRC-32 of a string expression's UTF-8 bytes, where ``remainders`` of CRC_TABLE_SQL is in scope."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda a, b: xor(a >> 8, remainders[(xor(a, b) & 255) + 1])))"


OP12_SQL = rf"""
WITH {CRC_TABLE_SQL},
texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
targets AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS feature FROM benchmark),
pairs AS MATERIALIZED (SELECT row, feature, count(*) AS n FROM (SELECT row, unnest(w) AS feature FROM texts) GROUP BY ALL),
counted AS (SELECT feature, sum(s) AS s, sum(t) AS t FROM (SELECT feature, n AS s, 0 AS t FROM pairs UNION ALL SELECT feature, 0, 1 FROM targets) GROUP BY feature),
dictionary AS MATERIALIZED (SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket, s, t FROM counted CROSS JOIN crc_table),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM dictionary),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((CAST(sum(t) AS DOUBLE) + 1) * (any_value(all_s) + {BUCKETS})) / ((CAST(sum(s) AS DOUBLE) + 1) * (any_value(all_t) + {BUCKETS})))) AS BIGINT) AS gain
  FROM dictionary CROSS JOIN totals GROUP BY bucket),
means AS (SELECT row, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM pairs JOIN dictionary USING (feature) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN means USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
