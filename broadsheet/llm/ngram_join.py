"""N-gram Jaccard join: MinHash bands propose pairs, a Bayesian test prunes them, shingle sets decide.

1. Texts with the same words are copies and go on as one text that stands for all. Each text gets HASHES MinHash values.
2. Texts that share a band of values form a bucket. Within a bucket all pairs are compared value by value, CHUNK at a time;
   a pair is dropped once the posterior probability of reaching the threshold, given the matches so far and an even prior,
   falls below TOLERANCE. A task passes on no pairs, but which texts have a partner left in which bucket: a pair counts in
   the first bucket that it shares, so most texts stay in one or two.
3. Only those texts are read again. In each bucket the pairs among them are tested so again and what is left is decided on
   the sets of shingles. Out come links counted for each text, and at most one edge a text that keeps its class together.

Buckets of more than BLOCK texts, or of more than BLOCK_SHINGLES shingles, are split into blocks, and pairs of blocks are
separate tasks, so a large group spreads over the cluster; its pairs are compared in memory, never written. Only pairs that
share a bucket are ever compared, so a long chain of copies costs what its links cost. With BANDS of ROWS values, a pair at
the threshold is proposed with a probability of 1 - 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.components import components

from .common import bounded_batches, fresh, let, may_hold, shingle_hashes, staged, table, words

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
CHUNK, TOLERANCE = 16, 1e-6
#: Texts and shingles of one block, as far as its texts can be parted.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Large buckets up to this many are broadcast (some 100 bytes each), more are joined by shuffle.
BROADCAST_BUCKETS = 200_000
#: Pairs compared at once.
PAIRS = 1 << 18
_DRAW = np.random.default_rng(20240229)
_MULTIPLY = _DRAW.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64)


def least_matches(threshold: float, tolerance: float = TOLERANCE, chunk: int = CHUNK, hashes: int = HASHES) -> np.ndarray:
    """After each chunk, the fewest matches with which the posterior P(likeness >= threshold) is at least the tolerance."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(chunk, hashes + 1, chunk):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return np.array(out)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of the sets values[offsets[i] : offsets[i + 1]], none of them empty: HASHES columns of uint32."""
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    x = values.view(np.uint64)
    h = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _MULTIPLY[k], out=h)
        np.add(h, _ADD[k], out=h)
        out[:, k] = np.minimum.reduceat(h, offsets[:-1]) >> np.uint64(32)  # the least value has the least upper half
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, arrays of shingle hashes, by their signature; null if there are none."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        out: list = [None] * batch.num_rows
        at = 0
        while at < len(full):  # some 64 thousand hashes at a time stay in the processor's cache
            end = max(at + 1, int(np.searchsorted(offsets[full + 1], offsets[full[at]] + 65536, "right")))
            some = full[at:end]
            bounds = np.append(offsets[some], offsets[some[-1] + 1])
            for i, row in zip(some, signatures(values[bounds[0] : bounds[-1]], bounds - bounds[0]), strict=True):
                out[i] = row.tobytes()
            at = end
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "sig"])


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames made of whole groups; rows come sorted by ``by``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = np.ones(len(frame), bool)
        for c in by:
            last &= (frame[c] == frame[c].iloc[-1]).to_numpy()
        cut = len(frame) - int(last.sum())
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True) if held else frame.iloc[:cut]
            held = []
        elif held and any(held[-1][c].iloc[-1] != frame[c].iloc[0] for c in by):
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _pairs(starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs in each group, some PAIRS at a time: within a block, or across two."""
    left, right, held, memo = [], [], 0, {}
    for g in np.flatnonzero(sizes > 1):
        n, at = int(sizes[g]), int(starts[g])
        if i[g] == j[g]:
            if n not in memo:
                memo[n] = np.triu_indices(n, 1)
            a, b = memo[n]
            a, b = a + at, b + at
        else:
            first = mine[at : at + n] == i[g]
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(first) + at, np.flatnonzero(~first) + at, indexing="ij"))
        left.append(a)
        right.append(b)
        held += len(a)
        if held >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Positions in a, b of the pairs that the Bayesian test keeps after all chunks."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        at = slice(k * CHUNK, (k + 1) * CHUNK)
        matches = matches + (sig[a[alive], at] == sig[b[alive], at]).sum(1)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of n positions is connected to."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _bounds(frame: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(len(frame), bool)
    new[0] = True
    for c in by:
        v = frame[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(frame)))


def _signature_matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(-1, HASHES)


def _surviving(frame: pd.DataFrame, sig: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of each group that pass the Bayesian test and share no earlier band, some PAIRS at a time."""
    starts, sizes = _bounds(frame, BY)
    band = frame["band"].to_numpy()
    for a, b in _pairs(starts, sizes, frame["i"].to_numpy()[starts], frame["j"].to_numpy()[starts], frame["mine"].to_numpy()):
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            likely = _likely(sig, x, y, least)
            x, y = x[likely], y[likely]
            first = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x]
            if first.any():
                yield x[first], y[first]


#: Bucket and pair of blocks.
BY = ["key", "i", "j"]


def _propose(threshold: float):
    least = least_matches(threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, BY):
            partnered = np.zeros(len(frame), bool)
            for a, b in _surviving(frame, _signature_matrix(frame), least):
                partnered[a] = partnered[b] = True
            if partnered.any():
                yield frame.loc[partnered, ["key", "band", "node", "n"]]

    return run


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a] and sets[b]."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(values), 8192):  # a slice of the shingles at a time bounds the matrix
        here = (at >= low) & (at < low + 8192)
        has = np.zeros((len(sets), 8192), np.float32)
        has[owner[here], at[here] - low] = 1
        both += has @ has.T
    return both[a, b].astype(np.int64)


def _verify(threshold: float):
    least = least_matches(threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, BY):
            starts, sizes = _bounds(frame, BY)
            node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
            sets = [np.unique(s) for s in frame["shingles"]]
            size = np.array([len(s) for s in sets])
            links, kept = np.zeros(len(node), np.int64), [[], []]
            for a, b in _surviving(frame, _signature_matrix(frame), least):
                group = np.searchsorted(starts, a, "right")
                common = np.zeros(len(a), np.int64)
                cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    at = starts[group[low] - 1]
                    mine = sets[at : at + sizes[group[low] - 1]]
                    common[low:high] = _common(mine, a[low:high] - at, b[low:high] - at)
                alike = common >= threshold * (size[a] + size[b] - common) - 1e-9
                a, b = a[alike], b[alike]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                kept[0].append(a)
                kept[1].append(b)
            if links.any():
                root = _roots(len(node), np.concatenate(kept[0]), np.concatenate(kept[1]))
                linked = links > 0
                yield pd.DataFrame({"node": node[linked], "links": links[linked], "root": node[root[linked]]})

    return run


def _blocked(rows: DataFrame) -> DataFrame:
    """Adds mine, i and j to rows (key, node, n): a row goes to each pair of blocks that its own block is part of."""
    large = rows.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    large = large.where((F.col("texts") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("key", F.greatest(F.ceil(F.col("texts") / BLOCK), F.least("texts", F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int").alias("blocks"))
    # Written out, so that the join's sides are plain shuffles, whose hot keys Spark splits, or a broadcast of known size.
    large = staged(large, "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    return (
        rows.join(large, "key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .drop("other", "blocks")
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), class_id, n_links and first, one row for each row of docs (doc_id, text).

    class_id is the least doc_id of the class, whose documents hang together by links; n_links counts the other rows whose
    shingle sets have a Jaccard likeness of at least the threshold. first marks one row of each class, of least doc_id. A
    text under ``width`` words is one shingle. Texts without words, null or empty ones among them, link with nothing, and
    each is its own class. Repeated rows are copies of each other; null ids come last and leave class_id null only in a
    class of null ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.crc32(text).alias("text_crc"), words(text).alias("w"))
    shingles = shingle_hashes(F.col("w"), width)
    read = read.select("doc_id", "text_hash", "text_crc", let(F.array_join("w", " "), lambda t: F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"))).alias("fp"), F.greatest(F.size("w") - (width - 1), F.lit(1)).cast("long").alias("n"), shingles.alias("shingles"))
    signed = read.mapInArrow(_sign, "doc_id long, text_hash long, text_crc long, fp struct<a:bigint,b:bigint>, n long, sig binary")
    signed = staged(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")

    full = signed.where("sig is not null")
    texts = staged(
        full.groupBy("fp").agg(F.count("*").alias("copies"), F.min("row").alias("node"), F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("least_id")).join(full.select(F.col("row").alias("node"), "n", "sig", "text_hash", "text_crc"), "node"),
        "texts",
    )
    ints = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key")))
    bands = texts.select("node", "n", F.inline(ints))
    shared = staged(bands.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "buckets")
    buckets = _blocked(staged(bands.join(shared.hint("merge"), "key"), "members")).join(texts.select("node", "sig"), "node")
    buckets = buckets.repartition(*BY).sortWithinPartitions(*BY).select(*BY, "mine", "band", "node", "n", "sig")
    near = staged(buckets.mapInPandas(_propose(threshold), "key long, band int, node long, n long").distinct(), "near")

    wanted = staged(near.select("node").distinct().join(texts.select("node", "copies", "sig", "text_hash", "text_crc"), "node"), "wanted")
    said = docs.select(F.xxhash64(text).alias("text_hash"), F.crc32(text).alias("text_crc"), text.alias("text"))
    said, _ = may_hold(said, F.col("text_hash"), wanted, "text_hash")
    said = said.groupBy("text_hash", "text_crc").agg(F.first("text").alias("text"))
    wanted = staged(wanted.join(said, ["text_hash", "text_crc"]).select("node", "copies", "sig", shingle_hashes(words(F.col("text")), width).alias("shingles")), "shingles")
    near = _blocked(near).join(wanted, "node")
    near = near.repartition(*BY).sortWithinPartitions(*BY).select(*BY, "mine", "band", "node", "copies", "sig", "shingles")
    found = staged(near.mapInPandas(_verify(threshold), "node long, links long, root long"), "verified")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v"))
    links = links.join(components(edges, "links"), "node", "left")
    placed = texts.select("fp", "node", "copies", "least_id").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = staged(placed, "placed")
    heads = staged(placed.groupBy("root").agg(F.min("least_id").alias("class_id")), "heads").hint("merge")
    placed = placed.join(heads, "root").select("fp", "class_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = staged(placed, "classes")
    last = F.lit(2**63 - 1)
    key = F.struct(F.coalesce("doc_id", last).alias("id"), F.col("row").alias("row"))
    whole = signed.select("row", "doc_id", "text_hash", "fp", F.col("sig").isNull().alias("bare")).join(placed, "fp", "left")
    first = whole.where("not bare").groupBy("root").agg(F.min(key).alias("head")).select(F.col("head.row").alias("row"), F.lit(True).alias("first"))
    whole = whole.join(first, "row", "left")
    return whole.select(
        "doc_id",
        "text_hash",
        F.when(F.col("bare"), F.col("doc_id")).when(F.col("class_id") < last, F.col("class_id")).alias("class_id"),
        F.when(F.col("bare"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (F.col("bare") | F.coalesce("first", F.lit(False))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all but the first document of each class. Rows that are equal in id and text stay once.

    Only rows whose text may be one that goes, or that repeats, are shuffled; the others pass.
    """
    found = staged(near_duplicates(docs.select("doc_id", "text"), threshold), "found")
    name = fresh(docs, "text_hash")
    d = docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    touched = staged(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n > 1 or not first").select("text_hash").distinct(), "touched")
    keep, _ = may_hold(found.where("first"), F.col("text_hash"), touched, "text_hash")
    keep = keep.select("doc_id", "text_hash").distinct().alias("k")
    unsure, sure = may_hold(d, F.col(name), touched, "text_hash")
    unsure = unsure.dropDuplicates(["doc_id", name]).alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{name}") == F.col("k.text_hash"))
    return sure.drop(name).unionByName(unsure.join(keep, same, "left_semi").select(*[F.col(f"d.`{c}`") for c in docs.columns]))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", F.col("first").alias("representative"))


#: All pairs by shared shingles, then reachability: the definition, fit for small tables.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
both_ways AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach(x, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN both_ways USING (x)),
classes AS (SELECT x AS doc_id, min(root) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS doc_id, count(*) AS n FROM both_ways GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, doc_id = class_id AS representative FROM classes LEFT JOIN counts USING (doc_id)
"""
