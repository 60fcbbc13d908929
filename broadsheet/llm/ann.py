"""Approximate nearest neighbours: an inverted file with product-quantised residuals, reranked exactly.

Equal vectors are one entry, with the few smallest ids that any answer can need. Coarse centroids and codebooks are fitted
on a bounded sample (SAMPLE vectors, by hash of the vector); every vector is indexed: its list is that of the nearest
centroid, its code quantises what the centroid leaves. A query visits the nearest lists, as many as hold TARGET of the true
neighbours of TUNE sample vectors within the sample. Lists are cut into chunks and each chunk meets the queries that visit
it, in blocks: a table of distances between query residual and codewords gives asymmetric distances to all codes, and the
nearest of the chunk (RERANK of them, or a share that is tuned likewise, and all that are as near by code) are measured on
the original vectors in double precision. The answers of all chunks are merged. Neither a whole list nor all queries are
ever gathered in one task.

Lists, codes and asymmetric distances are in single precision, of vectors divided by the power of two nearest the sample's
median norm, components held within LIMIT. A query whose norm is more than FAR such units can't be told apart by them: it
visits all lists and is measured against every vector. Distances whose squares leave double precision are taken by a
scaled norm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

#: Neighbours; most vectors that the index is fitted on; nearest of a chunk, by code, that are measured.
NEIGHBOURS, SAMPLE, RERANK = 10, 20_000, 200
#: Share of true neighbours that the visited lists shall hold, and sample vectors that this is measured on.
TARGET, TUNE = 0.985, 256
#: Most lists; components that one codebook covers; codewords a codebook.
LISTS, PART, WORDS = 4096, 2, 256
#: Sample vectors that the codebooks are fitted on.
BOOK_SAMPLE = 8192
#: Largest scaled component, and largest scaled norm of a query that the lists can place.
LIMIT, FAR = 1e15, 2.0**20
#: Entries of a chunk, queries that meet it in one task, and at once.
CHUNK, BLOCK, QUERIES = 4096, 16_384, 1024
TURNS, SEED = 12, 11


def usable(vec) -> F.Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def kmeans(x: np.ndarray, k: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    """k centroids of the rows of x (all rows, if there are no more), by Lloyd's turns; empty ones move to far rows."""
    draw = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    centroids = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        d = np.concatenate([_squared(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(d, minlength=k)
        sums = np.stack([np.bincount(d, column, k) for column in x.T], 1)
        full = n > 0
        centroids[full] = sums[full] / n[full, None]
        if not full.all():
            centroids[~full] = x[draw.choice(len(x), int((~full).sum()), replace=False)]
    return centroids


class Index:
    """Coarse centroids and one codebook for each PART components. Its size depends on LISTS, WORDS and the dimension."""

    def __init__(self, wide: np.ndarray, lists: int):
        self.dim = wide.shape[1]
        self.power = -int(np.frexp(np.median(norms(wide)))[1])
        sample = self.narrow(wide)
        self.centroids = kmeans(sample, lists)
        left = sample - self.centroids[self.lists(sample, 1)[:, 0]]
        self.cuts = [(i, min(i + PART, self.dim)) for i in range(0, self.dim, PART)]
        self.books = [kmeans(left[:BOOK_SAMPLE, a:b], WORDS) for a, b in self.cuts]

    def narrow(self, wide: np.ndarray) -> np.ndarray:
        """Scaled vectors in single precision."""
        with np.errstate(over="ignore"):
            return np.clip(np.ldexp(wide, self.power), -LIMIT, LIMIT).astype(np.float32)

    def far(self, wide: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return norms(np.clip(np.ldexp(wide, self.power), -LIMIT, LIMIT)) > FAR

    def tune(self, wide: np.ndarray, copies: np.ndarray, neighbours: int, target: float) -> tuple[int, float]:
        """(lists to visit, share of a list to measure) that hold the target share of the sample's own nearest neighbours.

        The first is by the places of the neighbours' lists in order of nearness, the second by the neighbours' places in
        their lists in order of asymmetric distance. Copies count.
        """
        sample, asks = self.narrow(wide), np.flatnonzero(~self.far(wide))[:TUNE]
        if len(sample) < 2 or not len(asks):
            return 1, 1.0
        asked, own = sample[asks], self.lists(sample, 1)[:, 0]
        d = _squared(asked, sample)
        d[np.arange(len(asked)), asks] = np.inf
        n = min(neighbours, len(sample) - 1)
        true = np.argpartition(d, n - 1, axis=1)[:, :n]
        true = np.take_along_axis(true, np.take_along_axis(d, true, 1).argsort(1), 1)
        before = np.cumsum(copies[true], 1) - copies[true]
        weight = np.clip(neighbours - before, 0, copies[true]).ravel()  # a vector with copies takes several places
        order = _squared(asked, self.centroids).argsort(1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        place = np.take_along_axis(place, own[true], 1).ravel()
        held = np.cumsum(np.bincount(place, weight, order.shape[1]))
        members, codes, shares = [np.flatnonzero(own == at) for at in range(len(self.centroids))], self.codes(sample, own), np.zeros(true.shape)
        for i, row in enumerate(true):
            for at in np.unique(own[row]):
                near = self.distances(asked[i : i + 1], at, codes[members[at]])[0]
                mine = own[row] == at
                shares[i, mine] = (near[None, :] <= near[np.searchsorted(members[at], row[mine])][:, None]).mean(1)
        by_share = shares.ravel().argsort()
        enough = np.searchsorted(np.cumsum(weight[by_share]), target * weight.sum())
        return int(np.searchsorted(held, target * held[-1])) + 1, float(shares.ravel()[by_share][min(enough, len(by_share) - 1)])

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = _squared(x, self.centroids)
        n = min(n, d.shape[1])
        return d.argmin(1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        left = x - self.centroids[at]
        return np.stack([_squared(left[:, a:b], book).argmin(1) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def distances(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded vectors of list ``at``, by one table of codeword distances a query and part."""
        left = query - self.centroids[at]
        out = np.zeros((len(query), len(codes)), np.float32)
        for p, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += _squared(left[:, a:b], book)[:, codes[:, p]]
        return out


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of the rows; where squares over- or underflow, of the rows scaled by a power of two."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.sqrt((x**2).sum(1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
        if len(odd):
            power = np.frexp(np.abs(x[odd]).max(1))[1]
            out[odd] = np.ldexp(np.sqrt((np.ldexp(x[odd], -power[:, None]) ** 2).sum(1)), power)
    return out


def measure(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to v; infinite only where the distance itself is beyond double precision."""
    with np.errstate(over="ignore"):
        apart = x - v
        out = norms(apart)
        odd = np.flatnonzero(~np.isfinite(apart).all(1))
        if len(odd):
            out[odd] = 4 * norms(x[odd] / 4 - v / 4)
    return out


def entries(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(key, embedding, ids): one row for each distinct usable vector, with its neighbours + 1 smallest ids."""
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))
    low = rows.withColumn("r", F.row_number().over(W.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("r") <= neighbours + 1)
    packed = low.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # neighbours + 1 at most
    return packed.withColumn("key", F.monotonically_increasing_id())


def fit(rows: DataFrame, total: int, neighbours: int = NEIGHBOURS, sample: int = SAMPLE, lists: int | None = None, target: float = TARGET) -> Index | None:
    """An index, with its number of lists to visit, from at most ``sample`` rows of least hash; lists defaults to the square root of the total, LISTS at most."""
    some = rows.select("embedding", F.size("ids").alias("n"), F.xxhash64("embedding").alias("h")).orderBy("h", "embedding").limit(sample).toPandas()
    if not len(some):
        return None
    some = some[some["embedding"].map(len) == some["embedding"].map(len).mode().iloc[0]]
    x = _matrix(some["embedding"])
    index = Index(x, lists or int(np.clip(round(total**0.5), 1, LISTS)))
    index.probes, index.share = index.tune(x, some["n"].to_numpy(), neighbours, target)
    return index


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS, probes: int | None = None, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the nearest rows of vectors found for each row of queries.

    Both have vec_id and embedding. Vectors that are null, all zero, hold null or non-finite components, or whose length is
    not that of most vectors of the sample take no part. The query's own row is no candidate. Ties go to the smaller id. A
    repeated id is one candidate and one query for each of its different vectors; null ids take no part. An empty table
    gives no rows. Components of any finite size are measured, see above. If the lists visited hold too few vectors, the query visits all lists.
    """
    vectors, queries = (d.where(F.col("vec_id").isNotNull()) for d in (vectors, queries))
    rows = staged(entries(vectors, neighbours), "entries")
    total = rows.count()
    index = fit(rows, total, neighbours, sample)
    asked = queries.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding")).distinct()
    if index is None:
        return asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    probes = probes or index.probes
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    rows = rows.where(F.size("embedding") == index.dim)
    asked = staged(asked.where(F.size("embedding") == index.dim), "asked")
    distinct = asked.groupBy("embedding").agg(F.min("query_id").alias("q"))
    blocks = -(-asked.count() // BLOCK)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = shared.value.narrow(_matrix(f["embedding"]))
                at = shared.value.lists(x, 1)[:, 0]
                yield pd.DataFrame({"list": at.astype(np.int32), "key": f["key"], "ids": f["ids"], "embedding": f["embedding"], "code": [c.tobytes() for c in shared.value.codes(x, at)]})

    indexed = staged(rows.mapInPandas(place, "list int, key long, ids array<bigint>, embedding array<double>, code binary"), "index")
    sizes = {r["list"]: (r["n"], r["m"]) for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()}  # LISTS rows at most
    chunks = {at: -(-n // CHUNK) for at, (n, _) in sizes.items()}
    held = np.zeros(len(index.centroids), np.int64)
    for at, (_, m) in sizes.items():
        held[at] = m
    chunk_of = F.create_map(*[F.lit(v) for pair in chunks.items() for v in pair])

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = _matrix(f["embedding"])
            lists = shared.value.lists(shared.value.narrow(x), probes)
            few = (held[lists].sum(1) <= neighbours) | shared.value.far(x)
            out = [(q, e, at, c) for q, e, found, all_ in zip(f["q"], f["embedding"], lists, few, strict=True) for at in (chunks if all_ else found) for c in range(chunks.get(at, 0))]
            yield pd.DataFrame(out, columns=["q", "embedding", "list", "chunk"])

    visits = distinct.mapInPandas(visit, "q long, embedding array<double>, list int, chunk int").withColumn("block", F.pmod(F.xxhash64("q"), F.lit(max(blocks, 1))).cast("int"))
    indexed = indexed.withColumn("chunk", F.pmod(F.xxhash64("key"), F.element_at(chunk_of, F.col("list"))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        wide, asked = _matrix(right["embedding"]), _matrix(left["embedding"])
        query, far = shared.value.narrow(asked), shared.value.far(asked)
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        ids, every = right["ids"].to_list(), np.arange(len(right))
        out: list = []
        for i in range(0, len(query), QUERIES):
            near = shared.value.distances(query[i : i + QUERIES], int(right["list"].iloc[0]), codes)
            most = max(rerank, int(np.ceil(shared.value.share * near.shape[1])))
            limits = np.partition(near, most - 1, axis=1)[:, most - 1] if near.shape[1] > most else np.full(len(near), np.inf)
            for q, v, mine, limit, whole in zip(left["q"].iloc[i : i + QUERIES], asked[i : i + QUERIES], near, limits, far[i : i + QUERIES], strict=True):
                at = every if whole else np.flatnonzero(mine <= limit)
                d = measure(wide[at], v)
                order = np.argsort(d, kind="stable")
                last = d[order[min(neighbours, len(order) - 1)]]  # each entry has an id, so more are never needed
                found = sorted((d[k], vec_id) for k in order if d[k] <= last for vec_id in ids[at[k]])[: neighbours + 1]
                out += [(q, vec_id, score) for score, vec_id in found]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"])

    pairs = visits.groupBy("list", "chunk", "block").cogroup(indexed.groupBy("list", "chunk", "block")).applyInPandas(meet, "q long, vec_id long, score double")
    best = W.partitionBy("q").orderBy("score", "vec_id")
    found = pairs.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= neighbours + 1).select("q", "vec_id", "score")
    asked = asked.join(distinct, "embedding").select("query_id", "q")
    answers = asked.join(found, "q").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
