"""Toxicity by class-conditional Kneser-Ney models of characters.

Two models share their lower orders. The highest order, five characters within a word, is counted for toxic and ordinary
labelled documents apart; both back off to one Kneser-Ney model of four, three, two and one characters, whose continuation
counts come from both classes. So a rare expression weighs only by what its class has really shown, and all else is the same in both.
A document's words are compared by length-normalised log-likelihood ratio; a logistic curve over the ratio of the whole
text and those of its most toxic words gives the score. It is fitted on labelled documents that the models have not seen.

Counting covers all labelled documents. The models reach the executors as tables of all n-grams and contexts counted, 12
bytes each besides the slots: they grow with the labelled text, and none is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged, table
from .language import letters

#: Least slots of the executors' tables of n-grams and contexts, as powers of two; larger tables have two slots or more a key.
SLOT_BITS, CONTEXT_BITS = 21, 19
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: Most labelled documents, by hash of the id, that the logistic curve is fitted on.
FIT_ROWS = 20_000
#: Labels up to this many rows are broadcast (about 16 bytes a row), more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: Distinct n-grams that a task gathers before it passes them on.
FLUSH = 1_000_000
#: Characters scored at once, or one text.
SLICE = 1 << 18
#: Characters counted at once, up to the next white space.
JOINED = 1 << 20
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0x9E3779B97F4A7C15)
FEATURES = 4


def keys(text: str) -> np.ndarray:
    """Each character with the four before it in its word, 12 bits each. Non-letters are 0, alike; larger code points fold.

    A mark that ends the last word is added, so that texts give the same n-grams alone as one after the other.
    """
    codes = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(codes < 2048, codes, 2048 + codes % 2047)
    c = np.where(letters()[codes], c, 0).astype(np.int64)
    out, before = c.copy(), c
    for back in range(1, 5):
        at_edge = before == 0 if back > 1 else False
        before = np.concatenate([np.zeros(min(back, len(c)), np.int64), c[:-back]])
        before = np.where(at_edge, 0, before)
        out |= before << (12 * back)
    return out


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.astype(np.uint64) * _MIX >> np.uint64(64 - bits)).astype(np.intp)


def _joined(texts) -> Iterator[str]:
    """Texts one after the other, some JOINED characters at a time. A longer text is cut at white space, which changes no n-gram."""
    held, size = [], 0
    for text in texts:
        at = 0
        while at < len(text):
            space = _SPACE.search(text, at + JOINED) if len(text) - at > JOINED else None
            end = space.start() if space else len(text)
            held.append(text[at:end])
            size += end - at
            at = end + 1
            if size >= JOINED:
                yield "\n".join(held)
                held, size = [], 0
    yield "\n".join(held)


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """key, toxic, plain: counts over all rows of labelled (text, toxic)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = [[], []]
        size = 0

        def passed() -> pd.DataFrame:
            parts = [pd.DataFrame({"key": k, "toxic": n * c, "plain": n * (1 - c)}) for c in (0, 1) for k, n in held[c]]
            return pd.concat(parts) if parts else pd.DataFrame({"key": [], "toxic": [], "plain": []}, dtype="int64")

        for frame in frames:
            for c in (0, 1):
                texts = frame["text"][frame["toxic"] == c].dropna()
                if not len(texts):
                    continue
                for some in _joined(texts):
                    k, n = np.unique(keys(some), return_counts=True)
                    held[c].append((k, n))
                    size += len(k)
                    if len(held[c]) >= 16 or size > FLUSH:
                        k, n = np.concatenate([x for x, _ in held[c]]), np.concatenate([x for _, x in held[c]])
                        k, at = np.unique(k, return_inverse=True)
                        held[c] = [(k, np.bincount(at, n).astype(np.int64))]
                        size = sum(len(x) for part in held for x, _ in part)
            if size > FLUSH:
                yield passed()
                held, size = [[], []], 0
        yield passed()

    counted = labelled.select("text", "toxic").mapInPandas(run, "key long, toxic long, plain long")
    return counted.where("key <> 0").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _last(order: int) -> int:
    """Mask of an n-gram's last characters."""
    return (1 << 12 * order) - 1


def log_ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) of all n-grams seen, and (context, ratio) for unseen characters after a context that was seen."""
    d = DISCOUNT
    grams = counts.select("*", F.shiftright("key", 12).alias("context"), F.expr(f"key & {_last(4)}").alias("four"))
    contexts = grams.groupBy("context").agg(
        F.sum("toxic").alias("all_toxic"), F.sum("plain").alias("all_plain"), F.count_if(F.col("toxic") > 0).alias("kinds_toxic"), F.count_if(F.col("plain") > 0).alias("kinds_plain")
    )
    kinds, above = {}, counts.select("key")
    for order in (4, 3, 2, 1):  # how many different characters precede each n-gram
        above = kinds[order] = above.groupBy(F.expr(f"key & {_last(order)}").alias("key")).agg(F.count("*").alias("n"))
    total = kinds[1].agg(F.sum("n")).first()[0] or 1
    lower = kinds[1].select(F.col("key").alias("lower"), (F.col("n") / F.lit(float(total))).alias("p"))  # at most 4096 rows
    for order in (2, 3, 4):
        here = kinds[order].select("key", "n", F.shiftright("key", 12).alias("before"), F.expr(f"key & {_last(order - 1)}").alias("lower"))
        of = here.groupBy("before").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        p = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("p")
        lower = here.join(of, "before").join(lower, "lower").select(F.col("key").alias("lower"), p.alias("p"))
    shared = lower.select(F.col("lower").alias("four"), F.col("p").alias("shared"))

    def backoff(c: str):
        return F.when(F.col(f"all_{c}") > 0, d * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    def p(c: str):
        return F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0) + backoff(c) * F.col("shared")

    seen = grams.join(contexts, "context").join(shared, "four").select("key", F.ln(p("toxic") / p("plain")).cast("float").alias("ratio"))
    unseen = contexts.select("context", F.ln(backoff("toxic") / backoff("plain")).cast("float").alias("ratio"))
    return seen, unseen


class Table:
    """A value for each of many distinct keys. Keys that share a slot stand side by side, so none gives way."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bits: int):
        self.bits = max(bits, (2 * len(key)).bit_length())
        slot = _slots(key, self.bits)
        order = np.argsort(slot, kind="stable")
        self.starts = np.zeros((1 << self.bits) + 1, np.int32 if len(key) < 2**31 else np.int64)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.starts[1:])
        self.keys, self.values = np.append(key[order], -1), np.append(value[order], np.nan).astype(np.float32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The values of keys, which are not negative; NaN for those that the table lacks."""
        slot = _slots(key, self.bits)
        at = self.starts[slot]
        hit = self.keys[at] == key
        out = np.where(hit, self.values[at], np.float32(np.nan))
        left = np.flatnonzero(~hit)
        at, end = at[left] + 1, self.starts[slot[left] + 1]
        while (more := at < end).any():
            left, at, end = left[more], at[more], end[more]
            hit = self.keys[at] == key[left]
            out[left[hit]] = self.values[at[hit]]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


class Ratios:
    """Log-likelihood ratios of all n-grams seen, and of unseen characters after all contexts seen."""

    def __init__(self, seen: Table, unseen: Table):
        self.seen, self.unseen = seen, unseen
        self.fit = np.zeros(FEATURES + 1)

    def ratios(self, key: np.ndarray) -> np.ndarray:
        found = self.seen.find(key)
        miss = np.flatnonzero(np.isnan(found))
        found[miss] = np.nan_to_num(self.unseen.find(key[miss] >> 12))
        found[key == 0] = 0
        return found.astype(np.float64)

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: mean ratio a character, of the whole text; of its most toxic word, three and ten most toxic words."""
        out, at = np.zeros((len(texts), FEATURES)), 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < SLICE:
                size += len(texts[end])
                end += 1
            out[at:end] = self._features(texts[at:end])
            at = end
        return out

    def _features(self, texts: list[str]) -> np.ndarray:
        lows = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lows])
        key = keys("\n".join(lows))
        inside = (key & 4095) != 0
        out = np.zeros((len(texts), FEATURES))
        starts = np.flatnonzero(inside & (key < 4096))
        if not len(starts):
            return out
        ratio = self.ratios(key)
        heads = np.append(0, ends[:-1])
        out[:, 0] = np.add.reduceat(ratio, heads) / np.maximum(np.add.reduceat(inside, heads, dtype=np.int64), 1)
        means = np.add.reduceat(ratio, starts) / np.maximum(np.add.reduceat(inside, starts, dtype=np.int64), 4)
        owner = np.searchsorted(ends, starts, "right")
        order = np.lexsort((-means, owner))
        means, owner = means[order], owner[order]
        words = np.bincount(owner, minlength=len(texts))
        rank = np.arange(len(owner)) - (np.cumsum(words) - words)[owner]
        for column, most in ((1, 1), (2, 3), (3, 10)):
            top = rank < most
            out[:, column] = np.bincount(owner[top], means[top], len(texts)) / np.clip(words, 1, most)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.fit[:-1] + self.fit[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and offset of a ridge logistic regression, both classes weighing alike, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return np.array([*np.zeros(x.shape[1]), -10.0 if not len(y) or y[0] == 0 else 10.0])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    w, penalty = np.zeros(a.shape[1]), ridge * len(y) * np.append(np.ones(a.shape[1] - 1), 1e-6) / 10
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _hashed(rows: DataFrame, key: str, bits: int) -> Table:
    """All of rows (key, ratio) as a table; they come to the driver in Arrow's form."""
    found = rows.select(F.col(key).alias("k"), "ratio").toArrow()
    return Table(found["k"].to_numpy(), found["ratio"].to_numpy(), bits)


def remainder(of: int = 5) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ratios:
    """Models from docs (doc_id, text) and labels (doc_id, toxic), leaving out ids whose crc32 is divisible by five.

    Labels that are null are left out; of repeated labels the larger holds; each row of a repeated doc_id counts. Remainders 1 to 3 are counted, remainder 4
    fits the logistic curve, on at most ``fit_rows`` documents of each class.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder() > 0)
    known = staged(known, "labels")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    counts = staged(ngram_counts(rows.where(remainder() < 4)), "ngrams")
    seen, unseen = log_ratios(counts)
    model = Ratios(_hashed(seen, "key", SLOT_BITS), _hashed(unseen, "context", CONTEXT_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = shared.value.features([t or "" for t in frame["text"]])
            yield pd.DataFrame({"toxic": frame["toxic"], **{f"x{i}": x[:, i] for i in range(FEATURES)}})

    # Ids order the sample; the rows are those of least hash, so about fit_rows of each class by a threshold on the hash.
    sizes = known.where(remainder() == 4).groupBy("toxic").count().collect()
    share = {r["toxic"]: min(1.0, fit_rows / r["count"]) for r in sizes}
    u = (F.xxhash64("doc_id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    sample = rows.where((remainder() == 4) & (u < F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))))
    fitted = sample.select("text", "toxic").mapInPandas(features, "toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).toPandas()
    model.fit = _logistic(fitted[[f"x{i}" for i in range(FEATURES)]].to_numpy(), fitted["toxic"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: Ratios) -> DataFrame:
    """docs, which has a column text, with ``score`` (0 to 1). Null text is empty; an empty text is scored as well.

    A text's score depends on nothing but the text, so repeated rows and ties score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores([t or "" for t in batch.column(at).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Ratios, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold. A column of docs named score stays as it is."""
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}" if c != "text" else "text") for i, c in enumerate(names)])
    kept = score_toxicity(plain, model).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{i}" if c != "text" else "text").alias(c) for i, c in enumerate(names)])


def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
