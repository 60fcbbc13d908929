"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed character n-grams says how much a text looks
like the languages with a one there. Its weights are log odds between the mean n-gram distributions of both sides, counted
over all labelled texts. Decoding sums, over the bits, the logistic loss of the bit's margin against each codeword, weighed
by how well the bit parts its languages, and takes the nearest codeword. Ambiguous are texts with two codewords about as near.

The model has a fixed size: FEATURES counts a language, FEATURES weights a bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

BITS = 14
FEATURES = 1 << BITS
ORDERS = (1, 2, 3)
#: Sharpness of the decoding's losses, and least gap in score between the nearest two codewords.
SHARPNESS, AMBIGUOUS = 3.0, 0.2
_MULTIPLY = np.uint32(2654435761)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray | None:
    """Features of all n-grams of a text, None if it has no letter. What is no letter counts as one and the same mark."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters()[codes]
    if not known.any():
        return None
    codes = np.where(known, codes, 0).astype(np.uint32)
    out, h = [], np.zeros(len(codes) + 1, np.uint32)
    for n in ORDERS:
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        out.append(((h * _MULTIPLY) >> np.uint32(32 - BITS)).astype(np.intp))
    return np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all ways to part few languages, or the best spread of random ones for many."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = [c for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in columns], float).T
    length, draw, best = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(7), (-1, None)
    for _ in range(50):
        code = draw.choice([-1.0, 1.0], (n, length))
        code[:, np.abs(code.sum(0)) == n] = np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        apart = (length - code @ code.T) / 2 + np.eye(n) * length
        if apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


class Decoder:
    """What scoring needs: languages, codewords, weights by feature and bit, and each bit's scale and weight."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.languages = sorted(counts)
        self.code = codewords(len(counts))
        if len(counts) < 2:
            return
        p = np.array([(counts[x] + smooth) / (counts[x].sum() + smooth * FEATURES) for x in self.languages])
        weights = []
        for bit in self.code.T:
            weights.append(np.log(p[bit > 0].mean(0)) - np.log(p[bit < 0].mean(0)))
        self.weights = np.array(weights).T.astype(np.float32)
        usual = p @ self.weights  # mean margin of each language
        good = np.maximum((usual * self.code).min(0), 1e-3)
        self.scale, self.bit_weight = good, good / good.sum()

    def decode(self, features: np.ndarray) -> tuple[str, float, bool]:
        if not self.languages:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        if len(features) < FEATURES // 2:
            margin = self.weights[features].sum(0, dtype=np.float64)
        else:
            margin = np.bincount(features, minlength=FEATURES).astype(np.float32) @ self.weights
        z = SHARPNESS * self.code * (margin / len(features) / self.scale)
        loss = (np.logaddexp(0, -z) * self.bit_weight).sum(1) * len(self.bit_weight)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = np.argsort(-share, kind="stable")[:2]
        return self.languages[best[0]], float(share[best[0]]), bool(share[best[0]] - share[best[1]] < AMBIGUOUS)


def ngram_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Counts by language over all rows (text, lang). FEATURES counts a language come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                found = ngrams(text) if text else None
                counts = held.setdefault(lang, np.zeros(FEATURES, np.int64))
                if found is not None:
                    counts += np.bincount(found, minlength=FEATURES)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": counts[at]})

    rows = labelled.select("text", "lang").mapInPandas(run, "lang string, feature int, n long")
    rows = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    return {lang: np.bincount(g["feature"], g["n"], FEATURES) for lang, g in rows.groupby("lang")}


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of docs (doc_id, text).

    Null texts and texts without a letter are ``und`` with score 0, and ambiguous. With one language learned, it is the
    answer for all others; with none, all are ``und``.
    """
    model = docs.sparkSession.sparkContext.broadcast(decoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model.value.decode
        for batch in batches:
            said = []
            for text in batch.column("text").to_pylist():
                features = ngrams(text) if text else None
                said.append(("und", 0.0, True) if features is None else decode(features))
            columns = list(zip(*said, strict=True)) or [(), (), ()]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents outside the held-out third, then answers for every document."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    decoder = Decoder(ngram_counts(docs.where(F.col("lang").isNotNull() & ~held_out())))
    return identify(docs, decoder)
