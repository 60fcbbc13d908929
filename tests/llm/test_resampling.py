import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from broadsheet.llm import resampling


def brute(docs, target, run=1, buckets=resampling.BUCKETS, min_words=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), Counter(" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1))

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for side, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f, n in features(text)[1].items():
                side[bucket(f)] += n
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = features(text)
        n = sum(found.values())
        weight = sum(gain(bucket(f)) * k for f, k in found.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= min_words])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for at, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = at
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def found(spark, docs, target, **said):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(str(tuple(r)) for r in resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), **said).collect())


DOCS = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 60))) for i in range(300)]
EDGES = [(None, None), (None, "Ünïcode ÀB İstanbul ﬁ " * 9), (7, ""), (7, "a,b-c_d\x7f\x00e " * 40), (8, "x" * 200 + " "), (9, DOCS[200][1]), (9, DOCS[200][1]), (10, "long " * 60_000), (11, "日本語 " * 30)]


def test_agrees_with_brute_force(spark):
    target = ["w1 w2 w3", "w5 ÀB ünïcode", None, ""]
    assert found(spark, DOCS + EDGES, target) == brute(DOCS + EDGES, target)


@pytest.mark.parametrize("hot", [1, 20_000])
def test_runs_of_words_with_and_without_frequent_features(spark, hot, monkeypatch):
    monkeypatch.setattr(resampling, "HOT", hot)
    monkeypatch.setattr(resampling.weights, "__defaults__", (*resampling.weights.__defaults__[:-1], hot))
    target = ["w1 w2", "long long"]
    assert found(spark, DOCS + EDGES, target, run=2, buckets=50, min_words=3, percent=33) == brute(DOCS + EDGES, target, 2, 50, 3, 33)


def test_empty_tables(spark):
    assert found(spark, [], ["a"]) == []
    assert found(spark, DOCS, []) == brute(DOCS, [])


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, row long, feature string")
    assert resampling.resample(docs, docs.select("text")).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_sql(spark, tmp_path):
    spark.createDataFrame(DOCS + EDGES, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("w1 W2 é",), (None,)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        expected = c.sql(resampling.OP12_SQL).fetchall()
    assert sorted(str(tuple(r)) for r in resampling.op12_resample(spark, str(tmp_path)).collect()) == sorted(map(str, expected))
