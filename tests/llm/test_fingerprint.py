import hashlib
import re

from pyspark.sql import functions as F

from broadsheet.llm import fingerprint


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(spark):
    docs = {i: " ".join(f"w{(i * 7 + j * (1 + i % 3)) % 500}" for j in range(20 + 13 * (i % 40))) for i in range(150)}
    found = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    for at, i in enumerate(order):
        text, after, r = docs[i], docs[order[(at + 1) % len(order)]], found[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(shingles(text), shingles(edited))) < 0.17
        assert abs(r.near_next - likeness(shingles(text), shingles(after))) < 0.17


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 1), (1, None, 1), (3, "x y z " * 9, 1), (3, "", 1)], "doc_id long, text string, _range int")
    found = fingerprint.fingerprints(docs).collect()
    assert len(found) == 5
    assert {r.fingerprint for r in found if r.n_chars == 0} == {""}
    one = fingerprint.fingerprints(docs.where("doc_id is null")).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    texts = spark.createDataFrame([(g, p, " ".join(f"t{g}x{p}x{i}" for i in range(400))) for g in (0, 1) for p in range(3)], "g int, p int, text string")
    sketched = texts.withColumn("sk", fingerprint.sketch(F.col("text")))
    both = fingerprint.merge_sketches(sketched, ["g"], "sk").withColumn("n", fingerprint.distinct_shingles(F.col("sk")))
    for r in both.collect():
        assert len(r.sk) == fingerprint.K and abs(r.n / (3 * 396) - 1) < 0.3
    a, b = (sketched.where(f"g = 0 and p = {p}").select(F.col("sk").alias(f"s{p}")) for p in (0, 1))
    folded = a.join(b).select(fingerprint.merged(F.col("s0"), F.col("s1")).alias("m"), fingerprint.containment(F.col("s0"), fingerprint.merged(F.col("s0"), F.col("s1"))).alias("c")).first()
    assert folded.m == sorted(folded.m) and folded.c > 0.75
    assert fingerprint.merge_sketches(sketched.limit(0), ["g"], "sk").count() == 0


def test_many_rows_of_one_id_or_none(spark):
    """A hot id and null ids are parted by hash; the chain of next texts still runs through all rows once."""
    rows = [(7, f"hot {i} " * 3) for i in range(300)] + [(None, f"none {i} " * 3) for i in range(200)] + [(i, f"plain {i} " * 3) for i in range(20)] + [(7, "hot 1 " * 3)] * 30
    found = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).where("not _lent").collect()
    assert len(found) == len(rows) and len({r._range for r in found if r.doc_id == 7}) > 3 and len({r._range for r in found if r.doc_id is None}) > 3
    assert sorted(r._next for r in found) == sorted(t for _, t in rows)
    order = sorted(found, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r._hash))
    assert [r.text for r in order[1:]] + [order[0].text] == [r._next for r in order]


def test_long_text(spark):
    text = " ".join(f"w{i % 997}" for i in range(300_000))
    r = fingerprint.fingerprints(spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")).where("doc_id = 1").first()
    assert r.n_chars == len(text) and len(r.fingerprint) == 16 * fingerprint.K and abs(r.shingles / 997 - 1) < 0.3
