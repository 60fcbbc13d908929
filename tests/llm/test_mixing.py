import duckdb
import pandas as pd

from broadsheet.llm import mixing


def mixed(docs):
    found = mixing.mixed_sizes(docs).toPandas()
    return found, found.groupby("source", dropna=False).agg(taken=("taken", "sum"), size=("source_size", "first"), target=("target", "first"))


def test_targets_and_caps(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), ["a", "b", "c"][0 if i % 10 < 1 else 1 if i % 10 < 3 else 2]) for i in range(2000)], "doc_id long, text string, source string")
    found, by = mixed(docs)
    assert (found.taken <= 3 * found["size"]).all()
    total = found["size"].sum()
    assert found.taken.sum() <= total and total - found.taken.sum() < 20
    assert by.target["a"] == 3 * by["size"]["a"]  # five eighths of all are more than three times what it has
    for r in by.itertuples():
        assert abs(r.taken - r.target) < 20
    again, _ = mixed(docs.repartition(7))
    assert sorted(zip(found.doc_id, found.taken)) == sorted(zip(again.doc_id, again.taken))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", None, 1), (1, "a b", None, 1), (None, None, "x", 1), (2, "", "x", 1), (3, "q " * 50, "y", 1)], "doc_id long, text string, source string, cum int")
    found, _ = mixed(docs)
    assert len(found) == 5
    assert found[found.source.isna()].taken.tolist() == [6, 6]  # the smaller source is capped
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    assert copies.where("source is null").count() == 6


def test_agrees_with_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i % 300 if i % 50 else None, "w " * (i % 9), ["a", "b", None, "d"][i % 7 % 4]) for i in range(900)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = c.sql(mixing.OP7_SQL).df()
    key = lambda f: sorted(str([None if pd.isna(x) else x if isinstance(x, str) else float(x) for x in r]) for r in f[["doc_id", "source", "size", "source_size", "target", "taken"]].astype(object).values.tolist())
    assert key(mixing.op7_mix_sources(spark, str(tmp_path)).toPandas()) == key(expected)


def test_ties_are_taken_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"{i} " * 100, "a") for i in range(300)] + [(7, "x " * 100, "b")] * 200 + [(i, "y " * 10, "c") for i in range(1500)], "doc_id long, text string, source string")
    found, by = mixed(docs.repartition(5))
    assert len(found) == 2000 and found[found.source == "b"].taken.nunique() == 2
    assert all(abs(r.taken - r.target) <= 100 for r in by.itertuples())


def test_the_mix_leaves_in_order_of_the_queue(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 4 == 0]) for i in range(800)] + [(5, "w w w w w w", "a")], "doc_id long, text string, source string")
    taken = mixing.mixed_sizes(docs, times=True).toPandas()
    expected = sorted((f, r["rank"], r.cum) for _, r in taken.iterrows() for f in r.queue)
    own = {(r.doc_id, r.source): r["rank"] for _, r in taken.iterrows()}
    left = mixing.mix_documents(docs.repartition(3)).collect()  # partitions in turn
    assert len(left) == len(expected) == sum(t // s for t, s in zip(taken.taken, taken["size"]))
    assert [own[r.doc_id, r.source] for r in left] == [k for _, k, _ in expected]
    first = {}
    for at, r in enumerate(left):
        first.setdefault((r.doc_id, r.source), at)
    times = {(r.doc_id, r.source): min(r.queue) for _, r in taken.iterrows() if len(r.queue)}
    assert sorted(times, key=lambda k: (times[k], own[k])) == sorted(times, key=lambda k: first[k]) or len(set(times.values())) < len(times)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 500_000, "a"), (2, "v " * 5, "b"), (3, None, None)], "doc_id long, text string, source string")
    found, _ = mixed(docs)
    assert found.set_index("doc_id")["size"].to_dict() == {1: 500_000, 2: 5, 3: 0}


def test_the_cut_is_found_in_levels(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(4000)], "doc_id long, text string, source string")
    timed = mixing.mixed_sizes(docs, times=True)
    timed = mixing.staged(timed.withColumn("rank", timed["rank"].cast("long")), "timed").drop("queue")
    once = mixing._cut(timed, 3)
    assert once is not None and mixing._cut(timed, 3, few=5) == once
