import pytest
from pyspark.sql import functions as F

from broadsheet.sources.log import Conflict, Log, Shape
from broadsheet.sources.store import Store

SHAPES = {"t": Shape({"k": "string", "n": "bigint", "v": "string"}, ("k", "n"), 1), "u": Shape({"id": "bigint"}, ("id",))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, v string")


def test_merge_on_read_equals_a_dictionary(spark, tmp_path):
    """Writes, deletions, compaction and look-ups against a plain dictionary."""
    import random

    rng, log, plain = random.Random(3), Log(spark, str(tmp_path / "l"), SHAPES, file_rows=40), {}
    keys = [None, "", *(f"k{i}" for i in range(30))]
    for turn in range(9):
        new = {(rng.choice(keys), rng.choice([None, 0, 1, 2])): f"v{turn}" for _ in range(60 if turn % 4 == 0 else 4)}
        gone = {k for k in rng.sample(sorted(plain, key=str), min(len(plain), 3))} - set(new)
        rows = frame(spark, [(*k, v) for k, v in new.items()])
        log.append({"t": (rows, spark.createDataFrame(list(gone), "k string, n long") if gone else None)})
        plain = {k: v for k, v in (plain | new).items() if k not in gone}
        if turn in (3, 8):
            assert {(r.k, r.n): r.v for r in log.read("t").collect()} == plain
    runs = log.manifest()["t"]
    assert len(runs) <= 4 and all(a["bytes"] > sum(r["bytes"] for r in runs[i + 1 :]) for i, a in enumerate(runs[:-1]))
    some = spark.createDataFrame([(None,), ("",), ("k3",), ("absent",)], "k string")
    assert {(r.k, r.n): r.v for r in log.lookup("t", some).collect()} == {k: v for k, v in plain.items() if k[0] in (None, "", "k3")}
    log.compact(["t"], whole=True)
    assert len(log.manifest()["t"]) == 1 and log.manifest()["t"][0]["gone"] == 0
    log.vacuum()
    assert {(r.k, r.n): r.v for r in log.read("t").collect()} == plain


def test_written_and_opened_grow_with_the_change(spark, tmp_path):
    log = Log(spark, str(tmp_path / "l"), SHAPES, file_rows=500)
    many = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("n"), F.lit("x").alias("v"))
    first = log.append({"t": (many, None)})["t"][0]
    assert len(first["files"]) >= 30
    after = log.append({"t": (frame(spark, [("k7", 0, "y")]), None)})["t"]
    assert after[0] == first and after[1]["rows"] == 1 and after[1]["bytes"] < first["bytes"] / 20
    asked = spark.createDataFrame([("k7",), ("none",)], "k string")
    assert sum(map(len, log.files_for("t", asked, after))) <= 3
    found = log.lookup("t", asked)
    assert [r.v for r in found.collect()] == ["y"] and len(found.inputFiles()) <= 3
    assert log.read("t").count() == 20_000


def test_one_value_that_very_many_rows_share(spark, tmp_path):
    log = Log(spark, str(tmp_path / "l"), SHAPES, file_rows=100)
    log.append({"t": (spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("n"), F.lit("x").alias("v")), None)})
    assert len(log.manifest()["t"][0]["files"]) > 5 and log.lookup("t", spark.createDataFrame([("hot",)], "k string")).count() == 2000


def test_several_writers_and_tables(spark, tmp_path):
    a, b = (Log(spark, str(tmp_path / "l"), SHAPES) for _ in range(2))
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id long")
    a.append({"t": (frame(spark, [("x", 1, "old")]), None), "u": (ids(1, 2), None)})
    base = a.number()
    b.append({"t": (frame(spark, [("x", 1, "new")]), None)})
    a.append({"u": (ids(3), None)})  # additions to another table, or to the same one, are no conflict
    with pytest.raises(Conflict):
        a.append({"t": (frame(spark, [("x", 1, "late")]), None)}, base)
    assert [r.v for r in a.read("t").collect()] == ["new"] and b.read("u").count() == 3 and a.read("u", base).count() == 2
    assert b.append({"u": (ids(), None)}) == b.manifest() and b.replace({"u": ids()})["u"] == [] and b.read("u").count() == 0


def test_null_and_empty_keys_differ_in_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    make = lambda *r: spark.createDataFrame(list(r), "run_id string, publisher_id string, status string")
    store.upsert("publisher_results", make(("r", None, "a"), ("r", "", "b")))
    store.upsert("publisher_results", make(("r", None, "c")))
    assert {(r.publisher_id, r.status) for r in store.read("publisher_results").collect()} == {(None, "c"), ("", "b")}
    store.delete("publisher_results", spark.createDataFrame([("r", "")], "run_id string, publisher_id string"))
    assert [r.status for r in store.read("publisher_results").collect()] == ["c"]
