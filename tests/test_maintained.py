import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import rollups
from broadsheet.operators.maintained import ROW, RunSummaries

METRICS = ["found", "kept"]
STAT = "run_id string, publisher_id string, source_id string, id long, found long, kept long, completed boolean, stop_reason string, at long"


def keeper(spark, path, **options):
    return RunSummaries(spark, str(path), METRICS, {"at": "bigint"}, **options)


def row(rng, key):
    return (*key, rng.choice([None, -3, 0, 5]), rng.randrange(9), rng.choice([None, True, True, False]), rng.choice([None, "limit", "error"]), rng.randrange(5))


def fresh(spark, rows):
    """Summaries made anew of all rows."""
    df = spark.createDataFrame(rows, STAT)
    made = rollups.run_summary(df, "run_id", {m: F.col(m) for m in METRICS}, "publisher_id", "source_id", F.col("completed"), "stop_reason", [F.col("at"), F.col("id")])
    return pytest.rows(made)


def test_changes_equal_summaries_made_anew(spark, tmp_path):
    """Rows come, change, move and go at random; nulls and empty texts are ids like others."""
    rng = random.Random(3)
    kept, now = keeper(spark, tmp_path / "t", file_rows=10), {}
    for size in (60, 25, 25):
        new = {}
        for _ in range(size):
            key = (rng.choice(["r1", "r2", "", None]), rng.choice(["p", None]), rng.choice(["s1", "s2", None]), rng.randrange(6))
            new[key] = row(rng, key)
        gone = rng.sample(sorted(now, key=str), min(len(now), 12))
        kept.change(spark.createDataFrame(list(new.values()), STAT), spark.createDataFrame(gone, "run_id string, publisher_id string, source_id string, id long"))
        for key in gone:
            del now[key]
        now |= new
        assert pytest.rows(kept.read()) == fresh(spark, list(now.values()))
    kept.change(gone=spark.createDataFrame(list(now), "run_id string, publisher_id string, source_id string, id long"))
    assert kept.read().count() == 0 and kept.log.read("parts").count() == 0


def test_nothing_and_repeated_keys(spark, tmp_path):
    kept = keeper(spark, tmp_path / "t")
    assert kept.change().count() == 0 and kept.read().count() == 0
    same = [("r", "p", "s", 1, 2, 0, True, None, 0), ("r", "p", "s", 1, 7, 0, True, None, 0)]
    kept.change(spark.createDataFrame(same, STAT), spark.createDataFrame([("x", "p", "s", 9)], "run_id string, publisher_id string, source_id string, id long"))
    assert pytest.rows(kept.read()) == fresh(spark, same[1:])


def test_a_change_reads_and_writes_what_it_touches(spark, tmp_path):
    rng = random.Random(5)
    keys = [(f"r{i % 40}", f"p{i % 3}", f"s{i % 600}", i) for i in range(6000)]
    rows = {k: row(rng, k) for k in keys}
    kept = keeper(spark, tmp_path / "t", file_rows=200)
    kept.change(spark.createDataFrame(list(rows.values()), STAT))
    before = kept.log.manifest()
    opened, files_for = [], kept.log.files_for

    def watched(table, asked, runs):
        found = files_for(table, asked, runs)
        opened.append((table, sum(map(len, found)), sum(len(r["files"]) for r in runs)))
        return found

    kept.log.files_for = watched
    rows[keys[7]] = row(rng, keys[7])
    touched = kept.change(spark.createDataFrame([rows[keys[7]]], STAT))
    assert [r.run_id for r in touched.collect()] == ["r7"]
    after = kept.log.manifest()
    assert all(after[t][0] == before[t][0] and [r["rows"] for r in after[t][1:]] == [1] for t in ("rows", "parts", "summaries"))
    assert opened[0][0] == "rows" and opened[0][1] <= 2 and opened[0][2] >= 20
    assert pytest.rows(kept.read()) == fresh(spark, list(rows.values()))


def test_a_change_is_made_again_upon_that_of_another(spark, tmp_path):
    rng = random.Random(8)
    a, b = (row(rng, ("r", "p", "s", i)) for i in (1, 2))
    one, two = keeper(spark, tmp_path / "t"), keeper(spark, tmp_path / "t")
    append, calls = one.log.append, []

    def late(changes, base):
        calls.append(base)
        if len(calls) == 1:
            two.change(spark.createDataFrame([b], STAT))
        return append(changes, base)

    one.log.append = late
    one.change(spark.createDataFrame([a], STAT))
    assert len(calls) == 2 and calls[1] > calls[0]
    assert pytest.rows(one.read()) == pytest.rows(two.read()) == fresh(spark, [a, b])
    assert one.log.read("rows").select(*ROW).count() == 2
