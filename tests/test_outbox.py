import pytest

from broadsheet.operators.outbox import Outbox, filed

EVENT = "run_id string, arrival long, message string"
COLUMNS = {"run_id": "string", "arrival": "bigint", "message": "string"}
ORDER = ["run_id", "arrival"]


def rows(spark, low, high):
    return spark.createDataFrame([(f"r{i % 3}", i, f"m{i}") for i in range(low, high)], EVENT)


def test_two_writers_and_repeated_batches_leave_no_gap_and_no_double(spark, tmp_path):
    one, two = (Outbox(spark, f"{tmp_path}/o", COLUMNS, block=10) for _ in range(2))
    append, calls = one.log.append, []

    def late(changes, base):
        calls.append(base)
        if len(calls) == 1:
            assert two.append(rows(spark, 100, 130), ORDER, "b") == 30
        return append(changes, base)

    one.log.append = late
    assert one.append(rows(spark, 0, 50), ORDER, "a") == 50 and len(calls) == 2
    assert two.append(rows(spark, 0, 50), ORDER, "a") == 0
    assert one.append(rows(spark, 0, 0), ORDER, "none") == 0
    found = two.events().orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, 81)) and [r.arrival >= 100 for r in found] == [True] * 30 + [False] * 50
    assert [(r.run_id, r.arrival) for r in found[30:]] == sorted((r.run_id, r.arrival) for r in found[30:])
    assert sorted(r.id for r in one.events(9, 20).collect()) == list(range(10, 21))


def test_a_failing_sink_keeps_its_place(spark, tmp_path):
    box = Outbox(spark, f"{tmp_path}/o", COLUMNS, block=10)
    assert box.deliver_all({"good": filed(f"{tmp_path}/good")}) == {"good": None}
    box.append(rows(spark, 0, 25), ORDER, "a")
    keep, ranges = filed(f"{tmp_path}/bad"), []

    def bad(events, after, until):
        ranges.append((after, until))
        keep(events, after, until)
        if ranges.count((10, 20)) == 1 and after == 10:
            raise OSError("lost after writing")

    sinks = {"bad": bad, "good": filed(f"{tmp_path}/good")}
    told = box.deliver_all(sinks, most=10)
    assert told["good"] is None and "lost after writing" in told["bad"]
    box.append(rows(spark, 25, 40), ORDER, "b")
    assert box.deliver_all(sinks, most=10) == {"bad": None, "good": None}
    assert ranges == [(0, 10), (10, 20), (10, 20), (20, 30), (30, 40)]
    for name in ("bad", "good"):
        assert pytest.rows(spark.read.parquet(f"{tmp_path}/{name}"), "id") == [(i,) for i in range(1, 41)]
