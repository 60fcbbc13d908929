from datetime import datetime, timedelta

from broadsheet.streaming import events

SCHEMA = "event_id long, run_id string, at timestamp"
T0 = datetime(2025, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_tail_sees_each_event_once(spark, tmp_path):
    path, known, checkpoint = f"{tmp_path}/in", f"{tmp_path}/known", f"{tmp_path}/cp"
    for part in ([(1, "a", T0), (2, "a", T0)], [(2, "a", T0), (3, "b", T0)]):
        write(spark, path, part)
        events.each_batch(events.tail(spark, path, SCHEMA), events.candidate_sink(known, "event_id"), checkpoint).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(known).collect()) == [1, 2, 3]


def test_windows_and_liveness(spark, tmp_path):
    path = f"{tmp_path}/in"
    write(spark, path, [(i, "a", T0 + timedelta(minutes=i)) for i in range(3)])
    write(spark, path, [(9, "b", T0 + timedelta(hours=5))])
    write(spark, path, [(10, "b", T0 + timedelta(hours=9))])
    stream = events.tail(spark, path, SCHEMA, 1)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = run(events.windowed_counts(stream, "at", ["run_id"]), "counts", "append")
    assert ("a", 3) in {(r.run_id, r.n) for r in counts}
    states = run(events.liveness(stream), "live", "append")
    assert {("a", "running"), ("a", "stale"), ("b", "running")} <= {(r.run_id, r.state) for r in states}
