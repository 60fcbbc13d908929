"""Streams: the tail of run events, discoveries folded as they come, new candidates, and runs that fall silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Events as files of them arrive; each is seen once across restarts, by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by key and window of time; what is later than the watermark is left out, and state is dropped then."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``handle`` on all that is there now and ends: the unit of work of an outer scheduler."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candidate_sink(known_path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A handler that appends candidates whose key isn't known yet. A repeated batch adds nothing twice."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(known_path).where(F.col("_batch") != batch_id).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(known_path)

    return handle


LIVENESS_OUT = "run_id string, state string, last_at timestamp, beats long"
LIVENESS_STATE = "last_at timestamp, beats long"


def liveness(beats: DataFrame, late: str = "10 minutes", silent_ms: int = 300_000) -> DataFrame:
    """running for each batch with heartbeats (run_id, at) of a run, stale once its time is ``silent_ms`` behind the watermark."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "state": ["stale"], "last_at": [last], "beats": [n]})
            return
        last, n = state.get if state.exists else (None, 0)
        for f in frames:
            n += len(f)
            top = f["at"].max()
            last = top if last is None or top > last else last
        state.update((last, n))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + silent_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run_id": [key[0]], "state": ["running"], "last_at": [last], "beats": [n]})

    return beats.withWatermark("at", late).groupBy("run_id").applyInPandasWithState(follow, LIVENESS_OUT, LIVENESS_STATE, "append", GroupStateTimeout.EventTimeTimeout)
