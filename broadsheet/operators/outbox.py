"""Events for several sinks: ids without gaps from several writers, and for each sink how far it has got.

Events and the last id given change in one commit, so two writers never give one id twice: who comes second numbers its rows
anew after the other's. A sink gets ranges of ids in turn. A range is noted before it is handed over and counts once the sink
has taken it; after a failure the same range is handed over again, so a sink that files what it gets under its range has
every event once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.log import FILE_ROWS, Conflict, Log, Shape

from .console import in_order

#: Ids that lie together in the table; most events of one range.
BLOCK, MOST = 10_000, 1_000_000

Handler = Callable[[DataFrame, int, int], None]


class Outbox:
    """``columns`` (name -> type) are those of events; id and block come with them."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str], block: int = BLOCK, file_rows: int = FILE_ROWS):
        self.spark, self.columns, self.block = spark, columns, block
        shapes = {
            "events": Shape({"block": "bigint", "id": "bigint"} | columns, ("block", "id"), 1),
            "given": Shape({"batch": "string", "last": "bigint"}, ("batch",)),
            "sinks": Shape({"sink": "string", "done": "bigint", "until": "bigint"}, ("sink",)),
        }
        self.log = Log(spark, path, shapes, file_rows)

    def _given(self, batch: str | None, base: int) -> int | None:
        """The last id of a batch; None: of all."""
        key = "last" if batch is None else f"batch {batch}"
        found = self.log.lookup("given", self.spark.createDataFrame([(key,)], "batch string"), base).collect()
        return found[0]["last"] if found else None

    def append(self, rows: DataFrame, order: list[str], batch: str) -> int:
        """Gives rows ids in ``order`` after all that are given; returns how many are new. A batch that is there adds nothing."""
        if self._given(batch, self.log.number()) is not None:
            return 0
        numbered, n = in_order(rows.select(*[F.col(c).cast(t).alias(c) for c, t in self.columns.items()]), order)
        while True:
            base = self.log.number()
            if self._given(batch, base) is not None:
                return 0
            top = self._given(None, base) or 0
            events = numbered.withColumn("id", F.lit(top).cast("long") + F.col("_n")).withColumn("block", F.expr(f"id div {self.block}"))
            given = self.spark.createDataFrame([("last", top + n), (f"batch {batch}", top + n)], "batch string, last long")
            try:
                self.log.append({"events": (events, None), "given": (given, None)}, base)
                return n
            except Conflict:
                continue

    def events(self, after: int = 0, until: int | None = None) -> DataFrame:
        """Events with after < id <= until, from the files that may hold their blocks."""
        if until is None:
            return self.log.read("events").where(F.col("id") > after).drop("block")
        blocks = self.spark.range((after + 1) // self.block, until // self.block + 1).withColumnRenamed("id", "block")
        return self.log.lookup("events", blocks).where((F.col("id") > after) & (F.col("id") <= until)).drop("block")

    def _sink(self, sink: str, base: int) -> tuple[int, int]:
        found = self.log.lookup("sinks", self.spark.createDataFrame([(sink,)], "sink string"), base).collect()
        return (found[0]["done"], found[0]["until"]) if found else (0, 0)

    def _note(self, sink: str, done: int, until: int, base: int) -> None:
        self.log.append({"sinks": (self.spark.createDataFrame([(sink, done, until)], "sink string, done long, until long"), None)}, base)

    def deliver(self, sink: str, handle: Handler, most: int = MOST) -> int:
        """Hands the next range to handle(events, after, until), at most ``most`` events; returns their number, 0 at the end.

        If handle raises, so does this, and the range is handed over again next time. One delivery of a sink at a time: if
        another has moved the sink meanwhile, this is a Conflict, and the range was handed over twice.
        """
        base = self.log.number()
        done, until = self._sink(sink, base)
        if until == done:
            until = min(self._given(None, base) or 0, done + most)
            if until == done:
                return 0
            while True:
                try:
                    self._note(sink, done, until, base)
                    break
                except Conflict:  # of another sink, or of this one
                    base = self.log.number()
                    if self._sink(sink, base) != (done, done):
                        raise
        handle(self.events(done, until), done, until)
        while True:
            base = self.log.number()
            if self._sink(sink, base) != (done, until):
                raise Conflict(f"{sink} has been moved by another delivery")
            try:
                self._note(sink, until, until, base)
                return until - done
            except Conflict:
                continue

    def deliver_all(self, sinks: dict[str, Handler], most: int = MOST) -> dict[str, str | None]:
        """All that is there to each sink; a sink that fails keeps its place and stops no other. sink -> its error."""
        failed: dict[str, str | None] = {}
        for sink, handle in sinks.items():
            failed[sink] = None
            try:
                while self.deliver(sink, handle, most):
                    pass
            except Exception as e:  # any failure is the sink's own
                failed[sink] = f"{type(e).__name__}: {e}"
        return failed


def filed(path: str) -> Handler:
    """A sink that keeps each range in a folder of its own, so a range that comes again replaces itself."""

    def handle(events: DataFrame, after: int, until: int) -> None:
        events.write.mode("overwrite").parquet(f"{path.rstrip('/')}/range={after}")

    return handle
