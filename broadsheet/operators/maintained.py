"""Roll-ups that are kept: summaries of runs that follow changes of the rows beneath them.

Three tables of one log, each made from the one before: the rows, a part for each source of a run, a summary for each run.
Sums could be kept by adding and subtracting, but a first stop reason or "all done" can't lose a row that way, so a change
refolds the sources that it touches from their rows, and their runs from the parts of all their sources. Other sources' rows
and other runs' parts aren't read, and all three tables change in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.log import FILE_ROWS, Conflict, Log, Shape
from broadsheet.sources.scratch import staged

from . import joins, rollups

RUN, SOURCE, ROW = ["run_id"], ["run_id", "publisher_id", "source_id"], ["run_id", "publisher_id", "source_id", "id"]


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys others lacks."""
    return joins.null_safe_join(rows, others.select(*keys), keys, "left_anti")


class RunSummaries:
    """Rows are (run_id, publisher_id, source_id, id), counts by metric, completed, stop_reason, and what orders stop reasons.

    The four ids are a row's key; nulls are values like others. ``order`` gives the columns (name -> type) by which the first
    stop reason is found, then comes the id. The summary is that of ``rollups.run_summary`` over the rows that count now.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: list[str], order: dict[str, str], id_type: str = "bigint", file_rows: int = FILE_ROWS):
        self.metrics, self.order = metrics, order
        ids = dict.fromkeys(SOURCE, "string")
        counts = dict.fromkeys(metrics, "bigint")
        stop = ", ".join(f"{c}: {t}" for c, t in (order | {"id": id_type, "reason": "string"}).items())
        of_run = dict.fromkeys(["publishers", "sources", "publishers_completed", "sources_completed"], "bigint")
        shapes = {
            "rows": Shape(ids | {"id": id_type} | counts | {"completed": "boolean", "stop_reason": "string"} | order, tuple(ROW), 3),
            "parts": Shape(ids | counts | {"done": "boolean", "stop": f"struct<{stop}>"}, tuple(SOURCE), 1),
            "summaries": Shape({"run_id": "string"} | counts | of_run | {"stop_reason": "string"}, ("run_id",)),
        }
        self.log = Log(spark, path, shapes, file_rows)

    def _typed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        types = self.log.shapes["rows"].columns
        return rows.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])

    def _parts(self, rows: DataFrame) -> DataFrame:
        order = [F.col(c) for c in (*self.order, "id")]
        return rollups.source_parts(rows, "run_id", {m: F.col(m) for m in self.metrics}, "publisher_id", "source_id", F.col("completed"), "stop_reason", order)

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
        """Puts rows in place of those of their keys, removes the keys of ``gone``; gives the new summaries of the runs touched.

        A key in both stays, with its row. Of rows with one key the greatest counts, column by column. A row that moves to
        another run or source is a row there and a key gone here. A run without rows has no summary. If another writer has
        changed the tables meanwhile, the change is made again upon theirs.
        """
        columns = list(self.log.shapes["rows"].columns)
        rest = [c for c in columns if c not in ROW]
        empty = self.log.spark.createDataFrame([], self.log.shapes["rows"].ddl)
        new = self._typed(rows, columns) if rows is not None else empty
        new = staged(new.groupBy(*ROW).agg(F.max(F.struct(*rest)).alias("_r")).select(*ROW, "_r.*"), "rows")
        old = staged(_without(self._typed(gone, ROW).distinct() if gone is not None else empty.select(*ROW), new, ROW), "gone")
        changed = new.select(*ROW).unionByName(old)
        touched = staged(changed.select(*SOURCE).distinct(), "touched")
        runs = touched.select(*RUN).distinct()
        while True:
            base = self.log.number()
            now = _without(self.log.lookup("rows", touched, base), changed, ROW).unionByName(new)
            parts = staged(self._parts(now), "parts")
            others = _without(self.log.lookup("parts", runs, base), touched, SOURCE)
            summaries = staged(rollups.fold_parts(others.unionByName(parts), "run_id", "publisher_id", self.metrics), "summaries")
            changes = {"rows": (new, old), "parts": (parts, _without(touched, parts, SOURCE)), "summaries": (summaries, _without(runs, summaries, RUN))}
            try:
                self.log.append(changes, base)
                return summaries
            except Conflict:
                continue

    def read(self) -> DataFrame:
        return self.log.read("summaries")
