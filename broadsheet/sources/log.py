"""Log-structured tables: sorted runs of changes in a folder, merged when they are read, compacted by size.

A write adds a run: the new rows and marks of deleted keys, sorted by a hash of the key into files of bounded size, and
nothing else, so the bytes written grow with the change. A manifest lists the runs of all tables, with the range of hashes
of each file, and commits a change of several tables at once. Reading merges runs, the newest row of a key counts; a look-up
opens only files whose range holds a hash that is asked for. Runs at the new end are merged as soon as the older ones among
them are no larger than those after: sizes then grow geometrically, and a table has as many runs as the logarithm of its size.
"""

from __future__ import annotations

import bisect
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import staged

#: Rows of a file; most hashes that a look-up brings to the driver, to choose files by. Beyond, it opens all files.
FILE_ROWS, MOST_HASHES = 1_000_000, 100_000


class Conflict(RuntimeError):
    """Another writer has changed the same table since it was read."""


@dataclass(frozen=True)
class Shape:
    """A table: column -> type; its key; and how many leading columns of the key place a row, so that they can be looked up."""

    columns: dict[str, str]
    keys: tuple[str, ...]
    placed: int = 0

    @property
    def by(self) -> tuple[str, ...]:
        return self.keys[: self.placed or len(self.keys)]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())


def _hash(columns):
    """Null and empty keys differ."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])


class Log:
    """A folder of tables. Readers see all of a commit or nothing of it; a writer that dies leaves files that nobody reads.

    No manifest is ever replaced: a writer who finds its number taken reads what the other did and goes on. Two writers may
    add to one table at once, and of one key the later commit counts; replacing a table, or ``base`` with an addition, is a
    Conflict if another has changed it since. What doesn't count any more stays until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, shapes: dict[str, Shape], file_rows: int = FILE_ROWS):
        self.spark, self.path, self.shapes, self.file_rows = spark, path.rstrip("/"), shapes, file_rows
        self._known: dict[int, str] = {}
        self._hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def number(self) -> int:
        return max((int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, number: int | None = None) -> dict[str, list[dict]]:
        """table -> its runs, oldest first: version, rows, gone, bytes, files (name, least and greatest hash)."""
        number = self.number() if number is None else number
        if number and number not in self._known:  # manifests never change
            stream = self._fs.open(self._at(f"manifests/{number:012d}.json"))
            self._known[number] = str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return json.loads(self._known[number]) if number else {}

    def _name(self, base: int, changed, replaced: set[str]) -> dict[str, list[dict]]:
        """Makes changed(runs of now) the next manifest; Conflict if a table of ``replaced`` differs from manifest ``base``."""
        was = self.manifest(base)
        while True:
            number = self.number()
            now = self.manifest(number)
            if number != base and (odd := sorted(t for t in replaced if now.get(t, []) != was.get(t, []))):
                raise Conflict(f"tables {odd} have changed since manifest {base}")
            new = changed(now)
            draft = self._at(f"manifests/{uuid.uuid4().hex}.draft")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
            out.close()
            try:
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
                self._files.rename(draft, self._at(f"manifests/{number + 1:012d}.json"), none)  # never over another
                return new
            except Py4JJavaError as e:
                self._fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e.java_exception.getClass()):
                    raise

    def _write(self, table: str, rows: DataFrame, n: int) -> dict | None:
        """A run of n rows (columns, _gone)."""
        if not n:
            return None
        shape, version = self.shapes[table], uuid.uuid4().hex
        folder = f"{self.path}/{table}/{version}"
        placed = rows.withColumn("_h", _hash(shape.by)).withColumn("_k", _hash(shape.keys))
        # Rows of a value that very many share are parted by the whole key.
        files = -(-n // self.file_rows)
        dealt = placed.repartitionByRange(files, "_h", "_k") if files > 1 else placed.coalesce(1)
        dealt.sortWithinPartitions("_h", "_k").drop("_k").write.parquet(folder)
        told = self.spark.read.parquet(folder).select("_h", "_gone", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
        told = told.groupBy("file", "size").agg(F.min("_h").alias("low"), F.max("_h").alias("high"), F.count("*").alias("n"), F.count_if("_gone").alias("gone")).collect()  # a row a file
        files = sorted([[r["file"], r["low"], r["high"]] for r in told], key=lambda f: f[1:])
        return {"version": version, "rows": sum(r["n"] for r in told), "gone": sum(r["gone"] for r in told), "bytes": sum(r["size"] for r in told), "files": files}

    def _shaped(self, table: str, rows: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        """One row of each key: rows as they are, and marks for the keys of gone that have none."""
        shape, parts = self.shapes[table], []
        if rows is not None:
            parts.append(rows.select(*[F.col(c).cast(t).alias(c) for c, t in shape.columns.items()], F.lit(False).alias("_gone")))
        if gone is not None:
            parts.append(gone.select(*[(F.col(c) if c in shape.keys else F.lit(None)).cast(t).alias(c) for c, t in shape.columns.items()], F.lit(True).alias("_gone")))
        both = reduce(DataFrame.unionByName, parts)
        first = both.groupBy(*shape.keys).agg(F.min_by(F.struct(*[c for c in both.columns if c not in shape.keys]), "_gone").alias("_r"))
        return first.select(*shape.keys, "_r.*").select(*both.columns)

    def append(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], base: int | None = None) -> dict[str, list[dict]]:
        """table -> (rows that replace those of their key, keys that are gone), at once. base: Conflict if one changed since."""

        def written(table: str) -> dict | None:
            shaped = staged(self._shaped(table, *changes[table]), "change")
            return self._write(table, shaped, shaped.count())

        with ThreadPoolExecutor(len(changes)) as pool:  # tables are written side by side
            runs = {t: run for t, run in zip(changes, pool.map(written, changes), strict=True) if run}
        if not runs:
            return self.manifest()
        named = self._name(self.number() if base is None else base, lambda now: now | {t: [*now.get(t, []), run] for t, run in runs.items()}, set(changes) if base is not None else set())
        return self.compact(list(runs)) or named

    def replace(self, tables: dict[str, DataFrame], base: int | None = None) -> dict[str, list[dict]]:
        """Writes some tables anew and makes them count at once. Conflict if one has changed since manifest ``base``."""
        base, runs = self.number() if base is None else base, {}
        for table, rows in tables.items():
            shaped = staged(self._shaped(table, rows, None), "change")
            run = self._write(table, shaped, shaped.count())
            runs[table] = [run] if run else []
        return self._name(base, lambda now: now | runs, set(tables))

    def _open(self, table: str, runs: list[dict], names: list[set[str]] | None = None) -> DataFrame:
        """The rows of runs as they stand (columns, _gone, _h, _seq), from the files named for each run."""
        shape, parts = self.shapes[table], []
        for seq, run in enumerate(runs):
            paths = [f"{self.path}/{table}/{run['version']}/{f[0]}" for f in run["files"] if names is None or f[0] in names[seq]]
            if paths:
                parts.append(self.spark.read.schema(f"{shape.ddl}, _gone boolean, _h bigint").parquet(*paths).withColumn("_seq", F.lit(seq)))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{shape.ddl}, _gone boolean, _h bigint, _seq int")

    def _merged(self, table: str, opened: DataFrame, single: bool) -> DataFrame:
        """The newest row of each key (columns, _gone)."""
        shape = self.shapes[table]
        if single:
            return opened.select(*shape.columns, "_gone")
        rest = [c for c in (*shape.columns, "_gone") if c not in shape.keys]
        newest = opened.groupBy(*shape.keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(*shape.keys, "_r.*")
        return newest.select(*shape.columns, "_gone")

    def read(self, table: str, number: int | None = None) -> DataFrame:
        runs = self.manifest(number).get(table, [])
        merged = self._merged(table, self._open(table, runs), len(runs) < 2)
        return merged.where("not _gone").drop("_gone")

    def files_for(self, table: str, keys: DataFrame, runs: list[dict]) -> list[set[str]]:
        """For each run, the files that may hold rows of the keys."""
        hashes = [r["h"] for r in keys.select(_hash(self.shapes[table].by).alias("h")).distinct().limit(MOST_HASHES + 1).collect()]
        if len(hashes) > MOST_HASHES:
            return [{f[0] for f in run["files"]} for run in runs]
        hashes.sort()
        between = lambda low, high: (at := bisect.bisect_left(hashes, low)) < len(hashes) and hashes[at] <= high
        return [{name for name, low, high in run["files"] if between(low, high)} for run in runs]

    def lookup(self, table: str, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of a table whose placing columns are among keys."""
        runs, by = self.manifest(number).get(table, []), self.shapes[table].by
        if not runs:
            return self.spark.createDataFrame([], self.shapes[table].ddl)
        wanted = keys.select(*[F.col(c).cast(self.shapes[table].columns[c]).alias(c) for c in by]).distinct()
        opened = self._open(table, runs, self.files_for(table, wanted, runs)).alias("o")
        asked = wanted.withColumn("_h", _hash(by)).alias("w")
        same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by], F.col("o._h") == F.col("w._h"))
        merged = self._merged(table, opened.join(asked, same, "left_semi"), len(runs) < 2)
        return merged.where("not _gone").drop("_gone")

    def compact(self, tables: list[str] | None = None, whole: bool = False) -> dict[str, list[dict]] | None:
        """Merges the newest runs of tables where the older ones among them are no larger than those after; or all runs."""
        done = None
        for table in tables or list(self.shapes):
            base = self.number()
            runs = self.manifest(base).get(table, [])
            at = 0 if whole else next((i for i in range(len(runs) - 1) if runs[i]["bytes"] <= sum(r["bytes"] for r in runs[i + 1 :])), len(runs))
            old = runs[at:]
            if len(old) < 2 and not (whole and old and old[0]["gone"]):
                continue
            merged = self._merged(table, self._open(table, old), len(old) < 2)
            if at == 0:  # nothing older is left that a mark could hide
                merged = merged.where("not _gone")
            merged = staged(merged, "compact")
            run = self._write(table, merged, merged.count())

            def changed(now, table=table, old=old, run=run):
                mine = now.get(table, [])
                start = next((i for i in range(len(mine) - len(old) + 1) if mine[i : i + len(old)] == old), None)
                if start is None:
                    raise Conflict(f"{table} has been compacted by another")
                return now | {table: [*mine[:start], *([run] if run else []), *mine[start + len(old) :]]}

            try:
                done = self._name(base, changed, set())
            except Conflict:
                continue  # another has done it
        return done

    def vacuum(self) -> int:
        """Removes versions and manifests that don't count any more; for a time when nobody writes or reads."""
        number, gone = self.number(), 0
        kept = {t: {run["version"] for run in runs} for t, runs in self.manifest(number).items()}
        for name in self._names("manifests"):
            if name != f"{number:012d}.json":
                self._fs.delete(self._at(f"manifests/{name}"), False)
        for table in self.shapes:
            for version in self._names(table):
                if version not in kept.get(table, ()):
                    gone += bool(self._fs.delete(self._at(f"{table}/{version}"), True))
        return gone
