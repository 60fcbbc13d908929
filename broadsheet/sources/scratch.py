"""Scratch tables: intermediate results written to a folder that driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (tests, a laptop) is a local folder made and recorded in the
    session. On a cluster a local folder would scatter tables over executors' own disks, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.broadsheet.scratch", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="broadsheet-")
        spark.conf.set("spark.broadsheet.scratch", base)
    return base


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/broadsheet-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int:
    """Partitions for rows that take long in Python: as many as the session's shuffles have, and three for each core at least.

    A few MB of such rows are work for all cores, but Spark reads and joins partitions by their size.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def mark() -> int:
    """A point in time for release()."""
    return len(_STAGED)


def release(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> int:
    """Removes the tables that this process has staged since a mark(), but for ``keep``. Call it once what is made from them is written."""
    files, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    spared = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    mine = _STAGED[since:]
    _STAGED[since:] = [name for name in mine if name.rpartition("/")[2] in spared]
    gone = [files.Path(name) for name in mine if name.rpartition("/")[2] not in spared]
    return sum(bool(path.getFileSystem(conf).delete(path, True)) for path in gone)
