"""Session helpers: table access and tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file where a table's size is known, and files from which on a table is not small.
ROWS_A_FILE, SMALL = 1 << 20, 64
#: Seconds between two collections of the driver's garbage, after which Spark deletes shuffle files that nothing reads.
PAUSE = 5.0
_collected = [0.0]
_own_dir: dict[str, str] = {}
_kept: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as tasks can run at once, for a pass that costs more than dealing out the rows:
    a table of few files, or of one row group, would keep few of them busy."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and all tasks run in this process.

    On a cluster without that setting this is an error: what one machine writes to its own disk others do not see.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and with master {master} only a folder that all machines share will do")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own_dir[app]


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    Writing cuts the lineage: a lost executor costs a reread, never a recomputation of what came before. ``keep``
    also lets the shuffle files behind the table go, which bounds the disk of a job of many steps. What is left is
    deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def keep(self, df: DataFrame, most: int | None = None) -> DataFrame:
        """df, written and read again. most: rows that it has at most, where that is known; few are written to few files."""
        path = f"{shared_dir(self.spark)}/tessella-{uuid.uuid4().hex}"
        few = -(-most // ROWS_A_FILE) if most is not None else SMALL
        (df.coalesce(max(1, few)) if few < SMALL else df).write.option("compression", "zstd").parquet(path)
        _kept[path] = self.spark
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessella_path = path
        del df
        if time.monotonic() - _collected[0] > PAUSE:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            _collected[0] = time.monotonic()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing later reads."""
        for df in tables:
            _delete(getattr(df, "_tessella_path", ""))


def _delete(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release() -> None:
    """Delete every table this driver still keeps."""
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # the session may be gone; the folder's owner clears it then
            _kept.pop(path, None)
