"""Tables and folders that every executor can see.

Lineage is cut only through these helpers: a written Parquet table in the folder named by
``spark.checkpoint.dir``, so a lost executor costs the re-run of its tasks and nothing more. Tables written inside
``with scratch(spark) as keep`` are deleted at its end, those given to keep() excepted; ``clean`` deletes all that the session has left.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where the setting is unset a temporary folder takes its place in local mode, where there
    is one machine; on a cluster that would be a folder which executors can't share, so it is an error."""
    found = spark.conf.get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark)}/lattica/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Delete what is written inside, but for tables passed to the given function. Nothing lazy may refer to the others afterwards."""
    before, kept = len(_written), set()
    yield lambda df: kept.add(getattr(df, "written_to", None))
    for path in _written[before:]:
        if path not in kept:
            delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete every table this process has written to the shared folder and not deleted yet."""
    for path in list(_written):
        delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, sizes are known to the planner."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on, so that a Python worker's memory follows a few megabytes of text; their bytes
    are bounded by Spark's own setting. Spark reads it when a query runs, so it stays lowered in this session; a lower one is left alone."""
    if int(spark.conf.get(_ROWS, "10000")) > rows:
        spark.conf.set(_ROWS, str(rows))
