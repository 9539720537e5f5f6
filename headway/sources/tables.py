"""Parquet tables of a data directory, and data written once for several uses."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of a directory; with `columns`, only those."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of a narrow table that are broadcast at most: some 50 MB.
SMALL = 1 << 20


def small(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """`df`, to be broadcast if it has few rows, or `source` has, of which it has no more rows.

    They are counted now, as far as the limit. So large tables joined to small ones don't
    move, which adaptive execution sees only after it has shuffled them.
    """
    return F.broadcast(df) if (df if source is None else source).limit(SMALL + 1).count() <= SMALL else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where the session names none (local tests) one of this machine is set.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="headway-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed now and kept in the shared folder, partitioned as it is.

    What follows reads it from there, however often, and survives the loss of executors.
    For narrow rows; wide ones are better `written`.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df`, computed now and written to a table in the shared folder, of which each use reads the columns it needs.

    The table is deleted when the session's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _releasing_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _releasing_shuffles(spark: SparkSession):
    """Shuffle files of what is run herein go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone before
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
