"""Tables between the rounds of an iterative job, in the folder that driver and executors share.

Each table cuts the lineage: a lost executor's work is redone from the last table. The list of tables belongs to one call
of ``settled`` in one context (thread or task), so jobs that run side by side do not delete each other's tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task is to make of the few it reads.
PER_TASK = 250_000
_open: ContextVar[list[str] | None] = ContextVar("tables of the running call", default=None)
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where all runs on one machine, as in tests, a folder of its own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    tables = _open.get()
    if tables is not None:
        tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, stored; the tables stored on the way are deleted, also when it fails."""
    tables: list[str] = []
    token = _open.set(tables)
    try:
        made = make()
        _open.reset(token)
        token = None
        return stored(made)
    finally:
        if token is not None:
            _open.reset(token)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tasks(df: DataFrame, rows: Column) -> int:
    """How many tasks it takes for each to make about ``PER_TASK`` rows, ``rows`` being what a row of ``df`` is exploded into."""
    made = df.agg(F.sum(rows.cast("bigint"))).first()[0] or 0
    return max(1, -(-made // PER_TASK))


def spread(df: DataFrame, rows: Column, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over ``tasks``.

    A table of studies is a file of one task, however many voxels its rows stand for.
    """
    return df.repartition(tasks(df, rows), *keys)
