"""Session settings, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dates before the Gregorian calendar are written as they are, not shifted.
REBASE_CONF = {
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
}

# Settings the library is written for.  Pass them to a session builder.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    **REBASE_CONF,
}

# A side whose row count is known to stay below this may be broadcast.
BROADCAST_ROWS = 100_000


MIB = 1024 * 1024


def sizing(input_bytes: int, cores: int, task_bytes: int = 192 * MIB) -> dict[str, str]:
    """Shuffle settings for an input size: tasks that fit in memory, whole waves of cores.

    AQE merges partitions that turn out small, so the number is an upper bound.
    """
    waves = max(1, -(-input_bytes // (task_bytes * cores)))
    return {
        "spark.sql.shuffle.partitions": str(waves * cores),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes),
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
    }


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply SESSION_CONF to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


# Removes the shuffle files of a query at its end (Spark 4.1; earlier versions ignore it).
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors can reach.

    Where it is unset, a local session (tests) gets a temporary folder; a
    cluster session is refused, since a machine-local folder would not survive
    there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tagloom-")
    return _LOCAL_FOLDERS[context.applicationId]


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a staged table, below a folder of this application."""
    return f"{shared_folder(spark)}/tagloom/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end in here go with them, not when the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    Cuts the lineage where one result feeds several consumers: the expensive
    plan above runs once, a lost executor costs a re-read, and every consumer
    still gets column pruning and filter pushdown.  Nobody reads the shuffle
    files of the write again, so they are freed.
    """
    path = stage_path(df.sparkSession, label)
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast ``df`` when its proven row bound is small, else leave it to AQE."""
    if rows is not None and rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df
