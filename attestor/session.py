"""Session defaults shared by tests, the bench and command-line use."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: str | None = None
_WRITTEN: list[str] = []


def build_session(master: str = "local[8]", app: str = "attestor", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster the submit configuration wins and this is not used."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Only a session on a local master may do without the setting, as in tests; it gets one
    temporary folder. On a cluster a machine-local folder would lose rows, so that raises.
    """
    global _LOCAL_FOLDER
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    if _LOCAL_FOLDER is None:
        _LOCAL_FOLDER = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDER


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used once and deleted by :func:`release`."""
    path = f"{shared_folder(spark).rstrip('/')}/attestor-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_at_exit)
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once as Parquet in the shared folder and read it back.

    Used where a result feeds several branches. The copy outlives lost executors, cuts
    the lineage, keeps column pruning for its readers, and tells the optimizer the true
    size, so a broadcast is only ever chosen on a measured size.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 250_000  # rows of a large table that one task takes when tasks are counted out
LEAST_ROWS = 20_000  # a smaller table is not cut further


def tasks_for(rows: DataFrame) -> int:
    """Number of tasks for work on all ``rows``, which are counted: a scan or a stored table.

    Left to itself a scan takes files by size, and shuffled partitions are merged by size, so
    hash tables and sorts of a task grow with the input until they are that large. A stated
    number is kept, so a task has some ``ROWS_A_TASK`` rows in a table of any size.
    """
    count = rows.count()
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(count // ROWS_A_TASK, min(usual, count // LEAST_ROWS)) + 1


def _release_at_exit() -> None:
    """Intermediates of this process are of no use after it; a stopped session leaves them."""
    with contextlib.suppress(Exception):
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call once results are stored.

    Uses the JVM's file systems, so it needs a classic session, not Spark Connect.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        removed += int(path.getFileSystem(conf).delete(path, True))
    atexit.unregister(_release_at_exit)
    return removed
