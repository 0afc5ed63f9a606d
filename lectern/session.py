"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "lectern", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else the context's checkpoint directory.

    Only on a single machine (``local[...]``: tests) a temporary folder is made where the session names
    none, and used for the life of the session; on a cluster that is an error, as executors would write
    to their own disks.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    known = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not known:
        if not re.match(r"local(\[[^\]]*\])?$", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = getattr(shared_dir, "own", None)
        if known is None or not os.path.isdir(known[len("file://") :]):
            known = "file://" + tempfile.mkdtemp(prefix="lectern-")
            shared_dir.own = known
    if held.isEmpty():
        context.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it: lineage is cut, and the
    result survives the loss of executors.  The tables of a session are removed when it ends.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    remember(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def remember(spark: SparkSession, path: str) -> None:
    """Have :func:`forget` remove ``path``."""
    _written.append((spark, path))


@atexit.register
def forget(since: int = 0) -> None:
    """Remove the tables that :func:`cut` wrote (also to be called between long jobs); with ``since`` (a former :func:`kept`) only those written later."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary then
            continue


def kept() -> int:
    """How many tables :func:`forget` would remove."""
    return len(_written)


def if_small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted), else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
