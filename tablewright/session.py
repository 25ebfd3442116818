"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_MADE: list[str] = []


def build_session(app: str = "tablewright", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs rely on. On a cluster leave ``master`` and ``partitions`` unset."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``scratch_scope`` deletes it."""
    _MADE.append(os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"))
    return _MADE[-1]


def checkpointed(df):
    """Reliable checkpoint in the shared folder: lineage ends in files that survive a lost executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df, name: str = "table"):
    """``df`` as a Parquet table below the shared folder. Spark knows its size in bytes: a join broadcasts it only if it is small."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), paths


@contextmanager
def scratch_scope(spark: SparkSession, keep: tuple[str, ...] = ()):
    """Deletes, at its end, the scratch folders made inside it but for those named in ``keep``; results that read them must be written elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        paths, kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
        for made in _MADE[before:]:
            if os.path.basename(made).rpartition("-")[0] in keep:
                kept.append(made)
                continue
            path = paths(made)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE[before:] = kept
