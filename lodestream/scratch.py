"""Cutting lineage: intermediate results go to a table in the shared checkpoint folder.

A written table survives the loss of executors, is columnar and compressed, and gives later plans real sizes. The
folder is the one the cluster names in ``spark.checkpoint.dir``; only a local master without that setting (tests, a
laptop) gets a temporary folder, as on a cluster every executor would write to a disk of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestream-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lodestream-{spark.sparkContext.applicationId}"
    if path not in _ROOTS:
        _ROOTS.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan starts at that table."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    return out


def is_written(df: DataFrame) -> bool:
    return hasattr(df, "_lodestream_path")


def forget(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more, such as the states of past rounds; others are left alone."""
    for t in tables:
        if t is not None and is_written(t):
            remove(t.sparkSession, t._lodestream_path)
