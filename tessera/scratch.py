"""Shared scratch storage, and Arrow mapping whose workers find this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a single-JVM local session may fall back on a folder of this machine; on a cluster the
    setting has to be there, since executors and driver share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.TemporaryDirectory(prefix="tessera-")
    atexit.register(folder.cleanup)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder.name}")
    return f"file://{folder.name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the scratch folder."""
    return f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables: call it when the results that were built from them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/tessera/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    This cuts the lineage like a checkpoint: a lost executor costs a re-read of shared files, not a
    recomputation. Being Parquet, it also keeps column pruning and gives the planner a known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete scratch tables as :func:`materialize` gave them, once nothing that is still to run reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def share_package(spark: SparkSession) -> None:
    """Have Python workers look for this package where the driver found it.

    That matters where workers share the driver's files but not its ``sys.path``; on a cluster the package
    is installed or shipped, and the extra entry names nothing.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """``mapInArrow`` with :func:`share_package`."""
    share_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
