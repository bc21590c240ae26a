"""Tables written to the cluster's shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Shuffle files of an execution are deleted at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, which only a local session may use."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="oremill-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_folder(spark)}/oremill/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back. It survives the loss of executors, and later plans start from it; the shuffles that made it are deleted."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._oremill_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame of written(); others are left alone."""
    path = getattr(df, "_oremill_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators left in the shared folder. Results that were not yet read need them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/oremill")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, in case it is not installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import oremill

    root = os.path.dirname(os.path.dirname(os.path.abspath(oremill.__file__)))
    folder = tempfile.mkdtemp(prefix="oremill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "oremill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(os.path.join(root, "oremill")):
            for name in sorted(files):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
