"""The folder that the driver and all executors see, tables written there to cut lineage, and shipping of code."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def own_folder() -> str:
    """A folder of this process, for sessions whose executors all live in it."""
    own = tempfile.mkdtemp(prefix="tensorloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, the session's checkpoint folder or, on a local master, an own one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return own_folder()


def application_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tensorloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the application's part of the shared folder that nobody else uses."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_all_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that read from it end with it."""
    delete(spark, application_folder(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tensorloom_path = path
    return out


def drop_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        delete(spark, df._tensorloom_path)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so that Python tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tensorloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="tensorloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tensorloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._tensorloom_shipped = True
