"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one, a private folder if all runs in this process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="langloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/langloom/{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return path


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame after a round trip through a Parquet table: its lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
