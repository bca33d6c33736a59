"""Intermediate tables on shared storage.

A table that several later steps read is written once, as Parquet in the folder the cluster names
in `spark.checkpoint.dir`: the lineage is cut, a lost executor costs only its own tasks, later
reads prune columns, and their planning sees true sizes. Tables of one application lie together;
`clear` removes them when they are no longer read.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster. Only a local master may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/barloom-{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose tables are written.

    It does so when the driver's JVM finds that nothing refers to them any more, which may be hours later.
    """
    gc.collect()
    spark._jvm.System.gc()


def save_packed(packed: DataFrame, path: str) -> None:
    """Packed blocks under a name of their own, to serve sweeps of later sessions."""
    packed.write.mode("overwrite").parquet(path)


def load_packed(spark: SparkSession, path: str) -> DataFrame:
    """What `save_packed` wrote; the look-back it was packed for is a column of it."""
    return spark.read.parquet(path).withColumn("symbol", F.col("symbol").cast("string"))


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
