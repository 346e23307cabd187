"""Tables in the folder that the driver and all executors share, so that a result is computed once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used in local mode if spark.checkpoint.dir is unset.
LOCAL_DIR = "/tmp/checkpoints/sieveline"


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or LOCAL_DIR).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again; the files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveline-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may have ended; leftovers are harmless
        pass
