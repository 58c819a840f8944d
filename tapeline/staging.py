"""Tables that a query writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a new folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tapeline-")
        spark.sparkContext.setCheckpointDir(found)
    return found if ":/" in found else "file://" + os.path.abspath(found)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once; the files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tapeline/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _release() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended before Python has
            return
