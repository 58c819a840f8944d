"""Parquet tables laid out in buckets of a key, so that windows, groups and joins by that key need no exchange.

The rows of a key lie in one file of their bucket, sorted by the key and the given columns. The layout is a property of
the folder: a reader that knows the number of buckets declares it again in the session's catalog.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _ticked(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, sort: Sequence[str] = (), rows_a_file: int = 0) -> None:
    """One file for each bucket that has rows, more where it has more than rows_a_file (0: no bound); the folder must be new."""
    spark, name = df.sparkSession, f"tapeline_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *sort)
    writer.option("path", path).option("maxRecordsPerFile", rows_a_file).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int, sort: Sequence[str] = ()) -> DataFrame:
    """A bucketed folder as a table that Spark knows to be bucketed."""
    layout = f"{path}|{schema.simpleString()}|{key}|{buckets}|{list(sort)}"
    name = f"tapeline_{hashlib.sha256(layout.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"{_ticked([f.name])} {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({_ticked([key])}) SORTED BY ({_ticked([key, *sort])}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)
