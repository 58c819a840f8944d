"""Counts and date ranges of tables, and the cut-off they imply."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and their date columns.
TABLES = {
    "region": None, "nation": None, "customer": None, "supplier": None, "part": None, "orders": "o_orderdate", "lineitem": "l_shipdate",
    "events": "ts", "documents": None, "embeddings": None, "pages": None, "benchmark": None, "labels": None, "conversations": None,
}
#: Tables that may be missing.
AUXILIARY = {"orders": "o_orderdate", "supplier": None, "nation": None, "dividends": "date"}


def _one(df: DataFrame, name: str, column: str | None) -> DataFrame:
    day = F.date_format(column, "yyyy-MM-dd") if column else F.lit(None).cast("string")
    return df.agg(F.count("*").alias("n"), F.min(day).alias("min_date"), F.max(day).alias("max_date")).select(F.lit(name).alias("name"), F.col("n").alias("row_count"), "min_date", "max_date")


def table_stats(spark: SparkSession, sf_dir: str, tables: dict[str, str | None] = TABLES) -> DataFrame:
    """name, row_count, min_date and max_date of every table; a missing one is an error."""
    return reduce(DataFrame.unionByName, [_one(spark.read.parquet(f"{sf_dir}/{t}.parquet"), t, c) for t, c in tables.items()])


def effective_cutoff(stats: DataFrame) -> DataFrame:
    """The earliest of the tables' last days; watermarks that are no days don't count."""
    return stats.where(F.col("max_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).agg(F.min("max_date").alias("effective_cutoff"))


def aux_coverage(spark: SparkSession, sf_dir: str, tables: dict[str, str | None] = AUXILIARY) -> DataFrame:
    """As table_stats, but a table that cannot be read has null for its rows, not zero, and missing set."""
    parts = []
    for name, column in tables.items():
        try:
            part = _one(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, column).withColumn("missing", F.lit(False))
        except AnalysisException:
            part = spark.createDataFrame([(name, None, None, None, True)], "name string, row_count long, min_date string, max_date string, missing boolean")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)
