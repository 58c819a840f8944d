"""Daily bars derived from event and line-item tables, with the panels that the profiler reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.features import rounded


def _bars(rows: DataFrame, volume) -> DataFrame:
    """rows: ticker, date, price, seq (a total order within the day)."""
    return rows.groupBy("ticker", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        volume.alias("volume"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each user and day of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("seq"))
    return _bars(rows, F.count("*").cast("double"))


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.try_divide("l_extendedprice", "l_quantity")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return items.select("l_suppkey", F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"), price.alias("price"), "l_quantity", seq.alias("seq"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each supplier and ship date of the line items."""
    return _bars(_line_rows(spark, sf_dir), F.sum("l_quantity"))


def index_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date and close: the market's average price of each day."""
    return _line_rows(spark, sf_dir).groupBy("date").agg(rounded(F.avg("price"), 6).alias("close"))


def index_from(bars: DataFrame) -> DataFrame:
    """date and close: the average close of all bars of each day."""
    return bars.groupBy("date").agg(rounded(F.avg("close"), 6).alias("close"))


def panels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """adjusted, raw, close_only and survivors, with bad data planted by supplier number and day.

    flagged holds the first three as parts of one derivation of the bars. Numbers ending in 5 are known as survivors only, those ending in 0 have closes only; every seventh has a
    high below its low on every tenth day of the year.
    """
    bars = from_lineitem(spark, sf_dir)
    number = F.col("ticker").cast("long")
    bad = (number % 7 == 0) & (F.dayofyear("date") % 10 == 0)
    high = F.when(bad, F.col("low") * 0.5).otherwise(F.col("high"))
    adjusted = bars.where(~(number % 10).isin(0, 5)).withColumn("high", high)
    member = {"in_adjusted": ~(number % 10).isin(0, 5), "in_raw": number % 10 != 5, "in_close_only": number % 10 == 0}
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    survivors = supplier.select(F.col("s_suppkey").cast("string").alias("ticker"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("exit_type"))
    survivors = survivors.where(F.col("ticker").cast("long") % 5 == 0)
    return {
        "adjusted": adjusted,
        "raw": bars.where(number % 10 != 5).select("ticker", "date"),
        "close_only": bars.where(number % 10 == 0).select("ticker", "date", "close"),
        "survivors": survivors,
        "flagged": bars.withColumns({"high": high} | member),
    }
