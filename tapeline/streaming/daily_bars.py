"""Daily bars of an event stream: the batch bars' aggregation, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """ticker, date and the bar of each day; events (user_id, ts, value, event_id) that come later than `late` are left out."""
    rows = events.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id").withWatermark("ts", late)
    seq = F.struct("ts", "event_id")
    bars = rows.groupBy("ticker", F.window("ts", "1 day")).agg(
        F.min_by("value", seq).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("ticker", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")
