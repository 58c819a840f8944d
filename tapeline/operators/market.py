"""Trading calendar, market regime and decision dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.features import rounded
from tapeline.params import Params


def trading_calendar(prices: DataFrame, p: Params = Params()) -> DataFrame:
    """date, session (0, 1, ...), have and active of every day on which enough recently active tickers trade.

    A ticker is active from each of its dates for `calendar_window` observed dates or until its next date.
    Entries and ends of these stretches are summed along the dates, so nothing is compared pairwise; the
    windows over all dates hold one row for each date.
    """
    pairs = prices.select("date", "ticker").distinct()
    dates = pairs.groupBy("date").agg(F.count("*").alias("have"))
    everything = Window.orderBy("date")
    ranked = dates.withColumn("r", F.row_number().over(everything).cast("long"))
    seen = pairs.join(F.broadcast(ranked.select("date", "r")), "date")
    following = F.lead("r").over(Window.partitionBy("ticker").orderBy("r"))
    stretches = seen.select("r", F.least(F.coalesce(following, F.col("r") + p.calendar_window), F.col("r") + p.calendar_window).alias("until"))
    steps = stretches.select(F.explode(F.array(F.struct(F.col("r").alias("at"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = steps.groupBy(F.col("e.at").alias("r")).agg(F.sum("e.step").alias("step"))
    counted = ranked.join(steps, "r", "left").withColumn("active", F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("r")))
    sessions = counted.where((F.col("active") == 0) | (F.col("have") >= p.min_active_pct * F.col("active")))
    return sessions.select("date", (F.row_number().over(everything) - 1).cast("long").alias("session"), "have", "active")


def regime(index: DataFrame, p: Params = Params()) -> DataFrame:
    """The index with ma, regime_off (null while there are too few closes) and cap."""
    w = Window.orderBy("date").rowsBetween(-(p.regime_bars - 1), 0)
    out = index.withColumns({"n": F.count("*").over(w), "ma": rounded(F.avg("close").over(w), 6)})
    off = F.when(F.col("n") >= p.regime_bars, F.col("close") < F.col("ma"))
    cap = F.when(off, p.cap_off).when(~off, p.cap_on).otherwise(p.cap_unknown)
    return out.select("date", "close", F.when(F.col("n") >= p.regime_bars, F.col("ma")).alias("ma"), off.alias("regime_off"), cap.alias("cap"))


def decision_dates(index: DataFrame, days: int | None) -> DataFrame:
    """The last `days` dates of the index, all if days is 0 or None; seq counts from 1."""
    dates = index.select("date").distinct()
    if days:
        dates = dates.orderBy(F.desc("date")).limit(days)
    return dates.withColumn("seq", F.row_number().over(Window.orderBy("date")).cast("long"))


def tail_gap(lasts: DataFrame, calendar: DataFrame) -> DataFrame:
    """lasts (ticker, last, ...) with tail_gap: sessions after the last bar; null before the calendar or where none follow a day off.

    Every day between the first and the last session gets the number of sessions up to it, so that a gap is one lookup
    and a difference; windows and broadcasts hold a row for each calendar day.
    """
    sessions = calendar.select("date", F.lit(1).alias("one")).distinct()
    ends = sessions.agg(F.min("date").alias("_first"), F.count("*").alias("_all"))
    days = sessions.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date")).join(F.broadcast(sessions), "date", "left")
    numbered = days.select(F.col("date").alias("last"), F.col("one").isNotNull().alias("_on"), F.count("one").over(Window.orderBy("date")).alias("_upto"))
    joined = lasts.join(F.broadcast(numbered), "last", "left").crossJoin(F.broadcast(ends))
    later = F.when(F.col("last") >= F.col("_first"), F.col("_all") - F.coalesce("_upto", F.col("_all")))
    gap = F.when(F.col("_on") | (later > 0), later)
    return joined.withColumn("tail_gap", gap).select(*lasts.columns, "tail_gap")
