"""Universe, quality metrics, classes and funnels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.features import ohlc_violation
from tapeline.params import Params


def universe(panels: dict[str, DataFrame]) -> DataFrame:
    """All tickers of the adjusted, close-only and survivor panels."""
    parts = [panels[k].select("ticker").distinct() for k in ("adjusted", "close_only", "survivors")]
    return reduce(DataFrame.union, parts).distinct()


def universe_meta(panels: dict[str, DataFrame]) -> DataFrame:
    """Distinct tickers of each panel and of all."""
    named = reduce(DataFrame.unionByName, [panels[k].select(F.lit(k).alias("panel"), "ticker").distinct() for k in ("adjusted", "close_only", "survivors")])
    return named.unionByName(universe(panels).select(F.lit("universe").alias("panel"), "ticker")).groupBy("panel").agg(F.count("*").alias("tickers"))


def stale_tail(bars: DataFrame) -> DataFrame:
    """ticker and stale_tail: bars at the end whose close is that of the last one (null equals null)."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    last = F.first("close").over(newest)
    changed = F.sum(F.when(F.col("close").eqNullSafe(last), 0).otherwise(1)).over(newest)
    return bars.withColumn("changed", changed).where("changed = 0").groupBy("ticker").agg(F.count("*").alias("stale_tail"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, span_sessions and missing_sessions between the first and last bar; null unless both are sessions, the last later."""
    sessions = F.broadcast(calendar.select("date", "session"))
    ends = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    inside = bars.select("ticker", "date").distinct().join(sessions, "date").groupBy("ticker").agg(F.count("*").alias("held"))
    ends = ends.join(sessions.select(F.col("date").alias("first"), F.col("session").alias("a")), "first", "left")
    ends = ends.join(sessions.select(F.col("date").alias("last"), F.col("session").alias("b")), "last", "left")
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a") + 1)
    return ends.join(inside, "ticker", "left").select("ticker", span.alias("span_sessions"), (span - F.coalesce("held", F.lit(0))).alias("missing_sessions"))


def flat_tails(close_only: DataFrame) -> DataFrame:
    """ticker, last_real_print, flat_tail_bars and last_date of closes that may be carried forward at the end.

    The last real print is the first bar of the run of equal closes that ends a ticker's bars; what follows it is flat.
    """
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"))
    changed = F.sum(F.when(F.col("close").eqNullSafe(F.first("close").over(newest)), 0).otherwise(1)).over(newest)
    tail = close_only.withColumn("changed", changed).where("changed = 0").groupBy("ticker")
    return tail.agg(F.min("date").alias("last_real_print"), (F.count("*") - 1).alias("flat_tail_bars"), F.max("date").alias("last_date"))


def survivors(tickers: DataFrame, survivors: DataFrame, close_only: DataFrame) -> DataFrame:
    """tickers with exit_type ('' where unknown, null where no survivor), last_real_print and flat_tail_bars (null without closes)."""
    known = survivors.select("ticker", F.coalesce("exit_type", F.lit("")).alias("exit_type"))
    tails = flat_tails(close_only).drop("last_date")
    return tickers.join(known, "ticker", "left").join(tails, "ticker", "left")


#: The panels whose rows a profile counts.
MEMBERS = ("adjusted", "raw", "close_only")


def flagged(panels: dict[str, DataFrame]) -> DataFrame:
    """The rows of all panels in one frame: in_adjusted, in_raw and in_close_only say where a row belongs."""
    parts = [panels[k].withColumns({f"in_{m}": F.lit(m == k) for m in MEMBERS}) for k in MEMBERS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def profile(panels: dict[str, DataFrame], calendar: DataFrame, p: Params = Params()) -> DataFrame:
    """The quality metrics of every ticker, in one pass over the rows of all panels.

    panels may bring "flagged" rows of their own, if its panels are parts of one table. A ticker's adjusted
    bars come first and newest first in one window, which serves the stale tail and repeated dates.
    """
    rows = panels.get("flagged")
    rows = flagged(panels) if rows is None else rows
    rows = rows.join(F.broadcast(calendar.select("date", "session")), "date", "left")
    newest = Window.partitionBy("ticker").orderBy(F.desc("in_adjusted"), F.desc("date"))
    last = F.first("close").over(newest)
    rows = rows.withColumns({
        "changed": F.sum(F.when(F.col("close").eqNullSafe(last), 0).otherwise(1)).over(newest),
        "again": F.col("date").eqNullSafe(F.lag("date").over(newest)),
    })
    adj, close = F.col("in_adjusted"), F.col("in_close_only")
    date = F.col("date")
    found = rows.groupBy("ticker").agg(
        F.count_if(adj).alias("n_adj"),
        F.count_if(F.col("in_raw")).alias("n_raw"),
        F.count_if(close).alias("n_close"),
        F.min(F.when(adj, date)).alias("first_adj"),
        F.max(F.when(adj, date)).alias("last_adj"),
        F.min(F.when(close, date)).alias("first_close"),
        F.max(F.when(close, date)).alias("last_close"),
        F.count_if(adj & (F.col("volume").isNull() | (F.col("volume") == 0))).alias("zero_vol"),
        F.count_if(adj & ohlc_violation(p)).alias("ohlc_viol"),
        F.count_if(adj & (F.col("close") <= 0)).alias("nonpos_close"),
        F.count_if(adj & (F.col("changed") == 0)).alias("stale_tail"),
        F.count_if(adj & ~F.col("again") & F.col("session").isNotNull()).alias("held"),
        F.min_by("session", F.when(adj, date)).alias("a"),
        F.max_by("session", F.when(adj, date)).alias("b"),
    )
    known = panels["survivors"].select("ticker", F.lit(True).alias("known")).distinct()
    out = found.join(known, "ticker", "full_outer").fillna(0, ["n_adj", "n_raw", "n_close"])
    out = out.where((F.col("n_adj") > 0) | (F.col("n_close") > 0) | F.col("known"))
    have = F.col("n_adj") > 0
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a") + 1)
    return out.select(
        "ticker",
        "n_adj",
        "n_raw",
        F.when(have, F.lit(0)).otherwise(F.col("n_close")).cast("long").alias("n_close_only"),
        F.when(have, F.col("first_adj")).otherwise(F.col("first_close")).alias("first"),
        F.when(have, F.col("last_adj")).otherwise(F.col("last_close")).alias("last"),
        F.when(have, "ADJUSTED").otherwise("CLOSE_ONLY_DELISTED").alias("basis"),
        *(F.when(have, F.col(c)).alias(c) for c in ("zero_vol", "ohlc_viol", "nonpos_close")),
        span.alias("span_sessions"),
        (span - F.col("held")).alias("missing_sessions"),
        F.when(have, F.col("stale_tail")).alias("stale_tail"),
    )


def unusable_reasons(p: Params = Params()) -> Column:
    """Reasons, in order, that make a profiled ticker unusable."""
    have = F.col("n_adj") > 0
    tests = (
        (~have & (F.col("n_close_only") == 0), "NO_PRICE_DATA"),
        (have & (F.col("missing_sessions") / F.when(F.col("span_sessions") > 0, F.col("span_sessions")) > p.missing_share), "MISSING_SESSIONS_GT20PCT"),
        (have & (F.col("ohlc_viol") > p.viol_count) & (F.col("ohlc_viol") / F.when(have, F.col("n_adj")) > p.viol_share), "OHLC_VIOLATION"),
        (have & (F.col("nonpos_close") > 0), "NONPOSITIVE_CLOSE"),
    )
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda x: x.isNotNull())


def classify_quality(profiled: DataFrame, p: Params = Params()) -> DataFrame:
    """ticker, status and reasons by quality alone."""
    out = profiled.withColumn("reasons", unusable_reasons(p))
    return out.withColumn("status", F.when(F.size("reasons") > 0, "DATA_UNUSABLE").otherwise("PROFILE_OK"))


def classify_freshness(profiled: DataFrame, p: Params = Params()) -> DataFrame:
    """status and reasons of profiled rows with tail_gap: by quality first, then by the sessions since the last bar."""
    out = classify_quality(profiled, p)
    bad, gap = F.col("status") == "DATA_UNUSABLE", F.col("tail_gap")
    status = F.when(bad, "DATA_UNUSABLE").when(gap > p.stale_gap, "PROFILE_OK_STALE_TAIL").otherwise("PROFILE_OK_FRESH")
    reasons = (
        F.when(bad, F.col("reasons"))
        .when(gap.isNull(), F.array(F.lit("TAIL_GAP_UNKNOWN")))
        .when(gap > p.stale_gap, F.array(F.concat(F.lit("TAIL_GAP_"), gap.cast("string"), F.lit("_SESSIONS"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return out.withColumn("reasons", reasons).withColumn("status", status)


def funnel(classified: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Tickers of each status, zeros included."""
    domain = classified.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = classified.groupBy("status").agg(F.count("*").alias("tickers"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("tickers", F.lit(0)).alias("tickers"))


def reason_counts(classified: DataFrame) -> DataFrame:
    """How often each reason stands, counting every reason of a ticker."""
    return classified.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("tickers"))


def stale_list(classified: DataFrame) -> DataFrame:
    """Stale tickers with the longest gap first (place 1), ties by ticker.

    Gaps are counted first, a row for each; places are then counted among the tickers of one gap.
    """
    stale = classified.where("status = 'PROFILE_OK_STALE_TAIL'").select("ticker", "tail_gap", F.coalesce("tail_gap", F.lit(0)).alias("gap"))
    sizes = stale.groupBy("gap").agg(F.count("*").alias("n"))
    longer = Window.orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("gap", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("gap").orderBy("ticker"))
    return stale.join(before, "gap").select("ticker", "tail_gap", place.cast("long").alias("place"))
