"""Window features of bars and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeline.params import Params


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def rounded(x: Column | str, places: int) -> Column:
    """x to so many decimal places, halves up; plain arithmetic, so other engines give the same bits."""
    unit = F.lit(10.0**places)
    return F.floor((F.col(x) if isinstance(x, str) else x) * unit + 0.5) / unit


def pct(a: Column, b: Column) -> Column:
    """Change from b to a in percent; 0 where b is 0 or missing."""
    return F.when(b.isNull() | (b == 0), F.lit(0.0)).otherwise((a - b) / b * 100)


def traded_value() -> Column:
    return F.coalesce("volume", F.lit(0.0)) * F.coalesce("close", F.lit(0.0))


def features(bars: DataFrame, p: Params = Params()) -> DataFrame:
    """The bars with n_bars, r5, r20 of each lag, volume_ratio, price_vs_ma20, atr and next_date.

    All frames share one partitioning, so the bars are shuffled and sorted once.
    """
    w = by_date()
    close, prior = F.col("close"), F.lag("close", 1).over(w)
    before = F.avg("volume").over(w.rowsBetween(-(p.history - 1), -1))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    out = bars.withColumns({
        "n_bars": F.row_number().over(w).cast("long"),
        "next_date": F.lead("date").over(w),
        "true_range": F.when(prior.isNotNull(), true_range),
        "r5": rounded(pct(close, F.lag("close", 5).over(w)), 6),
        **{f"r20_{lag}": rounded(pct(close, F.lag("close", lag).over(w)), 6) for _, lag, _ in p.arms},
        "volume_ratio": rounded(F.when(before.isNull() | (before <= 0), F.lit(1.0)).otherwise(F.col("volume") / before), 6),
        "price_vs_ma20": rounded(pct(close, F.avg("close").over(w.rowsBetween(-19, 0))), 6),
    })
    atr = F.avg("true_range").over(w.rowsBetween(-(p.atr_bars - 1), 0))
    return out.withColumn("atr", rounded(F.when((F.col("n_bars") > p.atr_bars) & (atr > 0) & (close > 0), atr), 6)).drop("true_range")


def avg_value(bars: DataFrame, p: Params = Params()) -> Column:
    """Mean traded value over the last calendar days up to each bar."""
    days = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-(p.liquidity_days - 1), 0)
    return F.coalesce(F.avg(traded_value()).over(days), F.lit(0.0))


def _tiers(value: Column, tiers: tuple[tuple[float, int], ...]) -> Column:
    out = F.lit(0)
    for least, points in reversed(tiers):
        out = F.when(value > least, points).otherwise(out)
    return out


def score(r20: str = "r20_19") -> dict[str, Column]:
    """Points of the four parts and their sum; null features count nothing."""
    # Fixed values of the score: strict lower bounds and points.
    parts = {
        "r5_pts": _tiers(F.col("r5"), ((5, 20), (2, 10))),
        "r20_pts": _tiers(F.col(r20), ((10, 20), (5, 10))),
        "volume_pts": _tiers(F.col("volume_ratio"), ((2, 30), (1.5, 20), (1.2, 10))),
        "ma_pts": _tiers(F.col("price_vs_ma20"), ((5, 30), (2, 20), (0, 10))),
    }
    total = sum(parts.values(), F.lit(0))
    return parts | {"score": total}


def levels(p: Params = Params()) -> dict[str, Column]:
    """Entry, stop and targets from close and atr; null where there is no atr."""
    entry = F.when(F.col("atr").isNotNull(), F.col("close"))
    distance = F.least(F.greatest(p.stop_multiple * F.col("atr"), p.stop_floor * entry), p.stop_ceiling * entry)
    return {
        "entry": rounded(entry, 6),
        "sl": rounded(entry - p.stop_multiple * distance, 6),
        "tp1": rounded(entry + p.target_multiple * distance, 6),
        "tp2": rounded(entry + p.far_target_multiple * distance, 6),
    }


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def fee(notional: Column, side: str, profile: str, p: Params = Params()) -> Column:
    """The fee of one side of a trade under a profile."""
    if profile == "PROD_FLAT":
        return notional * (p.flat_fee / 2)
    return round_half_up(notional * (p.exact_buy if side == "buy" else p.exact_sell)).cast("double")


def position_size(equity: Column, cash: Column, entry: Column, p: Params = Params()) -> Column:
    """Shares in whole lots that the allocation buys; 0 for less than a lot or no price."""
    share = F.least(equity / p.max_positions, cash * p.cash_share)
    lots = F.floor(share / F.when(entry > 0, entry) / p.lot)
    return F.greatest(F.coalesce(lots, F.lit(0)), F.lit(0)) * p.lot


def exit_event(bar: str, p: Params = Params()) -> tuple[Column, Column]:
    """Reason and price of the exit that a bar (open, high, low, close and bars_held with this prefix) brings; null for none."""
    o, h, l, c = (F.col(bar + x) for x in ("open", "high", "low", "close"))
    sl, tp1 = F.col("sl"), F.col("tp1")
    cases = (
        (o >= tp1, "TP_GAP", o),
        (o <= sl, "SL_GAP", o),
        (l <= sl, "STOP_LOSS", sl),
        (h >= tp1, "TAKE_PROFIT_1", tp1),
        (F.col(bar + "bars_held") >= p.max_hold, "TIME_EXIT", c),
    )
    reason, price = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, name, at in reversed(cases):
        reason, price = F.when(test, F.lit(name)).otherwise(reason), F.when(test, at).otherwise(price)
    return reason, price


def ohlc_violation(p: Params = Params()) -> Column:
    """A bar whose prices contradict one another by more than the tolerance; bars with a missing price don't count."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    known = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    low, high = 1 - p.viol_tolerance, 1 + p.viol_tolerance
    return F.coalesce(known & ((h <= 0) | (l <= 0) | (h < l * low) | (h < F.greatest(o, c) * low) | (l > F.least(o, c) * high)), F.lit(False))
