"""The registered queries: one for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline import ledger, staging
from tapeline.functions import exact
from tapeline.functions import features as ft
from tapeline.operators import append, buckets, market, profile, replay
from tapeline.params import FEE_PROFILES, FRESHNESS_STATUSES, PROFILE_STATUSES, Params
from tapeline.sources import bars as src
from tapeline.sources import stats

Query = Callable[[SparkSession, str], DataFrame]

#: The strategy on event bars and the profiler on line-item bars, with gates that fit their magnitudes.
EVENTS = Params(min_avg_value=70.0)
LINES = Params(min_avg_value=5e4, min_active_pct=0.20)


def _rounded(df: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    return df.withColumns({c: ft.rounded(c, to) for c in columns})


def bars_events(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_events(spark, sf)


def bars_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(src.from_lineitem(spark, sf), "open", "high", "low", "close")


def index_series(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(src.index_from_lineitem(spark, sf), "close")


def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.table_stats(spark, sf)


def effective_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return stats.effective_cutoff(stats.table_stats(spark, sf))


def aux_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return stats.aux_coverage(spark, sf)


def universe_union(spark: SparkSession, sf: str) -> DataFrame:
    return profile.universe(src.panels(spark, sf))


def universe_meta(spark: SparkSession, sf: str) -> DataFrame:
    return profile.universe_meta(src.panels(spark, sf))


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return market.trading_calendar(src.panels(spark, sf)["adjusted"], LINES)


def trading_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _calendar(spark, sf)


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    panels = src.panels(spark, sf)
    return profile.profile(panels, market.trading_calendar(panels["adjusted"], LINES), LINES)


def profile_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf)


def ohlc_violations(spark: SparkSession, sf: str) -> DataFrame:
    return src.panels(spark, sf)["adjusted"].where(ft.ohlc_violation(LINES)).select("ticker", "date")


def stale_tail(spark: SparkSession, sf: str) -> DataFrame:
    return profile.stale_tail(src.from_events(spark, sf).withColumn("close", ft.rounded("close", -2)))


def missing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    panels = src.panels(spark, sf)
    return profile.missing_sessions(panels["adjusted"], market.trading_calendar(panels["adjusted"], LINES))


def survivorship_left_join(spark: SparkSession, sf: str) -> DataFrame:
    panels = src.panels(spark, sf)
    coarse = panels["close_only"].withColumn("close", ft.rounded("close", -3))  # so that some closes repeat
    return profile.survivors(profile.universe(panels), panels["survivors"], coarse)


def _joined_reasons(df: DataFrame) -> DataFrame:
    return df.select("ticker", "status", F.array_join("reasons", "|").alias("reasons"))


def classify_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_reasons(profile.classify_quality(_profiled(spark, sf), LINES))


def funnel_v2(spark: SparkSession, sf: str) -> DataFrame:
    return profile.funnel(profile.classify_quality(_profiled(spark, sf), LINES), PROFILE_STATUSES)


def unusable_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return profile.reason_counts(profile.classify_quality(_profiled(spark, sf), LINES))


def tail_gap(spark: SparkSession, sf: str) -> DataFrame:
    return market.tail_gap(_profiled(spark, sf).select("ticker", "last"), _calendar(spark, sf))


#: Line items thin out towards the last dates; this gap splits the suppliers.
FRESH = replace(LINES, stale_gap=1, missing_share=0.75)


def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    return profile.classify_freshness(market.tail_gap(_profiled(spark, sf), _calendar(spark, sf)), FRESH)


def classify_v3(spark: SparkSession, sf: str) -> DataFrame:
    return _joined_reasons(_fresh(spark, sf))


def funnel_v3(spark: SparkSession, sf: str) -> DataFrame:
    return profile.funnel(_fresh(spark, sf), FRESHNESS_STATUSES)


def stale_list_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return profile.stale_list(_fresh(spark, sf))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.features(src.from_events(spark, sf), EVENTS)


def momentum_r5_r20(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select("ticker", "date", "r5", "r20_19", "r20_20"), "r5", "r20_19", "r20_20")


def volume_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select("ticker", "date", "volume_ratio"), "volume_ratio")


def price_vs_ma20(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select("ticker", "date", "price_vs_ma20"), "price_vs_ma20")


def score_core(spark: SparkSession, sf: str) -> DataFrame:
    scored = _features(spark, sf).where(F.col("n_bars") >= EVENTS.min_bars).withColumns(ft.score())
    return scored.select("ticker", "date", "r5_pts", "r20_pts", "volume_pts", "ma_pts", "score")


def atr_levels(spark: SparkSession, sf: str) -> DataFrame:
    found = _features(spark, sf).withColumns(ft.levels(EVENTS)).where("entry is not null")
    return _rounded(found.select("ticker", "date", "atr", "entry", "sl", "tp1", "tp2"), "atr", "entry", "sl", "tp1", "tp2")


def avg_value_20d(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.from_events(spark, sf)
    return bars.select("ticker", "date", ft.rounded(ft.rounded(ft.avg_value(bars, EVENTS), 6), 4).alias("avg_value"))


def regime_ma200(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(market.regime(src.index_from_lineitem(spark, sf), LINES), "close", "ma")


def decision_dates(spark: SparkSession, sf: str) -> DataFrame:
    return market.decision_dates(src.index_from_lineitem(spark, sf), 126)


def _events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bars, index, decision dates and caps of the events."""
    bars = src.from_events(spark, sf)
    index = src.index_from(bars)
    return bars, index, market.decision_dates(index, 0), market.regime(index, EVENTS)


def _dated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Dated bars, index, decision dates and caps; the bars are derived once and their features once, as queries read them several times."""
    bars = staging.staged(src.from_events(spark, sf), "bars")
    index = src.index_from(bars)
    dates = market.decision_dates(index, 0)
    return bars, staging.staged(replay.dated_bars(bars, index, dates, EVENTS), "dated"), index, dates, market.regime(index, EVENTS)


def asof_last_bar(spark: SparkSession, sf: str) -> DataFrame:
    bars, index, dates, _ = _events(spark, sf)
    return replay.as_of(replay.dated_bars(bars, index, dates, EVENTS)).select("ticker", "date", "bar_date", "close", "n_bars")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    bars, index, dates, _ = _events(spark, sf)
    return replay.candidates(bars, index, dates, EVENTS)


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return replay.top_by_cap(_candidates(spark, sf), _events(spark, sf)[3])


def signal_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).where("bucket = 'QUALIFIED'").select("arm", "ticker", "date", "bar_date", "score", ft.rounded("r20", 4).alias("r20"), ft.rounded("avg_value", 4).alias("avg_value"))


def bucket_daily(spark: SparkSession, sf: str) -> DataFrame:
    return replay.bucket_daily(_assigned(spark, sf))


def bucket_avg(spark: SparkSession, sf: str) -> DataFrame:
    return replay.bucket_average(replay.bucket_daily(_assigned(spark, sf)))


def bucket_assign_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("arm", "ticker", "date", "bucket", F.get("reasons", F.lit(0)).alias("primary_reason"), F.array_join("reasons", "|").alias("reasons"))


def bucket_invariant(spark: SparkSession, sf: str) -> DataFrame:
    assigned = _assigned(spark, sf)
    known = F.col("bucket").isin(*replay.BUCKETS)
    return assigned.groupBy("arm", "date").agg(F.count("*").alias("tickers"), (F.count_if(known) == F.count("*")).alias("invariant_ok"))


def terminal_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates of the bucket rules, so that every rule has cases."""
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey",
        (key % 11 != 0).alias("data_ok"),
        (cust % 40).alias("n_bars"),
        (key % 7 != 0).alias("feature_ok"),
        (cust % 13 != 0).alias("scored"),
        (key % 3 != 0).alias("gates_passed"),
        (cust % 100).alias("score"),
        (key % 4).alias("volume_pts"),
        (F.floor(price) % 60).cast("double").alias("r20"),
        (cust % 5 == 0).alias("overlap_open"),
        (key % 2 == 0).alias("selected"),
    )
    return buckets.terminal_bucket(orders).select("o_orderkey", "bucket", "primary_reason", F.array_join("reasons", "|").alias("reasons"))


def simulated_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal as a trade of two lots under the exact fees."""
    signals, dated = _signals(spark, sf)
    trades = replay.simulate(signals, dated, F.lit(200), "AJAIB_EXACT", EVENTS).where("exit_date is not null")
    return _rounded(trades.select("ticker", "date", "exit_date", "bars_held", "fee_buy", "fee_sell", "net", "ret_pct"), "net", "ret_pct")


def topn_by_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).where("bucket = 'SELECTED'").select("arm", "date", "rank", "ticker", "score", "cap")


def b0_b1_candidate_delta(spark: SparkSession, sf: str) -> DataFrame:
    return replay.delta(_candidates(spark, sf).where("bucket = 'QUALIFIED'"))


def _signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Signals of bars with enough history and at least middling scores, all arms alike, and the dated bars."""
    _, dated, *_ = _dated(spark, sf)
    scored = dated.withColumns(ft.score() | ft.levels(EVENTS)).where("entry is not null and score >= 40")
    return scored.select("ticker", "date", "entry", "sl", "tp1", "dec_no", "halts", "suspended"), dated


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return replay.outcomes(*_signals(spark, sf), EVENTS)


def exit_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.from_events(spark, sf).withColumns({"entry": F.lit(100.0), "sl": F.lit(40.0), "tp1": F.lit(160.0), "bars_held": (F.dayofmonth("date") % 12).cast("long")})
    reason, price = ft.exit_event("", EVENTS)
    return bars.select("ticker", "date", reason.alias("exit_reason"), ft.rounded(price, 4).alias("exit")).where("exit_reason is not null")


def trade_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_outcomes(spark, sf).select("ticker", "date", "entry", "exit_date", "exit", "exit_reason", "bars_held"), "entry", "exit")


def suspended_exits(spark: SparkSession, sf: str) -> DataFrame:
    found = _outcomes(spark, sf).where("exit_reason = 'TIME_EXIT_SUSPENDED'")
    return _rounded(found.select("ticker", "date", "exit_date", "exit", "bars_held"), "exit")


def fees_both_profiles(spark: SparkSession, sf: str) -> DataFrame:
    notional = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("notional"))
    named = {f"{side}_{profile.lower()}": ft.rounded(ft.fee(F.col("notional"), side, profile), 4) for side in ("buy", "sell") for profile in FEE_PROFILES}
    return notional.withColumns(named).drop("notional")


def position_size(spark: SparkSession, sf: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("equity"), (F.col("o_totalprice") * 0.3).alias("cash"), (F.col("o_custkey") % 40).cast("double").alias("entry"))
    return parts.select("o_orderkey", ft.position_size(F.col("equity"), F.col("cash"), F.col("entry")).cast("long").alias("qty"))


def _closed(spark: SparkSession, sf: str, qty: int = 100) -> DataFrame:
    """Closed outcomes of both arms' candidates at one lot each, with net and return under the flat profile."""
    bars, dated, index, dates, _ = _dated(spark, sf)
    found = replay.candidates(bars, index, dates, EVENTS, dated).where("entry is not null and score >= 40 and (not fresh or bar_date = date)")
    signals = found.select("arm", "ticker", "date", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    out = replay.outcomes(signals, dated, EVENTS).where("exit_date is not null")
    gain = replay.net(F.col("entry"), F.col("exit"), F.lit(qty), "PROD_FLAT", EVENTS)
    by_side = replay.net(F.col("entry"), F.col("exit"), F.lit(qty), "AJAIB_EXACT", EVENTS)
    return out.withColumns({"net": ft.rounded(gain, 6), "net_exact": ft.rounded(by_side, 6), "ret_pct": ft.rounded(gain / (F.col("entry") * qty) * 100, 6)})


def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    return replay.trade_summary(_closed(spark, sf))


def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return replay.upper_median(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "median_price")


def exit_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(spark, sf).groupBy("arm", "exit_reason").agg(F.count("*").alias("trades"))


def fee_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(spark, sf).groupBy("arm").agg(
        exact.half_even(F.sum("net"), 2).alias("total_net_flat"), exact.half_even(F.sum("net_exact"), 2).alias("total_net_exact"), exact.half_even(F.sum("net_exact") - F.sum("net"), 2).alias("fee_impact")
    )


def trades_only_b0(spark: SparkSession, sf: str) -> DataFrame:
    found = replay.delta(_closed(spark, sf)).where("side = 'only_B0'")
    return found.select(F.concat("ticker", F.lit("@"), F.col("date").cast("string")).alias("trade"))


def trades_common(spark: SparkSession, sf: str) -> DataFrame:
    return replay.delta(_closed(spark, sf)).groupBy("side").agg(F.count("*").alias("trades"))


def mark_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Value of 100 shares of every ticker at the close as of each decision date, and cash."""
    held = asof_last_bar(spark, sf).groupBy("date").agg(ft.rounded(F.sum(F.col("close") * 100) + EVENTS.capital, 2).alias("equity"))
    return held


def canonical_sha(spark: SparkSession, sf: str) -> DataFrame:
    """Content ids of the bars: SHA-256 of the canonical JSON of every column."""
    bars = src.from_events(spark, sf)
    return bars.select("ticker", "date", F.sha2(exact.canonical_row(bars.schema), 256).alias("id"))


def half_even_rounding(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the line items after discount and tax, to cents, and quantities in eighths, to hundredths, ties to even."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    price, charge = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rounded = [exact.half_even(x, n).alias(name) for x, n, name in ((price, 2, "price"), (charge, 4, "charge"), (F.col("l_quantity") / 8, 2, "eighths"), (-F.col("l_quantity") / 4, 1, "quarters"))]
    return items.select("l_orderkey", "l_linenumber", *rounded)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"), F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("no"))


def ledger_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Orders numbered by key, those without a key last as in SQL; the ids follow from the keys, so they are made after the sort."""
    keys = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("no"))
    numbered = ledger.sequenced(keys, start=1000, order=[F.col("no").asc_nulls_last()])
    return numbered.select(F.sha2(F.col("no").cast("string"), 256).alias("id"), "ledger_seq")


def ledger_unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.unique_violations(_records(spark, sf), ["slot"])


def ledger_dangling(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey % 7 <> 0").select(F.col("o_orderkey").alias("id"))
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id")).distinct()
    return ledger.dangling(items, "order_id", orders)


def append_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a batch of records: every third is held, every fourth sent again, every sixth sent with another result.

    A customer has one order for each priority; customers of every fifth number are unknown.
    """
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("result_digest"), "o_custkey", "o_orderpriority", F.col("o_custkey").alias("ref"))
    customers = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"))
    held = orders.where("o_orderkey % 3 = 0").groupBy("o_custkey", "o_orderpriority").agg(F.min_by(F.struct("id", "result_digest"), "o_orderkey").alias("r")).select("o_custkey", "o_orderpriority", "r.*")
    sent = F.array_compact(F.array(F.struct(F.lit(0).alias("k"), F.col("result_digest").alias("d")), F.when(F.col("o_orderkey") % 4 == 0, F.struct(F.lit(1).alias("k"), F.col("result_digest").alias("d"))), F.when(F.col("o_orderkey") % 6 == 0, F.struct(F.lit(2).alias("k"), F.lit("another").alias("d")))))
    batch = orders.select("*", F.explode(sent).alias("s")).select((F.col("s.k") * 1_000_000_000_000 + F.col("o_orderkey")).alias("no"), "id", F.col("s.d").alias("result_digest"), "o_custkey", "o_orderpriority", "ref")
    return append.judge(batch, held, order=["no"], unique=["o_custkey", "o_orderpriority"], references={"ref": customers}).select("no", "id", "outcome")


def latest_in_group(spark: SparkSession, sf: str) -> DataFrame:
    """The newest order of each customer, as the ledger finds the latest run of a slot."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    return orders.groupBy("o_custkey").agg(best, F.count("*").alias("generation")).select("o_custkey", "o.o_orderkey", "generation")


def _book(spark: SparkSession, sf: str) -> DataFrame:
    bars, dated, index, dates, caps = _dated(spark, sf)
    found = staging.staged(replay.candidates(bars, index, dates, EVENTS, dated).where("bucket = 'QUALIFIED'"), "qualified")
    signals = found.select("arm", "ticker", "date", "score", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    return replay.book(replay.outcomes(signals, dated, EVENTS), replay.as_of(dated).select("ticker", "date", "close"), caps, dates, FEE_PROFILES, EVENTS)


def replay_book(spark: SparkSession, sf: str) -> DataFrame:
    return _book(spark, sf)


def e0_report(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of the booked trades of each arm under the flat profile, with open positions and the last equity."""
    booked = _book(spark, sf).where("profile = 'PROD_FLAT'")
    return replay.trade_summary(*(booked.where(F.col("kind") == kind) for kind in ("TRADE", "OPEN", "DAY")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bars_events, bars_lineitem, index_series, table_stats, effective_cutoff, aux_coverage, universe_union, universe_meta,
        trading_calendar, profile_metrics, ohlc_violations, stale_tail, missing_sessions, survivorship_left_join, classify_v2,
        funnel_v2, unusable_reasons, tail_gap, classify_v3, funnel_v3, stale_list_sorted, momentum_r5_r20, volume_ratio,
        price_vs_ma20, score_core, atr_levels, avg_value_20d, regime_ma200, decision_dates, asof_last_bar, signal_gates,
        terminal_buckets, simulated_trades, bucket_daily, bucket_avg, bucket_assign_reasons, bucket_invariant, topn_by_cap, b0_b1_candidate_delta, exit_events,
        trade_outcomes, suspended_exits, fees_both_profiles, position_size, trade_summary, upper_median, exit_reason_counts,
        fee_sensitivity, trades_only_b0, trades_common, mark_equity, canonical_sha, half_even_rounding, ledger_seq, ledger_unique_violations,
        ledger_dangling, append_outcomes, latest_in_group, replay_book, e0_report,
    )
}
