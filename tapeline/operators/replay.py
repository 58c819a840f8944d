"""Candidates, buckets, selection, outcomes and the simulated book."""

from __future__ import annotations

import math
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import features as ft
from tapeline.functions.exact import half_even
from tapeline.params import BUCKETS, Params


def day_numbers(index: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every calendar day between the first and last marked date: index_no and decision_no (such dates so far), decides.

    The windows and the broadcasts of this table hold one row for each calendar day.
    """
    marks = index.select("date", F.lit(1).alias("i"), F.lit(0).alias("d")).unionByName(decisions.select("date", F.lit(0).alias("i"), F.lit(1).alias("d")))
    marks = marks.groupBy("date").agg(F.max("i").alias("i"), F.max("d").alias("d"))
    days = marks.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    so_far = Window.orderBy("date")
    filled = days.join(F.broadcast(marks), "date", "left").fillna(0, ["i", "d"])
    return filled.select("date", F.sum("i").over(so_far).alias("index_no"), F.sum("d").over(so_far).alias("decision_no"), (F.col("d") == 1).alias("decides"))


def dated_bars(bars: DataFrame, index: DataFrame, decisions: DataFrame, p: Params = Params()) -> DataFrame:
    """Features of every bar, with what the replay needs to know of decision dates around it.

    on_date: the bar is of a decision date; dec_no: bars of decision dates so far; gap: index dates after the
    bar; missing: decision dates between it and the next bar; halts: those of them at which the ticker counts
    as suspended; suspended: the first such date behind later bars. Dates are numbered, so that gaps are
    differences; the decision dates (a row each) travel as one broadcast array of which bars take slices.
    """
    numbers = day_numbers(index, decisions)
    ends = numbers.agg(F.min("date").alias("first_day"), F.max("index_no").alias("index_dates"), F.sort_array(F.collect_list(F.when(F.col("decides"), F.struct("date", "index_no")))).alias("days"))
    out = ft.features(bars.where(~F.col("ticker").startswith("^")), p)
    out = out.join(F.broadcast(numbers), "date", "left").crossJoin(F.broadcast(ends))
    w = ft.by_date()
    outside = lambda total: F.when(F.col("date") < F.col("first_day"), 0).otherwise(total)
    known = F.coalesce("decision_no", outside(F.size("days")))
    out = out.withColumns({
        "on_date": F.coalesce("decides", F.lit(False)),
        "gap": (F.col("index_dates") - F.coalesce("index_no", outside(F.col("index_dates")))).cast("long"),
        "known": known.cast("int"),
        "seen": F.coalesce("index_no", outside(F.col("index_dates"))),
    })
    before_next = F.coalesce(F.lead(F.col("known") - F.col("on_date").cast("int")).over(w), F.size("days"))
    missed = F.when(before_next > F.col("known"), F.slice("days", F.col("known") + 1, before_next - F.col("known")))
    out = out.withColumn("missed", F.coalesce(missed, F.slice("days", 1, 0))).withColumn("dec_no", F.sum(F.col("on_date").cast("int")).over(w).cast("long"))
    if p.suspension_mode == "as_of":
        halts = F.filter("missed", lambda d: d["index_no"] >= F.col("seen") + p.max_hold)
    else:
        halts = F.when(F.col("gap") >= p.max_hold, F.col("missed")).otherwise(F.slice("missed", 1, 0))
    out = out.withColumns({"missing": F.col("missed.date"), "halts": halts["date"]})
    out = out.withColumn("first_halt", F.get("halts", F.lit(0)))
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("suspended", F.last("first_halt", ignorenulls=True).over(later))
    return out.drop("days", "first_day", "index_dates", "index_no", "decision_no", "decides", "known", "seen", "missed", "first_halt")


def as_of(dated: DataFrame) -> DataFrame:
    """A row for each ticker and decision date: the last bar at or before it, as bar_date and the bar's columns.

    Every bar is laid out over the decision dates up to the next bar, so there is no join.
    """
    own = F.when(F.col("on_date"), F.array("date")).otherwise(F.array().cast("array<date>"))
    return dated.withColumn("covered", F.concat(own, F.col("missing"))).withColumnRenamed("date", "bar_date").withColumn("date", F.explode("covered")).drop("covered")


def with_liquidity(at_dates: DataFrame, bars: DataFrame, p: Params = Params()) -> DataFrame:
    """as_of rows with avg_value: the mean traded value of the bars of the last calendar days up to the decision date."""
    carried = F.struct(*[c for c in at_dates.columns if c not in ("ticker", "date")])
    decisions = at_dates.select("ticker", "date", F.lit(None).cast("double").alias("value"), carried.alias("row"))
    kind = decisions.schema["row"].dataType
    values = bars.select("ticker", "date", ft.traded_value().alias("value"), F.lit(None).cast(kind).alias("row"))
    days = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-(p.liquidity_days - 1), 0)
    both = values.unionByName(decisions).withColumn("avg_value", ft.rounded(F.coalesce(F.avg("value").over(days), F.lit(0.0)), 6))
    return both.where("row is not null").select("ticker", "date", "avg_value", "row.*")


def candidates(bars: DataFrame, index: DataFrame, decisions: DataFrame, p: Params = Params(), dated: DataFrame | None = None) -> DataFrame:
    """Every ticker of every arm and decision date with its score, levels, bucket (QUALIFIED until selected) and reasons.

    dated: the dated bars where they are known already; bars then needs no more than their tickers, dates and values.
    """
    rows = with_liquidity(as_of(dated_bars(bars, index, decisions, p) if dated is None else dated), bars, p)
    arms = F.array(*[F.struct(F.lit(name).alias("arm"), F.col(f"r20_{lag}").alias("r20"), F.lit(fresh).alias("fresh")) for name, lag, fresh in p.arms])
    rows = rows.withColumn("a", F.explode(arms)).select("*", "a.*").drop("a")
    rows = rows.withColumns(ft.score("r20")).withColumns(ft.levels(p))
    failed = F.filter(
        F.array(
            F.when(F.col("score") < p.threshold_score, F.lit("BELOW_THRESHOLD")),
            F.when(F.col("volume_pts") <= 0, F.lit("VOLUME_GATE")),
            F.when(F.col("r20") < p.r20_gate, F.lit("R23_GATE")),
        ),
        lambda x: x.isNotNull(),
    )
    one = lambda name: F.array(F.lit(name))
    tests = (
        (F.col("n_bars") < p.min_bars, "INELIGIBLE", one("INSUFFICIENT_HISTORY")),
        (F.col("avg_value") <= p.min_avg_value, "GATE_REJECTED", one("LIQUIDITY_GATE")),
        (F.col("fresh") & (F.col("bar_date") != F.col("date")), "GATE_REJECTED", one("STALE_DATA_AS_OF")),
        (F.col("entry").isNull(), "FEATURE_INVALID", one("FEATURE_FAIL")),
        (F.size(failed) > 0, "GATE_REJECTED", failed),
    )
    bucket, reasons = F.lit("QUALIFIED"), F.array().cast("array<string>")
    for test, name, why in reversed(tests):
        bucket, reasons = F.when(test, F.lit(name)).otherwise(bucket), F.when(test, why).otherwise(reasons)
    return rows.withColumn("bucket", bucket).withColumn("reasons", reasons)


def top_by_cap(found: DataFrame, caps: DataFrame) -> DataFrame:
    """Candidates with rank and the final bucket, as if no position were open."""
    order = Window.partitionBy("arm", "date").orderBy(F.desc("score"), "ticker")
    good = F.col("bucket") == "QUALIFIED"
    # ranks are needed of qualified rows only; the others stay out of the sort
    ranked = found.where(good).withColumn("rank", F.row_number().over(order).cast("long")).join(F.broadcast(caps.select("date", "cap")), "date", "left")
    chosen = F.when(F.col("rank") <= F.col("cap"), "SELECTED").otherwise("QUALIFIED_NOT_SELECTED")
    ranked = ranked.withColumn("bucket", chosen).withColumn("reasons", F.array(F.when(F.col("bucket") == "SELECTED", "CAP_TOP_N").otherwise("CAP_BLOCKED")))
    return ranked.unionByName(found.where(~good), allowMissingColumns=True)


def bucket_daily(assigned: DataFrame) -> DataFrame:
    """Tickers of each arm and date by bucket, a column for each, zeros included."""
    return assigned.groupBy("arm", "date").pivot("bucket", list(BUCKETS)).count().fillna(0)


def bucket_average(daily: DataFrame, arm: str = "B0") -> DataFrame:
    """Mean of each bucket over the dates of one arm."""
    long = daily.where(F.col("arm") == arm).unpivot(["date"], list(BUCKETS), "bucket", "tickers")
    return long.groupBy("bucket").agg(half_even(F.avg("tickers"), 1).alias("avg_tickers"))


def outcomes(signals: DataFrame, dated: DataFrame, p: Params = Params()) -> DataFrame:
    """signals (ticker, date, entry, sl, tp1, dec_no, halts, suspended, ...) with exit_date, exit, reason and bars_held.

    The outcome does not depend on the book. A signal meets its next `max_hold` decision-date bars by number;
    a suspension is known from the bar itself. Open signals have nulls.
    """
    bars = dated.where("on_date").select("ticker", F.col("dec_no").alias("no"), *[F.col(c).alias(f"b_{c}") for c in ("date", "open", "high", "low", "close")])
    keyed = signals.withColumn("no", F.explode(F.sequence(F.col("dec_no") + 1, F.col("dec_no") + p.max_hold)))
    met = keyed.join(bars, ["ticker", "no"], "left").withColumn("b_bars_held", F.col("no") - F.col("dec_no"))
    reason, price = ft.exit_event("b_", p)
    keys = [c for c in signals.columns]
    halted = F.coalesce(F.get(F.filter("halts", lambda d: d > F.col("date")), F.lit(0)), F.col("suspended"))
    event = F.when(F.col("b_date").isNotNull() & reason.isNotNull(), F.struct(F.col("no"), F.col("b_date").alias("date"), price.alias("price"), reason.alias("reason"), F.col("b_bars_held").alias("held")))
    met = met.withColumn("halted", halted).withColumn("event", event)
    past = F.when(F.col("b_date") < F.col("halted"), F.struct(F.col("no"), F.col("b_close").alias("close"), F.col("b_bars_held").alias("held")))
    out = met.groupBy(*keys, "halted").agg(F.min("event").alias("event"), F.max(past).alias("past"))
    stop = F.col("halted").isNotNull() & (F.col("event").isNull() | (F.col("halted") < F.col("event.date")))
    return out.select(
        *keys,
        F.when(stop, F.col("halted")).otherwise(F.col("event.date")).alias("exit_date"),
        F.when(stop, F.coalesce("past.close", "entry")).otherwise(F.col("event.price")).alias("exit"),
        F.when(stop, F.lit("TIME_EXIT_SUSPENDED")).otherwise(F.col("event.reason")).alias("exit_reason"),
        F.when(stop, F.coalesce("past.held", F.lit(0))).otherwise(F.col("event.held")).cast("long").alias("bars_held"),
    )


def simulate(signals: DataFrame, dated: DataFrame, qty: Column, fee_profile: str = "PROD_FLAT", p: Params = Params()) -> DataFrame:
    """Trades of single signals from fill to exit, apart from any book: qty, both fees, net and ret_pct; open ones have nulls."""
    bought, sold = F.col("entry") * F.col("qty"), F.col("exit") * F.col("qty")
    out = outcomes(signals.withColumn("qty", qty), dated, p)
    out = out.withColumns({"fee_buy": F.when(F.col("exit").isNotNull(), ft.fee(bought, "buy", fee_profile, p)), "fee_sell": ft.fee(sold, "sell", fee_profile, p)})
    out = out.withColumn("net", sold - bought - F.col("fee_buy") - F.col("fee_sell"))
    ret = F.when(F.col("net").isNotNull(), F.coalesce(F.try_divide("net", bought) * 100, F.lit(0.0)))
    return out.withColumns({"ret_pct": ret, "fee_profile": F.lit(fee_profile)})


def net(entry: Column, exit_: Column, qty: Column, profile: str, p: Params = Params()) -> Column:
    """Profit of a closed trade after both fees."""
    bought, sold = entry * qty, exit_ * qty
    return sold - bought - ft.fee(bought, "buy", profile, p) - ft.fee(sold, "sell", profile, p)


def trade_summary(trades: DataFrame, open_trades: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """One row for each arm: closed trades, wins, returns, net and bars held; trades: arm, net, ret_pct, bars_held.

    open_trades (arm) adds n_open; days (arm, date, equity) adds final_equity, that of the last day. An arm that
    stands in either of them has a row even without a closed trade.
    """
    out = trades.groupBy("arm").agg(
        F.count("*").alias("n_closed"),
        half_even(F.count_if(F.col("net") > 0) / F.count("*") * 100, 2).alias("win_rate_pct"),
        half_even(F.avg("ret_pct"), 4).alias("mean_ret_pct"),
        half_even(F.sum("net"), 2).alias("total_net"),
        half_even(F.avg("bars_held"), 2).alias("mean_bars_held"),
    )
    out = out.join(upper_median(trades, "arm", "ret_pct", "median").select("arm", half_even("median", 4).alias("median_ret_pct")), "arm", "left")
    zeros = ["n_closed"]
    if open_trades is not None:
        out = out.join(open_trades.groupBy("arm").agg(F.count("*").alias("n_open")), "arm", "full_outer")
        zeros.append("n_open")
    if days is not None:
        out = out.join(days.groupBy("arm").agg(F.max_by("equity", "date").alias("final_equity")), "arm", "full_outer")
    return out.fillna(0, zeros)


#: Relative rank error of the sketch that brackets a median.
MEDIAN_ACCURACY = 10_000


def upper_median(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The middle value of each group, the upper one of two; nulls don't count.

    A quantile sketch brackets the middle, whatever is below the bracket is counted, and only the bracket's
    distinct values (about 4 of MEDIAN_ACCURACY) are ranked, so no group is gathered or sorted whole.
    """
    rows = rows.select(by, value).where(F.col(value).isNotNull())
    off = 2 / MEDIAN_ACCURACY
    sketch = F.percentile_approx(value, [0.5 - off, 0.5 + off], MEDIAN_ACCURACY)
    brackets = rows.groupBy(by).agg(sketch.alias("q"), F.count("*").alias("n")).select(by, "n", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    placed = rows.join(brackets, by).where(F.col(value) <= F.col("high"))
    inside = F.when(F.col(value) >= F.col("low"), F.col(value))  # null: below the bracket
    counts = placed.groupBy(by, inside.alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(F.col("v").asc_nulls_first()))
    middle = counts.withColumn("upto", upto).where((F.col("upto") > F.floor(F.col("n") / 2)) & F.col("v").isNotNull())
    return middle.groupBy(by).agg(F.min("v").alias(name))


BOOK_SCHEMA = "arm string, profile string, kind string, date date, ticker string, sig_date date, qty long, entry double, exit double, exit_reason string, bars_held long, net double, ret_pct double, equity double, n_open long"
_KINDS = {"string": pa.string(), "date": pa.date32(), "long": pa.int64(), "double": pa.float64()}
_BOOK = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in BOOK_SCHEMA.split(", "))])


def book(qualified: DataFrame, marks: DataFrame, caps: DataFrame, decisions: DataFrame, profiles: tuple[str, ...] = ("PROD_FLAT",), p: Params = Params()) -> DataFrame:
    """The simulated book of each arm and fee profile: kind TRADE, OPEN, DAY (equity and open positions) or PICK rows.

    Selection depends on cash and open positions, so dates are taken in order; only qualified rows, which
    carry their outcome and the closes to mark them with, enter this fold. Arms and profiles run in parallel.
    qualified: arm, date, ticker, score, entry, exit_date, exit, exit_reason, bars_held. marks: ticker, date, close.
    """
    day_caps = decisions.select("date").join(caps.select("date", "cap"), "date", "left")
    # at most the caps so far are open or picked, so that many of a day's best rows are enough
    room = day_caps.withColumn("room", F.sum("cap").over(Window.orderBy("date")))
    best = Window.partitionBy("arm", "date").orderBy(F.desc("score"), "ticker")
    rows = qualified.select("arm", "date", "ticker", "score", "entry", "exit_date", "exit", "exit_reason", "bars_held")
    rows = rows.withColumn("rank", F.row_number().over(best)).join(F.broadcast(room.select("date", "room")), "date").where("rank <= room").drop("rank", "room")
    held = marks.join(rows.select("ticker").distinct(), "ticker", "left_semi")
    closes = held.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("closes"))  # a close for each decision date
    rows = rows.join(closes, "ticker")
    held = F.filter("closes", lambda c: (c["date"] >= F.col("date")) & (F.col("exit_date").isNull() | (c["date"] < F.col("exit_date"))))
    rows = rows.withColumn("closes", held)
    calendar = day_caps.agg(F.sort_array(F.collect_list(F.struct("date", "cap"))).alias("calendar"))
    rows = rows.unionByName(rows.sparkSession.createDataFrame([(a[0],) for a in p.arms], "arm string"), allowMissingColumns=True)  # an arm without candidates has days too
    rows = rows.crossJoin(F.broadcast(calendar)).withColumn("profile", F.explode(F.array(*[F.lit(x) for x in profiles])))

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        arm, profile = (k.as_py() for k in key)
        calendar = table.column("calendar")[0].as_py()
        by_day: dict = {}
        some = [SimpleNamespace(**r) for r in table.drop_columns(["calendar"]).to_pylist() if r["ticker"] is not None]
        for r in sorted(some, key=lambda r: (r.date, -r.score, r.ticker)):
            by_day.setdefault(r.date, []).append(r)
        cash, positions, out = p.capital, {}, []
        row = lambda kind, day, **x: out.append({"arm": arm, "profile": profile, "kind": kind, "date": day} | x)

        def value(day) -> float:
            return cash + sum(q * r.closes[max(0, sum(1 for c in r.closes if c["date"] <= day) - 1)]["close"] for r, q in positions.values())

        for day, cap in ((c["date"], c["cap"]) for c in calendar):
            for ticker in [t for t, (r, _) in positions.items() if r.exit_date == day]:
                r, qty = positions.pop(ticker)
                bought, sold = r.entry * qty, r.exit * qty
                fees = _fee(bought, "buy", profile, p), _fee(sold, "sell", profile, p)
                cash += sold - fees[1]
                gain = sold - bought - sum(fees)
                row("TRADE", day, ticker=ticker, sig_date=r.date, qty=qty, entry=r.entry, exit=r.exit, exit_reason=r.exit_reason, bars_held=int(r.bars_held), net=gain, ret_pct=gain / bought * 100 if bought else 0.0)
            picked = [r for r in by_day.get(day, []) if r.ticker not in positions][: int(cap)]
            equity = value(day)
            for r in picked:
                share = min(equity / p.max_positions, cash * p.cash_share)
                qty = max(0, math.floor(share / r.entry / p.lot)) * p.lot if r.entry > 0 else 0
                row("PICK", day, ticker=r.ticker, sig_date=day, qty=qty, entry=r.entry)
                if qty:
                    cash -= qty * r.entry + _fee(qty * r.entry, "buy", profile, p)
                    positions[r.ticker] = (r, qty)
            row("DAY", day, equity=round(value(day), 2), n_open=len(positions))
        for ticker, (r, qty) in positions.items():
            row("OPEN", calendar[-1]["date"], ticker=ticker, sig_date=r.date, qty=qty, entry=r.entry)
        return pa.Table.from_pylist(out, _BOOK)

    return rows.groupBy("arm", "profile").applyInArrow(fold, BOOK_SCHEMA)


def _fee(notional: float, side: str, profile: str, p: Params) -> float:
    if profile == "PROD_FLAT":
        return notional * (p.flat_fee / 2)
    return float(math.floor(notional * (p.exact_buy if side == "buy" else p.exact_sell) + 0.5))


def delta(trades: DataFrame, left: str = "B0", right: str = "B1") -> DataFrame:
    """ticker and date of the rows of either arm with side: only_<left>, only_<right> or common."""
    a = trades.where(F.col("arm") == left).select("ticker", "date", F.lit(True).alias("l")).distinct()
    b = trades.where(F.col("arm") == right).select("ticker", "date", F.lit(True).alias("r")).distinct()
    side = F.when(F.col("l") & F.col("r"), "common").when(F.col("l"), f"only_{left}").otherwise(f"only_{right}")
    return a.join(b, ["ticker", "date"], "full_outer").select("ticker", "date", side.alias("side"))
