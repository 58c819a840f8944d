"""Calendar, freshness, buckets, the book and the ledger on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapeline.canonical import canonical_json, iso_from_micros, micros_from_iso
from tapeline.ledger import Ledger, LedgerIntegrityError, WriterLockHeld, dangling, sequenced, unique_violations
from tapeline.operators import market, profile, replay
from tapeline.params import BUCKETS, Params
from tapeline.plans.queries import QUERIES
from tapeline.plans.sql import SQL

D = dt.date


def days(*numbers):
    return [D(2026, 9, n) for n in numbers]


def test_tail_gap(spark):
    sessions = [d for d in (D(2026, 9, 1) + dt.timedelta(days=i) for i in range(23)) if d.weekday() < 5]
    calendar = spark.createDataFrame([(d,) for d in sessions], "date date")
    lasts = {"a": D(2026, 9, 23), "b": D(2026, 9, 16), "c": D(2026, 9, 1), "d": D(2026, 9, 5), "e": D(2025, 1, 1), "f": D(2026, 9, 30), "g": None}
    got = market.tail_gap(spark.createDataFrame(list(lasts.items()), "ticker string, last date"), calendar)
    assert {r.ticker: r.tail_gap for r in got.collect()} == {"a": 0, "b": 5, "c": 16, "d": 13 - 1 if len(sessions) == 16 else 13, "e": None, "f": None, "g": None}


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_calendar_equals_plain_count(spark, share):
    rng = random.Random(3)
    start = D(2026, 1, 1)
    rows = [(start + dt.timedelta(days=i), f"t{t}") for i in range(40) for t in range(8) if rng.random() < 0.3 + 0.05 * t and i % 9]
    p = Params(calendar_window=7, min_active_pct=share)
    got = {r.date: (r.have, r.active) for r in market.trading_calendar(spark.createDataFrame(rows, "date date, ticker string"), p).collect()}
    seen = sorted({d for d, _ in rows})
    want = {}
    for i, d in enumerate(seen):
        active = {t for x, t in rows if x in seen[max(0, i - 6) : i + 1]}
        have = {t for x, t in rows if x == d}
        if not active or len(have) >= share * len(active):
            want[d] = (len(have), len(active))
    assert got == want


def test_stale_tail_treats_null_as_equal(spark):
    rows = [("a", D(2026, 1, i + 1), c) for i, c in enumerate([1.0, 2.0, 2.0])] + [("b", D(2026, 1, i + 1), c) for i, c in enumerate([1.0, None, None])]
    got = profile.stale_tail(spark.createDataFrame(rows, "ticker string, date date, close double"))
    assert {r.ticker: r.stale_tail for r in got.collect()} == {"a": 2, "b": 2}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0)], "k string, v double")
    assert replay.upper_median(df, "k", "v", "m").first().m == 3.0


def scenario(spark, seed):
    rng = random.Random(seed)
    start = D(2026, 1, 1)
    rows = []
    for t in range(6):
        price = 100.0
        for i in range(45):
            if rng.random() < 0.12:
                continue
            price *= 1 + rng.uniform(-0.06, 0.09)
            o, c = price * rng.uniform(0.97, 1.03), price
            rows.append((f"t{t}", start + dt.timedelta(days=i), o, max(o, c) * rng.uniform(1, 1.04), min(o, c) * rng.uniform(0.96, 1), c, rng.choice([1e6, 3e6])))
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    index = spark.createDataFrame([(start + dt.timedelta(days=i), 100.0) for i in range(45)], "date date, close double")
    return rows, bars, index


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_day_by_day_walk(spark, seed):
    rows, bars, index = scenario(spark, seed)
    p = Params(min_avg_value=1e6, threshold_score=40, r20_gate=-1000.0)
    dates, caps = market.decision_dates(index, 20), market.regime(index, p)
    found = replay.candidates(bars, index, dates, p).cache()
    good = found.where("bucket = 'QUALIFIED'").select("arm", "ticker", "date", "score", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    dated = replay.dated_bars(bars, index, dates, p)
    booked = replay.book(replay.outcomes(good, dated, p), replay.as_of(dated).select("ticker", "date", "close"), caps, dates, ("PROD_FLAT",), p).collect()
    by = {(r[0], r[1]): r for r in rows}
    all_days, decisions = sorted({r[0] for r in index.collect()}), sorted(r.date for r in dates.collect())
    for arm in ("B0", "B1"):
        signals = {}
        for r in good.where(F.col("arm") == arm).collect():
            signals.setdefault(r.date, []).append(r)
        cash, held, trades = p.capital, [], []
        close_at = lambda t, d: by[t, max(x for y, x in by if y == t and x <= d)][5]
        for d in decisions:
            for pos in list(held):
                bar, price, why = by.get((pos["t"], d)), None, None
                if bar:
                    pos["last"], pos["n"] = bar[5], pos["n"] + 1
                    for test, name, at in ((bar[2] >= pos["tp1"], "TP_GAP", bar[2]), (bar[2] <= pos["sl"], "SL_GAP", bar[2]), (bar[4] <= pos["sl"], "STOP_LOSS", pos["sl"]), (bar[3] >= pos["tp1"], "TAKE_PROFIT_1", pos["tp1"]), (pos["n"] >= 10, "TIME_EXIT", bar[5])):
                        if test:
                            price, why = at, name
                            break
                elif sum(x > max(x for y, x in by if y == pos["t"] and x <= d) for x in all_days) >= 10:
                    price, why = pos["last"], "TIME_EXIT_SUSPENDED"
                if why:
                    held.remove(pos)
                    cash += pos["q"] * price * (1 - 0.002)
                    trades.append((pos["t"], pos["d"], d, why, pos["q"], pos["n"]))
            equity = cash + sum(x["q"] * close_at(x["t"], d) for x in held)
            free = [s for s in sorted(signals.get(d, []), key=lambda s: (-s.score, s.ticker)) if s.ticker not in {x["t"] for x in held}]
            for s in free[:3]:
                q = int(min(equity / 3, cash * 0.98) / s.entry // 100) * 100
                if q > 0:
                    cash -= q * s.entry * 1.002
                    held.append({"t": s.ticker, "d": d, "q": q, "sl": s.sl, "tp1": s.tp1, "n": 0, "last": s.entry})
        got = [(r.ticker, r.sig_date, r.date, r.exit_reason, r.qty, r.bars_held) for r in booked if r.kind == "TRADE" and r.arm == arm]
        assert sorted(got) == sorted(trades)
        assert len(trades) > 3
        assert sum(r.kind == "OPEN" and r.arm == arm for r in booked) == len(held)


def test_buckets_cover_every_ticker(spark):
    _, bars, index = scenario(spark, 5)
    p = Params(min_avg_value=1e6, threshold_score=40, r20_gate=-1000.0)
    daily = replay.bucket_daily(replay.top_by_cap(replay.candidates(bars, index, market.decision_dates(index, 5), p), market.regime(index, p))).collect()
    assert len(daily) == 10 and all(sum(r[b] for b in BUCKETS) == 6 for r in daily)


def test_arm_without_candidates_has_days(spark):
    _, bars, index = scenario(spark, 5)
    p = Params(min_avg_value=1e18)
    dates = market.decision_dates(index, 5)
    dated = replay.dated_bars(bars, index, dates, p)
    none = replay.candidates(bars, index, dates, p).where("bucket = 'QUALIFIED'").select("arm", "ticker", "date", "score", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    rows = replay.book(replay.outcomes(none, dated, p), replay.as_of(dated).select("ticker", "date", "close"), market.regime(index, p), dates, ("PROD_FLAT",), p).collect()
    assert {r.kind for r in rows} == {"DAY"} and len(rows) == 10


def artifact(n):
    return {"kind": "CONFIG", "uri": f"c/{n}", "sha256": "0" * 64, "byte_length": n, "schema_version": "1", "created_by": "test"}


def test_ledger(spark, tmp_path):
    with Ledger(spark, str(tmp_path / "ledger")) as ledger:
        with pytest.raises(WriterLockHeld):
            Ledger(spark, str(tmp_path / "ledger"))
        a = ledger.append("Artifact", artifact(1))
        assert ledger.append("Artifact", artifact(1)) == a and ledger.max_seq() == 1
        experiment = ledger.append("Experiment", {"name": "x", "charter_artifact_id": a, "config_id": a, "feature_spec_id": a, "universe_policy_id": a, "mode": "REPLAY"})
        slot = ledger.append("DecisionSlot", {"experiment_id": experiment, "decision_at": 1, "session_id": "s"})
        run = {"slot_id": slot, "generation": 1, "config_id": a, "universe_manifest_id": a, "input_manifest_id": a, "feature_spec_id": a, "seed": 0}
        run_id = ledger.append("Run", run)
        with pytest.raises(LedgerIntegrityError):
            ledger.append("Run", run | {"seed": 1})
        with pytest.raises(LedgerIntegrityError):
            ledger.append("Attempt", {"run_id": "nobody", "attempt_no": 1})
        attempt = ledger.append("Attempt", {"run_id": run_id, "attempt_no": 1, "worker_build": "w", "started_at": 5})
        assert ledger.append("Attempt", {"run_id": run_id, "attempt_no": 1, "worker_build": "w", "started_at": 9}) == attempt
        published = {"run_id": run_id, "attempt_id": attempt, "result": "VALID_EMPTY", "n_universe": 3, "disjoint_counts": {"PROFILE_OK": 3}, "data_asof": 1, "published_at": 2, "temporal_status": "RETROSPECTIVE", "freshness_deadline": 3}
        first = ledger.append("Publication", published)
        assert ledger.append("Publication", published | {"published_at": 99}) == first
        with pytest.raises(LedgerIntegrityError):
            ledger.append("Publication", published | {"n_universe": 4})
        assert ledger.run_of(slot, a) == run_id and ledger.last_generation(slot) == 1 and ledger.publication_of(run_id)["n_universe"] == 3
        assert ledger.problems() == []


def test_ledger_queries(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(1000)], "no long, k long")
    got = sequenced(rows, 10, ["no"], parts=5).orderBy("no").collect()
    assert [r.ledger_seq for r in got] == list(range(11, 1011))
    assert unique_violations(rows, ["k"]).count() == 7
    assert dangling(rows, "k", spark.createDataFrame([(0,), (1,)], "id long")).where("k < 2").isEmpty()


def test_sequence_over_sampled_ranges(spark):
    """More rows than the bounds of the ranges are sampled from: sizes and rows must come from the same ranges."""
    rows = spark.range(40_000, numPartitions=2).select((F.col("id") * 7919 % 40_009).alias("no"), F.col("id").cast("string").alias("text"))
    got = sequenced(rows, 10, ["no"], parts=8).orderBy("no").collect()
    assert [r.no for r in got] == sorted(i * 7919 % 40_009 for i in range(40_000)) and [r.ledger_seq for r in got] == list(range(11, 40_011))
    assert all(int(r.text) * 7919 % 40_009 == r.no for r in got)


def test_ledger_seq_equals_its_sql(spark, tmp_path):
    """Negative, repeated and missing keys, in more rows than the bounds of the ranges are sampled from."""
    duckdb = pytest.importorskip("duckdb")
    key = F.when(F.col("id") % 1000 != 0, F.col("id") * 7919 % 40_009 - 20_000)
    orders = spark.range(40_000, numPartitions=1).select(key.alias("o_orderkey"), F.lit(1).alias("o_custkey"))
    orders.union(orders.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = db.execute(SQL["ledger_seq"]).fetchall()
    got = [tuple(r) for r in QUERIES["ledger_seq"](spark, str(tmp_path)).collect()]
    assert len(want) == 40_050 and sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_canonical():
    assert canonical_json({"b": 1, "a": [2, "é"]}) == '{"a":[2,"é"],"b":1}'
    with pytest.raises(ValueError):
        canonical_json({"a": [float("nan")]})
    assert iso_from_micros(micros_from_iso("2026-01-05T01:00:00Z")) == "2026-01-05T01:00:00+00:00"
