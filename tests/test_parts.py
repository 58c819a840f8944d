"""Buckets, single trades, suspension, ledger and snapshot rules that the larger tests don't reach."""

import datetime as dt
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tapeline import config as cfg
from tapeline.canonical import environment_hash, sha256_hex
from tapeline.ledger import Ledger
from tapeline.operators import buckets, market, profile, replay
from tapeline.params import BUCKETS, Params
from tapeline.plans import runs
from tapeline.sources import snapshot as snap

D = dt.date


def test_terminal_buckets(spark):
    base = {"data_ok": True, "n_bars": 30, "feature_ok": True, "scored": True, "gates_passed": True, "score": 70, "volume_pts": 10, "r20": 40.0, "overlap_open": False, "selected": False}
    cases = [
        ({}, "QUALIFIED_NOT_SELECTED", ["CAP_BLOCKED"]),
        ({"data_ok": False, "n_bars": 1}, "DATA_UNUSABLE", ["QA_V3_FAIL"]),
        ({"n_bars": 19}, "INELIGIBLE", ["INSUFFICIENT_HISTORY"]),
        ({"feature_ok": False}, "FEATURE_INVALID", ["FEATURE_FAIL"]),
        ({"scored": False}, "FEATURE_INVALID", ["SCORE_COMPUTE_FAIL"]),
        ({"gates_passed": False, "score": 10, "volume_pts": 0, "r20": 5.0}, "GATE_REJECTED", ["BELOW_THRESHOLD", "VOLUME_GATE", "R23_GATE"]),
        ({"gates_passed": False}, "GATE_REJECTED", ["GATE_FAIL"]),
        ({"overlap_open": True, "selected": True}, "QUALIFIED_NOT_SELECTED", ["RISK_BLOCKED_OVERLAP"]),
        ({"selected": True}, "SELECTED", ["CAP_TOP_N"]),
        ({"data_ok": None, "scored": None}, "FEATURE_INVALID", ["SCORE_COMPUTE_FAIL"]),
    ]
    schema = "no int, data_ok boolean, n_bars int, feature_ok boolean, scored boolean, gates_passed boolean, score int, volume_pts int, r20 double, overlap_open boolean, selected boolean"
    rows = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _, _) in enumerate(cases)], schema)
    got = {r.no: (r.bucket, r.reasons, r.primary_reason) for r in buckets.terminal_bucket(rows).collect()}
    assert got == {i: (bucket, reasons, reasons[0]) for i, (_, bucket, reasons) in enumerate(cases)}
    bare = buckets.terminal_bucket(spark.createDataFrame([(1, 30)], "no int, n_bars int").withColumn("data_reason", F.lit("x"))).first()
    assert (bare.bucket, bare.primary_reason) == ("FEATURE_INVALID", "SCORE_COMPUTE_FAIL")
    counts = {r.bucket: r.tickers for r in buckets.bucket_counts(buckets.terminal_bucket(rows)).collect()}
    assert sorted(counts) == sorted(BUCKETS) and sum(counts.values()) == len(cases) and counts["MODEL_INVALID"] == 0


def market_days(spark, n, missing=()):
    start = D(2026, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(n)]
    bars = [("a", d, 100.0, 101.0, 99.0, 100.0, 1e6) for i, d in enumerate(days) if i not in missing]
    bars = spark.createDataFrame(bars, "ticker string, date date, open double, high double, low double, close double, volume double")
    return days, bars, spark.createDataFrame([(d, 100.0) for d in days], "date date, close double")


def test_suspension_modes(spark):
    days, bars, index = market_days(spark, 45, missing=set(range(27, 30)))
    dates = market.decision_dates(index, 20)  # days 25..44
    for mode, want in (("parity", days[27]), ("as_of", None)):
        dated = replay.dated_bars(bars, index, dates, Params(suspension_mode=mode)).where(F.col("date") == days[26]).first()
        assert dated.missing == days[27:30] and dated.gap == 18
        assert (dated.halts[0] if dated.halts else None) == want
    days, bars, index = market_days(spark, 45, missing=set(range(27, 45)))
    dates = market.decision_dates(index, 20)
    halts = replay.dated_bars(bars, index, dates, Params(suspension_mode="as_of")).where(F.col("date") == days[26]).first().halts
    assert halts == days[36:]  # ten sessions after the last bar


def test_gaps_outside_the_index(spark):
    days, bars, index = market_days(spark, 40)
    some = index.where((F.col("date") >= days[10]) & (F.col("date") < days[30]))
    got = {r.date: (r.gap, r.on_date) for r in replay.dated_bars(bars, some, market.decision_dates(some, 5)).collect()}
    assert got[days[0]] == (20, False) and got[days[10]] == (19, False) and got[days[29]] == (0, True) and got[days[39]] == (0, False)


def test_single_trades(spark):
    days, bars, index = market_days(spark, 45)
    dates = market.decision_dates(index, 20)
    dated = replay.dated_bars(bars, index, dates)
    signals = dated.where(F.col("date").isin(days[26], days[44])).select("ticker", "date", F.lit(100.0).alias("entry"), F.lit(90.0).alias("sl"), F.lit(100.5).alias("tp1"), "dec_no", "halts", "suspended")
    got = {r.date: r for r in replay.simulate(signals, dated, F.lit(200), "AJAIB_EXACT").collect()}
    closed, still_open = got[days[26]], got[days[44]]
    assert (closed.exit_reason, closed.exit, closed.bars_held, closed.qty) == ("TAKE_PROFIT_1", 100.5, 1, 200)
    fees = (int(20000 * 0.00151303 + 0.5), int(20100 * 0.00251303 + 0.5))
    assert (closed.fee_buy, closed.fee_sell) == fees and closed.net == pytest.approx(100 - sum(fees)) and closed.ret_pct == pytest.approx((100 - sum(fees)) / 200)
    assert still_open.exit_date is None and still_open.net is None and still_open.ret_pct is None


def test_trade_summary_has_arms_without_trades(spark):
    trades = spark.createDataFrame([("B0", 5.0, 1.0, 2), ("B0", -1.0, 3.0, 4)], "arm string, net double, ret_pct double, bars_held int")
    still_open = spark.createDataFrame([("B1",)], "arm string")
    days = spark.createDataFrame([("B0", D(2026, 1, 1), 1.0), ("B0", D(2026, 1, 2), 7.0), ("B1", D(2026, 1, 2), 3.0)], "arm string, date date, equity double")
    got = {r.arm: (r.n_closed, r.median_ret_pct, r.n_open, r.final_equity, r.total_net) for r in replay.trade_summary(trades, still_open, days).collect()}
    assert got == {"B0": (2, 3.0, 0, 7.0, 4.0), "B1": (0, None, 1, 3.0, None)}


@pytest.mark.parametrize("n", [1, 2, 7, 20_001])
def test_upper_median_of_many(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(n)) * 1.0).alias("v")).unionByName(spark.createDataFrame([("g", None), ("h", 2.0)], "k string, v double"))
    assert {r.k: r.m for r in replay.upper_median(rows, "k", "v", "m").collect()} == {"g": float(n // 2), "h": 2.0}


def test_profile_of_separate_panels_and_of_flagged_rows(spark):
    days, bars, index = market_days(spark, 30)
    panels = {
        "adjusted": bars,
        "raw": bars.select("ticker", "date").union(spark.createDataFrame([("b", days[0])], "ticker string, date date")),
        "close_only": spark.createDataFrame([("z", days[0], 5.0)], "ticker string, date date, close double"),
        "survivors": spark.createDataFrame([("z", None), ("y", "x")], "ticker string, exit_type string"),
    }
    calendar = market.trading_calendar(bars)
    got = {r.ticker: r for r in profile.profile(panels, calendar).collect()}
    assert sorted(got) == ["a", "y", "z"]  # raw rows alone make no ticker
    assert (got["a"].n_adj, got["a"].n_raw, got["a"].stale_tail, got["a"].missing_sessions, got["a"].span_sessions) == (30, 30, 30, 0, 30)
    assert (got["z"].n_close_only, got["z"].basis, got["z"].zero_vol) == (1, "CLOSE_ONLY_DELISTED", None) and got["y"].n_close_only == 0
    twice = {r.ticker: r for r in profile.profile(panels | {"adjusted": bars.union(bars)}, calendar).collect()}
    assert twice["a"].n_adj == 60 and twice["a"].missing_sessions == 0


def test_ledger_shows_changed_and_missing_rows(spark, tmp_path):
    root = str(tmp_path / "ledger")
    row = lambda n: {"kind": "CONFIG", "uri": f"c/{n}", "sha256": "0" * 64, "byte_length": n, "schema_version": "1", "created_by": "test"}
    with Ledger(spark, root) as ledger:
        for n in range(3):
            ledger.append("Artifact", row(n))
        assert ledger.problems() == [] and ledger.max_seq() == 3
        assert [r.seq for r in ledger.table("LedgerAppend").orderBy("seq").collect()] == [1, 2, 3]
        folder = os.path.join(root, "Artifact")
        names = sorted(os.listdir(folder))
        open(os.path.join(folder, "." + names[0]), "w").close()  # what a crash leaves behind is no row
        assert ledger.problems() == []
        with open(os.path.join(folder, names[0]), "ab") as f:
            f.write(b"x")
        assert ledger.problems() == [f"Artifact: {names[0]} was changed"]
        os.remove(os.path.join(folder, names[0]))
        assert ledger.problems() == ["LedgerAppend: numbers are missing or repeated"]


def test_bridge_checks_its_sources(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (date TEXT, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [("2026-01-01", 1.0), ("2026-01-02", None)])
    root = str(tmp_path / "snapshots")
    os.makedirs(root)
    with pytest.raises(snap.SnapshotError, match="no tables"):
        snap.bridge(spark, [snap.Source("a", str(tmp_path / "a.db"), (("nothing", None),))], root)
    assert os.listdir(root) == []
    live = sqlite3.connect(tmp_path / "a.db")
    live.execute("INSERT INTO t VALUES ('2026-01-03', 3.0)")  # not committed: not of the copy
    manifest = snap.bridge(spark, [snap.Source("a", str(tmp_path / "a.db"), (("t", "date"),))], root)
    live.close()
    assert (manifest["total_rows"], manifest["status"], manifest["effective_cutoff"]) == (2, "READY", "2026-01-02") and manifest["total_bytes"] > 0
    folder = os.path.join(root, manifest["snapshot_id"])
    assert os.listdir(root) == [manifest["snapshot_id"]] and snap.verify(spark, folder) == []
    with open(os.path.join(folder, "a", "more.parquet"), "w") as f:
        f.write("x")
    assert snap.verify(spark, folder) == ["unknown a/more.parquet"]


def test_config_rules():
    assert cfg.scalar("'a, b'") == "a, b" and cfg.scalar("[1, x, 2.5]") == [1, "x", 2.5] and cfg.scalar("[]") == [] and cfg.scalar("") is None
    assert cfg.scalar("-3") == -3 and cfg.scalar("1.5e-3") == 0.0015 and cfg.scalar("No") is False and cfg.scalar("~") is None and cfg.scalar("1.2.3") == "1.2.3"
    assert cfg.parse("a:\n  - 1\n  -\n  - b: x  # c\n    d: 2\ne:\n") == {"a": [1, None, {"b": "x", "d": 2}], "e": None}
    for bad in ("  a: 1\n", "\ta: 1\n", "a: 1\na: 2\n", "a: 1\n    b: 2\n"):
        with pytest.raises(cfg.ConfigError):
            cfg.parse(bad)
    found = cfg.problems({"project": "", "config_version": 2, "mode": "LIVE", "selection": {}})
    assert {x.split()[0] for x in found} >= {"project", "config_version", "mode", "isolation.dedicated_worker_required", "storage.ledger", "storage.input_mount_readonly", "run.single_writer"}
    assert not any("baseline" in x for x in found)  # caps that are not set have their defaults


def test_preflight_rules(spark, tmp_path):
    found = runs.preflight({}, str(tmp_path), output=str(tmp_path / "none"), ledger=str(tmp_path / "state" / "ledger"), python=(2, 7))
    assert any("python is" in x for x in found) and any("none" in x for x in found) and os.path.isdir(tmp_path / "state")
    assert environment_hash("3.11", "x") == sha256_hex(b"python=3.11;code=x")
