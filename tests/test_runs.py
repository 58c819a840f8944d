"""Configuration, snapshots, runs, reports and the stream, end to end on a small database."""

import datetime as dt
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tapeline import config as cfg
from tapeline import report
from tapeline.params import Params
from tapeline.plans import runs
from tapeline.sources import bars as src
from tapeline.sources import snapshot as snap
from tapeline.streaming.daily_bars import daily_bars

TEXT = """
project: x   # a name
config_version: 1
mode: REPLAY
enabled: false
isolation:
  direct_production_read: false
  production_write: false
  network_egress: false
  external_notifications: false
  order_execution: false
  auto_promotion: false
  dedicated_worker_required: true
storage:
  input_root: /a
  output_root: /b
  ledger: /c
  input_mount_readonly: yes
run:
  single_writer: true
  publish_complete_only: true
  packages: [a, 2]
research:
  train_end: 2019-12-31
selection:
  p_min: null
  baseline_cap_on: 2
  baseline_cap_off: 1
execution:
  cash: 1.5
runtime_budget:
  cpu_limit: null
bridge:
  sources:
    - name: one
      tables:
        - name: prices
          date_column: date
        - name: "q: z"
          date_column: null
"""


def test_config():
    c = cfg.parse(TEXT)
    assert c["project"] == "x" and c["research"]["train_end"] == "2019-12-31" and c["run"]["packages"] == ["a", 2] and c["execution"]["cash"] == 1.5
    assert c["bridge"]["sources"] == [{"name": "one", "tables": [{"name": "prices", "date_column": "date"}, {"name": "q: z", "date_column": None}]}]
    assert cfg.problems(c) == [] and len(cfg.schedule_problems(c)) == 4
    c["isolation"]["network_egress"] = True
    c["selection"]["p_min"] = 0.5
    assert len(cfg.problems(c)) == 2
    with pytest.raises(cfg.ConfigError):
        cfg.parse("a: 1\n   b: 2\n")


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lab")
    start = dt.date(2026, 1, 5)
    dates = [d for d in (start + dt.timedelta(days=i) for i in range(400)) if d.weekday() < 5]
    with sqlite3.connect(folder / "ohlcv.db") as db:
        for t in ("prices", "prices_raw"):
            db.execute(f"CREATE TABLE {t} (date TEXT, ticker TEXT, open REAL, high REAL, low REAL, close REAL, volume REAL)")
            for ticker, n in (("AA", 220), ("BB", 220), ("CC", 200), ("^IHSG", 220)):
                for i, d in enumerate(dates[:n]):
                    c = 100 + (2.5 if ticker == "BB" else 0.1) * i
                    bad = ticker == "AA" and i < 10
                    db.execute(f"INSERT INTO {t} VALUES (?,?,?,?,?,?,?)", (d.isoformat(), ticker, c, 1 if bad else c + 6, 99 if bad else c - 6, c, 1e6 * (1 + i)))
        db.execute("CREATE TABLE prices_delisted (date TEXT, ticker TEXT, close REAL)")
        db.executemany("INSERT INTO prices_delisted VALUES (?,?,?)", [(d.isoformat(), "ZZ", 5.0) for d in dates[:30]])
    with sqlite3.connect(folder / "surv.db") as db:
        db.execute("CREATE TABLE delisted_final (ticker TEXT PRIMARY KEY, exit_type TEXT)")
        db.execute("INSERT INTO delisted_final VALUES ('ZZ', NULL)")
    sources = [snap.Source("idx_ohlcv", str(folder / "ohlcv.db"), (("prices", "date"), ("prices_raw", "date"), ("prices_delisted", None))), snap.Source("idx_survivorship", str(folder / "surv.db"), (("delisted_final", None),))]
    root = str(folder / "snapshots")
    os.makedirs(root)
    return folder, sources, root, snap.bridge(spark, sources, root)


def test_snapshot(spark, sealed):
    folder, sources, root, manifest = sealed
    assert manifest["status"] == "READY" and snap.verify(spark, os.path.join(root, manifest["snapshot_id"])) == []
    assert snap.bridge(spark, sources, root)["snapshot_id"] == manifest["snapshot_id"]
    s = snap.Snapshot(spark, root, manifest["snapshot_id"])
    assert s.sql("idx_ohlcv", "SELECT count(*) AS n FROM prices WHERE ticker = :t", t="CC").first().n == 200
    assert manifest["effective_cutoff"] == s.table("idx_ohlcv", "prices").agg(F.max("date")).first()[0]
    for bad in ("../x", "0" * 64):
        with pytest.raises(snap.SnapshotError):
            snap.Snapshot(spark, root, bad)
    with pytest.raises(snap.SnapshotError):
        s.table("idx_ohlcv", "secrets")
    with pytest.raises(Exception, match="no table"):
        snap.read_sqlite(spark, str(folder / "surv.db"), "nothing").count()


def test_runs(spark, sealed, tmp_path):
    _, _, root, manifest = sealed
    args = (spark, root, manifest["snapshot_id"], str(tmp_path / "ledger"), str(tmp_path / "runs"))
    first = runs.run_profile(*args)
    assert first["status"] == "PUBLISHED" and sum(first["counts"].values()) == 5 and first["counts"]["DATA_UNUSABLE"] == 1
    assert runs.run_profile(*args)["status"] == "IDEMPOTENT_HIT"
    fresh = runs.run_profile(*args, fresh=True)
    assert fresh["counts"]["PROFILE_OK_STALE_TAIL"] >= 1
    got = runs.run_replay(*args, days=30, p=Params(threshold_score=40, r20_gate=-100.0))
    assert got["status"] == "PUBLISHED" and got["run_id"] != fresh["run_id"]
    result = json.loads((tmp_path / "runs" / got["run_id"] / "result.json").read_text())
    assert result["decision_dates"] == 30 and {s["arm"] for s in result["summaries"]} == {"B0", "B1"}
    text = (tmp_path / "runs" / got["run_id"] / "report.md").read_text()
    assert text.startswith("# Replay") and "| n_open |" in text and "| final_equity |" in text and "| GATE_REJECTED |" in text and f"cut-off: {manifest['effective_cutoff']}" in text
    assert {f["arm"] for f in result["fees"]} <= {"B0", "B1"} and all(abs(f["net_exact"] - f["net_flat"] - f["difference"]) < 1e-6 for f in result["fees"])
    coverage = (tmp_path / "runs" / fresh["run_id"] / "report.md").read_text()
    assert "| AA | OHLC_VIOLATION |" in coverage and "| idx_ohlcv | prices |" in coverage and "## Stale tickers" in coverage and "- idx_survivorship: no dates" in coverage
    assert runs.preflight(cfg.parse(TEXT), root, manifest["snapshot_id"]) == [] and runs.preflight(cfg.parse(TEXT), root, "0" * 64)


def test_tampering_shows(spark, sealed):
    _, _, root, manifest = sealed
    folder = os.path.join(root, manifest["snapshot_id"])
    table = os.path.join(folder, "idx_ohlcv", "prices")
    name = next(f for f in os.listdir(table) if f.endswith(".parquet"))
    with open(os.path.join(table, name), "ab") as f:
        f.write(b"x")
    assert snap.verify(spark, folder) == [f"changed idx_ohlcv.prices/{name}"]
    moved = snap.quarantine(folder, "changed")
    assert snap.load_manifest(moved)["status"] == "QUARANTINED" and not os.path.isdir(folder)


def test_report():
    assert report.rupiah(1234567.0) == "Rp1.234.567" and report.percent(1.234) == "+1.23%" and report.percent(None) == "-"
    assert "75.0%" in report.funnel([{"status": "A", "tickers": 1}, {"status": "B", "tickers": 3}])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24, i % 60), i % 4, float(i * 7 % 31)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events.parquet")
    query = daily_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, src.from_events(spark, str(tmp_path)).collect()))
