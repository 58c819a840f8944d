"""Runs over a snapshot: preflight, the ledger's chain of records, artifacts and publication."""

from __future__ import annotations

import json
import os
import platform
import sys
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline import config as cfg
from tapeline import report
from tapeline.canonical import canonical_json, decision_micros, environment_hash, sha256_hex
from tapeline.ledger import Ledger
from tapeline.operators import market, profile, replay
from tapeline.params import FRESHNESS_STATUSES, PROFILE_STATUSES, Params
from tapeline.sources.snapshot import Snapshot, verify
from tapeline.staging import staged

#: The market's index among the tickers.
INDEX = "^IHSG"
SECOND = 1_000_000


def preflight(config: dict, root: str, snapshot_id: str | None = None, scheduled: bool = False, *, output: str | None = None, ledger: str | None = None, python: tuple[int, int] | None = None) -> list[str]:
    """Everything that stands against a run.

    python: the version that a run is pinned to. output must be there, the ledger's folder writable, and the
    snapshots must not be (a superuser may write anywhere, so that is not held against one).
    """
    out = cfg.problems(config)
    if python and sys.version_info[:2] != python:
        out.append(f"python is {sys.version_info[0]}.{sys.version_info[1]}, not {python[0]}.{python[1]}")
    if output is not None and not os.path.isdir(output):
        out.append(f"no folder {output}")
    if ledger is not None:
        os.makedirs(os.path.dirname(os.path.abspath(ledger)), exist_ok=True)
        if not os.access(os.path.dirname(os.path.abspath(ledger)), os.W_OK):
            out.append(f"{os.path.dirname(os.path.abspath(ledger))} is not writable")
    if not os.path.isdir(root):
        return [*out, f"no folder {root}"]
    if os.geteuid() and os.access(root, os.W_OK) and output is not None:
        out.append(f"{root} is writable")
    if snapshot_id:
        folder = os.path.join(root, snapshot_id)
        out += verify(SparkSession.active(), folder) if os.path.isfile(os.path.join(folder, "manifest.json")) else [f"no snapshot {snapshot_id}"]
    return out + (cfg.schedule_problems(config) if scheduled else [])


def snapshot_panels(snapshot: Snapshot) -> dict[str, DataFrame]:
    """The profiler's panels from the snapshot's price and survivor tables."""
    prices = snapshot.table("idx_ohlcv", "prices").withColumn("date", F.to_date("date"))
    return {
        "adjusted": prices,
        "raw": snapshot.table("idx_ohlcv", "prices_raw").select("ticker", F.to_date("date").alias("date")),
        "close_only": snapshot.table("idx_ohlcv", "prices_delisted").select("ticker", F.to_date("date").alias("date"), "close"),
        "survivors": snapshot.table("idx_survivorship", "delisted_final").select("ticker", "exit_type"),
    }


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A report's few rows."""
    return [r.asDict() for r in df.collect()]


def profile_result(snapshot: Snapshot, fresh: bool, p: Params) -> tuple[dict[str, Any], str, dict[str, int]]:
    panels = snapshot_panels(snapshot)
    calendar = market.trading_calendar(panels["adjusted"], p).cache()
    found = profile.profile(panels, calendar, p).cache()
    if fresh:
        classified = profile.classify_freshness(market.tail_gap(found, calendar), p)
    else:
        classified = profile.classify_quality(found, p)
    funnel = _rows(profile.funnel(classified, FRESHNESS_STATUSES if fresh else PROFILE_STATUSES))
    unusable = classified.where("status = 'DATA_UNUSABLE'").select("ticker", F.array_join("reasons", "+").alias("reasons"), "n_adj", "n_close_only", "n_raw")
    days = calendar.agg(F.count("*").alias("sessions"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).first().asDict()
    result = {
        "universe": _rows(profile.universe_meta(panels).orderBy("panel")),
        "calendar": days,
        "funnel": funnel,
        "reasons": _rows(profile.reason_counts(classified).orderBy(F.desc("tickers"), "reason")),
        "tables": [{"dataset": d["name"], "table": t["name"]} | {k: t[k] for k in ("rows", "min_date", "max_date")} for d in snapshot.manifest["datasets"] for t in d["tables"]],
        "unusable": _rows(unusable.orderBy("ticker")),
        "stale": _rows(profile.stale_list(classified).orderBy("place")) if fresh else [],
    }
    counts = {r["status"]: r["tickers"] for r in funnel}
    known = {"snapshot": snapshot.manifest["snapshot_id"], "cut-off": snapshot.manifest["effective_cutoff"], "tickers": sum(counts.values()), "sessions": f"{days['sessions']}, {days['first']} to {days['last']}"}
    return result, report.coverage(known, result), counts


def replay_result(snapshot: Snapshot, days: int, fee_profile: str, p: Params) -> tuple[dict[str, Any], str, dict[str, int]]:
    bars = snapshot.window(p.window_days)
    index = snapshot.table("idx_ohlcv", "prices").where(F.col("ticker") == INDEX).select(F.to_date("date").alias("date"), "close")
    dates, caps = market.decision_dates(index, days).cache(), market.regime(index, p)
    if dates.isEmpty():
        raise ValueError("the snapshot has no market index")
    stocks = bars.where(~F.col("ticker").startswith("^"))
    dated = staged(replay.dated_bars(stocks, index, dates, p), "dated")
    found = replay.candidates(stocks, index, dates, p, dated).cache()
    signals = found.where("bucket = 'QUALIFIED'").select("arm", "ticker", "date", "score", "entry", "sl", "tp1", "dec_no", "halts", "suspended")
    booked = replay.book(replay.outcomes(signals, dated, p), replay.as_of(dated).select("ticker", "date", "close"), caps, dates, (fee_profile,), p).cache()
    trades = booked.where("kind = 'TRADE'")
    summaries = _rows(replay.trade_summary(trades, booked.where("kind = 'OPEN'"), booked.where("kind = 'DAY'")).orderBy("arm"))
    reasons = _rows(trades.groupBy("arm", "exit_reason").agg(F.count("*").alias("trades")))
    delta = {r["side"]: r["n"] for r in _rows(replay.delta(trades.select("arm", "ticker", F.col("sig_date").alias("date"))).groupBy("side").agg(F.count("*").alias("n")))}
    buckets = _rows(replay.bucket_average(replay.bucket_daily(replay.top_by_cap(found, caps))))
    net = {name: F.sum(replay.net(F.col("entry"), F.col("exit"), F.col("qty"), profile_, p)) for name, profile_ in (("net_flat", "PROD_FLAT"), ("net_exact", "AJAIB_EXACT"))}
    fees = _rows(trades.groupBy("arm").agg(*(total.alias(name) for name, total in net.items())).withColumn("difference", F.col("net_exact") - F.col("net_flat")))
    days_ = dates.agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last")).first()
    result = {"summaries": summaries, "exits": reasons, "delta": delta, "bucket_average": buckets, "fees": fees, "decision_dates": days_.n, "fee_profile": fee_profile}
    known = {"snapshot": snapshot.manifest["snapshot_id"], "cut-off": snapshot.manifest["effective_cutoff"], "decision dates": f"{days_.n}, {days_.first} to {days_.last}", "fees": fee_profile, "result": "simulation only"}
    counts = {f"{name}_{s['arm']}": s[column] for name, column in (("trades", "n_closed"), ("open", "n_open")) for s in summaries}
    return result, report.replay(known, summaries, reasons, delta, fees, buckets), counts


def publish(ledger: Ledger, snapshot: Snapshot, out_root: str, kind: str, session: str, compute: Callable[[], tuple[dict[str, Any], str, dict[str, int]]], spec: dict[str, Any], retry: bool = False) -> dict[str, Any]:
    """Run once for a slot and input: the same snapshot is the same run, a new one of the slot its next generation."""
    manifest, cutoff = snapshot.manifest, snapshot.manifest["effective_cutoff"]
    artifact = lambda k, uri, data: ledger.append("Artifact", {"kind": k, "uri": uri, "sha256": sha256_hex(data), "byte_length": len(data), "schema_version": "1", "created_by": "tapeline"})
    spec_id = artifact("FEATURE_SPEC", f"spec/{kind}", canonical_json(spec).encode())
    input_id = artifact("DATA_MANIFEST", f"snapshots/{manifest['snapshot_id']}", canonical_json(manifest["datasets"]).encode())
    ledger.append("RegistryEvent", {"artifact_id": input_id, "event": "REGISTERED", "actor": "tapeline", "reason": kind})
    experiment = ledger.append("Experiment", {"name": kind, "charter_artifact_id": spec_id, "config_id": spec_id, "feature_spec_id": spec_id, "universe_policy_id": spec_id, "git_commit": "", "dependency_lock_hash": platform.python_version(), "mode": "REPLAY", "research_role": "DIAGNOSTIC", "availability_mode": "OBSERVED"})
    at = decision_micros(cutoff)
    fresh_until = at + 24 * 3600 * SECOND
    slot = ledger.append("DecisionSlot", {"experiment_id": experiment, "decision_at": at, "expected_by": at + 1800 * SECOND, "entry_decision_deadline": at + 3600 * SECOND, "freshness_deadline": fresh_until, "session_id": f"{session}-{cutoff}"})
    run_id = ledger.run_of(slot, input_id)
    if run_id is None:
        environment = environment_hash(platform.python_version(), kind)
        run_id = ledger.append("Run", {"slot_id": slot, "generation": ledger.last_generation(slot) + 1, "config_id": spec_id, "universe_manifest_id": input_id, "input_manifest_id": input_id, "feature_spec_id": spec_id, "availability_mode": "OBSERVED", "ledger_cutoff_seq": 0, "evaluation_clock": "REPLAY", "price_asof": at, "decision_at": at, "git_commit": "", "environment_hash": environment, "seed": 0})
    known = ledger.publication_of(run_id)
    if known and not retry:
        return {"status": "IDEMPOTENT_HIT", "run_id": run_id, "publication": known}
    attempt = ledger.append("Attempt", {"run_id": run_id, "attempt_no": ledger.last_attempt_no(run_id) + 1, "worker_build": "tapeline", "started_at": int(time.time() * SECOND)})
    steps = iter(range(1, 9))
    event = lambda state: ledger.append("AttemptEvent", {"attempt_id": attempt, "event_no": next(steps), "state": state})
    event("STARTED")
    event("INPUT_VALIDATED")
    try:
        result, text, counts = compute()
    except Exception:
        event("FAILED")
        raise
    event("FEATURES_READY")
    event("SCORED")
    data = canonical_json(json.loads(json.dumps(result, default=str))).encode()
    report.write_whole(os.path.join(out_root, run_id), {"result.json": data, "report.md": text.encode()})
    metrics = artifact("REPORT", f"runs/{run_id}/result.json", data)
    ledger.append("Publication", {"run_id": run_id, "attempt_id": attempt, "result": "DIAGNOSTIC_ONLY", "metrics_manifest_id": metrics, "n_universe": sum(counts.values()), "disjoint_counts": json.dumps(counts, sort_keys=True), "data_asof": at, "published_at": int(time.time() * SECOND), "temporal_status": "RETROSPECTIVE", "diagnostic_reason": kind, "freshness_deadline": fresh_until})
    event("PUBLISHED")
    return {"status": "PUBLISHED", "run_id": run_id, "counts": counts}


def run_profile(spark: SparkSession, root: str, snapshot_id: str, ledger_root: str, out_root: str, fresh: bool = False, p: Params = Params(), retry: bool = False) -> dict[str, Any]:
    snapshot = Snapshot(spark, root, snapshot_id)
    kind = "FRESHNESS" if fresh else "PROFILE"
    with Ledger(spark, ledger_root) as ledger:
        return publish(ledger, snapshot, out_root, kind, kind, lambda: profile_result(snapshot, fresh, p), {"kind": kind, "params": p.__dict__ | {"arms": [list(a) for a in p.arms]}}, retry)


def run_replay(spark: SparkSession, root: str, snapshot_id: str, ledger_root: str, out_root: str, days: int = 126, fee_profile: str = "PROD_FLAT", p: Params = Params(), retry: bool = False) -> dict[str, Any]:
    snapshot = Snapshot(spark, root, snapshot_id)
    with Ledger(spark, ledger_root) as ledger:
        spec = {"kind": "REPLAY", "days": days, "fee_profile": fee_profile, "params": p.__dict__ | {"arms": [list(a) for a in p.arms]}}
        return publish(ledger, snapshot, out_root, "REPLAY", f"REPLAY-{days}-{fee_profile}", lambda: replay_result(snapshot, days, fee_profile, p), spec, retry)
