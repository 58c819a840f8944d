"""Append-only ledger of runs as Parquet datasets, with ids that follow from content.

Rows are only ever added. A row whose id is known with the same digest is a retry and changes nothing; with
another digest it is an error, as are repeated unique keys and references to rows that are not there. One
writer at a time holds the lock; every append takes the next number of one global sequence. A row and its
number are one file, which appears by rename, so an append is there or not. Files are named by number and
content: a file that was changed, or that is gone, shows.
"""

from __future__ import annotations

import fcntl
import json
import os
import re
import time
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapeline.canonical import canonical_id, canonical_json, sha256_hex
from tapeline.staging import staged

_ROW_FILE = re.compile(r"\d{12}-[0-9a-f]{64}\.parquet")

# The ledger's tables and columns, their references and unique keys.
PREFIX = "id string, ledger_seq long, recorded_at long, identity_payload string, result_digest string"
TABLES = {
    "Artifact": "kind string, uri string, sha256 string, byte_length long, schema_version string, created_by string",
    "RegistryEvent": "artifact_id string, event string, actor string, reason string, evidence_artifact_id string, supersedes_id string",
    "Experiment": "name string, charter_artifact_id string, config_id string, feature_spec_id string, universe_policy_id string, target_spec_id string, execution_policy_id string, parent_experiment_id string, availability_policy_id string, git_commit string, dependency_lock_hash string, mode string, research_role string, availability_mode string",
    "TargetSpec": "strategy_version_id string, entry_policy_id string, exit_policy_id string, cost_policy_id string, corporate_action_policy_id string, reference_size_policy_id string, participation_limit double, tick_lot_policy_id string, entry_window string, outcome_horizon string, label_definition string, maturity_policy_id string, reference_shares long, reference_notional long",
    "DecisionSlot": "experiment_id string, decision_at long, expected_by long, entry_decision_deadline long, freshness_deadline long, session_id string",
    "SelectionContext": "paper_book_id string, book_state_artifact_id string, book_state_hash string, book_version long, global_ledger_cutoff_seq long, reservation_cutoff_seq long, portfolio_asof long, sizing_policy_id string",
    "Run": "slot_id string, generation long, config_id string, universe_manifest_id string, input_manifest_id string, feature_spec_id string, model_id string, calibrator_id string, availability_mode string, ledger_cutoff_seq long, evaluation_clock string, paper_book_id string, selection_context_id string, price_asof long, decision_at long, git_commit string, environment_hash string, seed long",
    "Attempt": "run_id string, attempt_no long, worker_build string, started_at long, resume_checkpoint_id string",
    "AttemptEvent": "attempt_id string, event_no long, state string, error_code string, details_artifact_id string",
    "Checkpoint": "attempt_id string, stage string, partition_key string, step long, completed_through string, input_hash string, config_hash string, output_artifact_id string, state_artifact_id string",
    "Candidate": "run_id string, subject_id string, universe_ordinal long, instrument_version_id string, price_snapshot_id string",
    "FeatureSnapshot": "candidate_id string, feature_spec_id string, feature_values_artifact_id string, lineage_manifest_id string, value_status_counts string, max_input_available_at long, feature_hash string",
    "Prediction": "candidate_id string, feature_snapshot_id string, model_id string, head_manifest_id string, target_spec_id string, status string, raw_score double, p_fill double, p_profit_given_fill double, expected_net_return double, downside double, downside_definition string, return_conditioning string, invalid_reason string, score_semantics string",
    "CandidateDecision": "candidate_id string, feature_snapshot_id string, prediction_id string, terminal_bucket string, primary_reason string, gate_results_artifact_id string, pre_gate_rank long, qualified_rank long, tie_break_key string, sizing_plan_artifact_id string",
    "OutcomeVersion": "candidate_id string, target_spec_id string, execution_policy_id string, evaluation_data_manifest_id string, corporate_action_manifest_id string, status string, label_available_at long, entry_at long, exit_at long, gross_return double, net_return double, exit_reason string, calculation_code_id string, supersedes_id string",
    "PaperBook": "experiment_id string, policy_id string, currency string, money_scale long, mode string, initial_capital long",
    "PaperOrder": "book_id string, candidate_decision_id string, client_key string, side string, requested_qty long, qty_unit string, lot_size long, order_policy_id string, submitted_at long",
    "ReservationEvent": "book_id string, order_id string, event_key string, event string, qty long, cash_amount long, risk_amount long, expected_book_version long",
    "PaperLedgerEvent": "book_id string, order_id string, position_id string, event_key string, event_type string, event_at long, qty_delta long, cash_delta long, fill_price long, fee_amount long, reference_price long, market_data_version_id string, action_artifact_id string, action_type string, action_stage string, receivable_delta long, fractional_entitlement_num long, fractional_entitlement_den long, supersedes_event_id string",
    "Publication": "run_id string, attempt_id string, result string, candidate_manifest_id string, decision_manifest_id string, metrics_manifest_id string, n_universe long, disjoint_counts string, data_asof long, published_at long, temporal_status string, diagnostic_reason string, freshness_deadline long",
}
APPENDS = "seq long, table_name string, row_id string, recorded_at long"
UNIQUE = {
    "Run": ("slot_id", "generation"),
    "Attempt": ("run_id", "attempt_no"),
    "AttemptEvent": ("attempt_id", "event_no"),
    "Checkpoint": ("attempt_id", "stage", "partition_key", "step"),
    "Candidate": ("run_id", "subject_id"),
    "PaperOrder": ("book_id", "client_key"),
    "ReservationEvent": ("book_id", "event_key"),
    "PaperLedgerEvent": ("book_id", "event_key"),
    "Publication": ("run_id",),
}
REFERENCES = {
    "RegistryEvent": {"artifact_id": "Artifact"},
    "Experiment": {"charter_artifact_id": "Artifact", "config_id": "Artifact", "feature_spec_id": "Artifact", "universe_policy_id": "Artifact"},
    "DecisionSlot": {"experiment_id": "Experiment"},
    "Run": {"slot_id": "DecisionSlot", "config_id": "Artifact", "universe_manifest_id": "Artifact", "input_manifest_id": "Artifact", "feature_spec_id": "Artifact"},
    "Attempt": {"run_id": "Run"},
    "AttemptEvent": {"attempt_id": "Attempt"},
    "Checkpoint": {"attempt_id": "Attempt", "output_artifact_id": "Artifact"},
    "Candidate": {"run_id": "Run"},
    "FeatureSnapshot": {"candidate_id": "Candidate"},
    "Prediction": {"candidate_id": "Candidate", "feature_snapshot_id": "FeatureSnapshot"},
    "CandidateDecision": {"candidate_id": "Candidate"},
    "OutcomeVersion": {"candidate_id": "Candidate", "target_spec_id": "TargetSpec"},
    "PaperBook": {"experiment_id": "Experiment", "policy_id": "Artifact"},
    "PaperOrder": {"book_id": "PaperBook", "candidate_decision_id": "CandidateDecision"},
    "ReservationEvent": {"book_id": "PaperBook", "order_id": "PaperOrder"},
    "PaperLedgerEvent": {"book_id": "PaperBook"},
    "Publication": {"run_id": "Run", "attempt_id": "Attempt"},
}
#: Columns that say when something happened and so don't make a row another one.
NOT_IDENTITY = {"Attempt": {"started_at", "resume_checkpoint_id"}}
ATTEMPT_STATES = ("STARTED", "INPUT_VALIDATED", "FEATURES_READY", "SCORED", "DECIDED", "PUBLISHED", "FAILED", "CANCELLED")
#: What a retried publication must repeat.
PUBLICATION_DIGEST = ("result", "n_universe", "disjoint_counts", "data_asof", "temporal_status", "metrics_manifest_id", "diagnostic_reason")


class LedgerIntegrityError(RuntimeError):
    pass


class WriterLockHeld(RuntimeError):
    pass


def sequenced(rows: DataFrame, start: int, order: Sequence[str | Column], parts: int = 64) -> DataFrame:
    """rows with ledger_seq = start + 1, start + 2, ... in the given order.

    The rows are sorted by ranges; only the sizes of the ranges are summed in one place. The bounds of the ranges come
    from a sample, which another evaluation would take anew, so the sorted rows are written once, and both the sizes
    and the rows are read from there.
    """
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    numbered = staged(ranged, "sequenced").withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("ledger_seq", F.col("_before") + F.col("_i") + start + 1).drop("_m", "_p", "_i", "_before")


def unique_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, column: str, target: DataFrame) -> DataFrame:
    """Rows whose reference has no target; null refers to nothing."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col("id").alias(column)), column, "left_anti")


class Ledger:
    """The ledger below a folder of the driver's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        os.makedirs(self.root, exist_ok=True)
        self._lock = open(os.path.join(self.root, "writer.lock"), "w")  # noqa: SIM115  held as long as the ledger is open
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            self._lock.close()
            raise WriterLockHeld(self.root) from e

    def close(self) -> None:
        if not self._lock.closed:
            fcntl.flock(self._lock, fcntl.LOCK_UN)
            self._lock.close()

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def _path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(APPENDS if table == "LedgerAppend" else f"{PREFIX}, {TABLES[table]}")

    def table(self, table: str) -> DataFrame:
        """All rows of a table; LedgerAppend has the number of every row of all tables."""
        if table == "LedgerAppend":
            parts = [self.table(t).select(F.col("ledger_seq").alias("seq"), F.lit(t).alias("table_name"), F.col("id").alias("row_id"), "recorded_at") for t in TABLES if os.path.isdir(self._path(t))]
            return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], self.schema(table)))
        schema = self.schema(table)
        if not os.path.isdir(self._path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _files(self) -> list[tuple[int, str, str]]:
        """Number, table and name of every row's file."""
        return sorted((int(name.split("-")[0]), t, name) for t in TABLES if os.path.isdir(self._path(t)) for name in os.listdir(self._path(t)) if _ROW_FILE.fullmatch(name))

    def max_seq(self) -> int:
        return max((seq for seq, _, _ in self._files()), default=0)

    def _write(self, table: str, row: Mapping[str, Any]) -> None:
        """Add a row's file: written aside, synced, and renamed."""
        schema = to_arrow_schema(self.schema(table))
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_pylist([dict(row)], schema), sink)
        data = sink.getvalue().to_pybytes()
        folder = self._path(table)
        os.makedirs(folder, exist_ok=True)
        name = f"{row['ledger_seq']:012d}-{sha256_hex(data)}.parquet"
        with open(os.path.join(folder, f".{name}"), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.rename(os.path.join(folder, f".{name}"), os.path.join(folder, name))

    def identity(self, table: str, record: Mapping[str, Any]) -> dict[str, Any]:
        if table == "Publication":
            return {"run_id": record["run_id"]}
        names = StructType.fromDDL(TABLES[table]).names
        return {c: record.get(c) for c in names if c not in NOT_IDENTITY.get(table, ())}

    def append(self, table: str, record: Mapping[str, Any], now: int | None = None) -> str:
        """Add a record and return its id; a retry returns the id of the row that is there."""
        if table not in TABLES:
            raise LedgerIntegrityError(f"no table {table}")
        names = StructType.fromDDL(TABLES[table]).names
        if unknown := set(record) - set(names):
            raise LedgerIntegrityError(f"{table} has no columns {sorted(unknown)}")
        identity = self.identity(table, record)
        row_id = canonical_id(identity)
        digest = canonical_id({c: record.get(c) for c in PUBLICATION_DIGEST} if table == "Publication" else identity)
        held = self.table(table)
        known = held.where(F.col("id") == row_id).select("result_digest").first()
        if known:
            if known[0] != digest:
                raise LedgerIntegrityError(f"{table} {row_id}: another result is recorded")
            return row_id
        if table == "AttemptEvent" and record.get("state") not in ATTEMPT_STATES:
            raise LedgerIntegrityError(f"no state {record.get('state')}")
        if keys := UNIQUE.get(table):
            if not held.where(_equal(keys, record)).isEmpty():
                raise LedgerIntegrityError(f"{table}: {keys} is taken")
        for column, target in REFERENCES.get(table, {}).items():
            if record.get(column) is not None and self.table(target).where(F.col("id") == record[column]).isEmpty():
                raise LedgerIntegrityError(f"{table}.{column}: {target} {record[column]} is not there")
        seq, at = self.max_seq() + 1, int(time.time() * 1e6) if now is None else now
        values = {c: json.dumps(v, sort_keys=True) if isinstance(v := record.get(c), dict | list) else v for c in names}
        row = {"id": row_id, "ledger_seq": seq, "recorded_at": at, "identity_payload": canonical_json(identity), "result_digest": digest} | values
        self._write(table, row)
        return row_id

    def problems(self) -> list[str]:
        """Files and numbers that don't hold; where files do, also unique keys and references."""
        out, files = [], self._files()
        for _, table, name in files:
            with open(os.path.join(self._path(table), name), "rb") as f:
                if sha256_hex(f.read()) != name.split("-")[1].removesuffix(".parquet"):
                    out.append(f"{table}: {name} was changed")
        if [seq for seq, _, _ in files] != list(range(1, len(files) + 1)):
            out.append("LedgerAppend: numbers are missing or repeated")
        if out:
            return out
        for table, keys in UNIQUE.items():
            if not unique_violations(self.table(table), keys).isEmpty():
                out.append(f"{table}: repeated {keys}")
        for table, columns in REFERENCES.items():
            out += [f"{table}.{c}: dangling" for c, target in columns.items() if not dangling(self.table(table), c, self.table(target)).isEmpty()]
        return out

    def get(self, table: str, **equal: Any) -> list[dict[str, Any]]:
        """Rows with these values, in ledger order."""
        found = self.table(table).where(_equal(tuple(equal), equal)) if equal else self.table(table)
        return [r.asDict() for r in found.orderBy("ledger_seq").collect()]

    def publication_of(self, run_id: str) -> dict[str, Any] | None:
        return next(iter(self.get("Publication", run_id=run_id)), None)

    def run_of(self, slot_id: str, manifest_id: str) -> str | None:
        """The newest run of a slot over this input."""
        rows = self.get("Run", slot_id=slot_id, input_manifest_id=manifest_id)
        return rows[-1]["id"] if rows else None

    def last_generation(self, slot_id: str) -> int:
        return max((r["generation"] for r in self.get("Run", slot_id=slot_id)), default=0)

    def last_attempt_no(self, run_id: str) -> int:
        return max((r["attempt_no"] for r in self.get("Attempt", run_id=run_id)), default=0)

    def recent_publications(self, limit: int = 20) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.table("Publication").orderBy(F.desc("ledger_seq")).limit(limit).collect()]

    def status(self) -> DataFrame:
        """Rows of each table and the last sequence number of all."""
        return self.table("LedgerAppend").groupBy("table_name").agg(F.count("*").alias("row_count"), F.max("seq").alias("last_seq"))


def _equal(columns: Sequence[str], values: Mapping[str, Any]):
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).eqNullSafe(F.lit(values.get(c)))
    return test
