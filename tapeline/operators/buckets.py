"""The terminal bucket of a candidate as columns: one bucket, a primary reason and all reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.params import BUCKETS, Params

#: What a column that is absent or null counts as.
DEFAULTS = {
    "data_ok": True, "data_reason": "QA_V3_FAIL", "n_bars": 0, "feature_ok": True, "feature_reason": "FEATURE_FAIL", "scored": False,
    "gates_passed": True, "score": 0, "volume_pts": 0, "r20": 0.0, "overlap_open": False, "selected": False,
}


def terminal_bucket(candidates: DataFrame, p: Params = Params()) -> DataFrame:
    """candidates with bucket, primary_reason and reasons; the first rule that holds decides."""
    c = {name: F.coalesce(F.col(name), F.lit(value)) if name in candidates.columns else F.lit(value) for name, value in DEFAULTS.items()}
    gates = ((c["score"] < p.threshold_score, "BELOW_THRESHOLD"), (c["volume_pts"] <= 0, "VOLUME_GATE"), (c["r20"] < p.r20_gate, "R23_GATE"))
    failed = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in gates]), lambda x: x.isNotNull())
    one = lambda reason: F.array(reason if isinstance(reason, Column) else F.lit(reason))
    rules = (
        (~c["data_ok"], "DATA_UNUSABLE", one(c["data_reason"])),
        (c["n_bars"] < p.min_bars, "INELIGIBLE", one("INSUFFICIENT_HISTORY")),
        (~c["feature_ok"], "FEATURE_INVALID", one(c["feature_reason"])),
        (~c["scored"], "FEATURE_INVALID", one("SCORE_COMPUTE_FAIL")),
        (~c["gates_passed"], "GATE_REJECTED", F.when(F.size(failed) > 0, failed).otherwise(one("GATE_FAIL"))),
        (c["overlap_open"], "QUALIFIED_NOT_SELECTED", one("RISK_BLOCKED_OVERLAP")),
        (c["selected"], "SELECTED", one("CAP_TOP_N")),
    )
    bucket, reasons = F.lit("QUALIFIED_NOT_SELECTED"), one("CAP_BLOCKED")
    for test, name, why in reversed(rules):
        bucket, reasons = F.when(test, F.lit(name)).otherwise(bucket), F.when(test, why).otherwise(reasons)
    out = candidates.withColumns({"bucket": bucket, "reasons": reasons})
    return out.withColumn("primary_reason", F.get("reasons", F.lit(0)))


def bucket_counts(assigned: DataFrame) -> DataFrame:
    """Candidates of each bucket, zeros included."""
    domain = assigned.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    counts = assigned.groupBy("bucket").agg(F.count("*").alias("tickers"))
    return domain.join(counts, "bucket", "left").select("bucket", F.coalesce("tickers", F.lit(0)).alias("tickers"))
