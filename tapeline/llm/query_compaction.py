"""op12: the clicks written as files and compacted, in the contract's columns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, compaction, files

#: A table of R rows has 1 + floor(R / x) rows for each of these: a lot, a file that is not small, a group at most.
LOT, SMALL, MOST = 150, 600, 500
_DDL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
_RESULT = pa.schema(
    [(c, pa.int64()) for c in ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents")]
    + [(c, pa.string()) for c in ("sources", "ids_sha256", "columns", "path")]
    + [("rewritten", pa.bool_())]
)


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark).rstrip('/')}/clicks-{uuid.uuid4().hex}"
    return compact_clicks(spark.read.parquet(f"{sf_dir}/clicks.parquet"), path)


def day_of(column: str) -> Column:
    """Whole days since 1970."""
    return F.unix_date(F.to_date(column)).cast("long")


def compact_clicks(clicks: DataFrame, path: str) -> DataFrame:
    """Clicks by day of arrival, lot and piece; a null arrival is a day of its own, and a null id hashes as an empty text."""
    spark, names = clicks.sparkSession, clicks.columns
    known = F.coalesce(day_of("arrived_at"), F.lit(compaction.NO_DAY))
    day, lots = compaction.spare(("day", "lots"), names)
    per_day = common.stage(clicks.groupBy(known.alias(day)).agg(F.count("*").alias("r")), "days")
    total, days = per_day.agg(F.coalesce(F.sum("r"), F.lit(0)), F.count("*")).first()
    share = lambda x: 1 + total // x
    # days of share(LOT) rows or more have several lots; they are fewer than LOT, so they can be broadcast
    large = per_day.where(F.col("r") >= share(LOT)).select(day, F.expr(f"1 + r div {share(LOT)}").alias(lots))
    several = large.agg(F.coalesce(F.sum(lots), F.lit(0))).first()[0]
    rows = clicks.withColumn(day, known).join(F.broadcast(large), day, "left").withColumn(lots, F.coalesce(lots, F.lit(1)))
    h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary"))
    lot, piece = F.shiftright(h, 4) % F.col(lots), F.least(h % 4, F.shiftright(h, 2) % 4)
    n = common.partitions(spark)
    compaction.write_files(rows, path, names, (day_of("arrived_at"), lot, piece), ["arrived_at", "click_id"], max(n, min(4 * n, 4 * (days + several))))
    common.discard(per_day)
    return digests(compaction.compact(spark, path, names, small=share(SMALL), most=share(MOST)))


def _digest(path: str) -> dict:
    """What a final file holds, read in batches. Values that are null or not finite count as 0 cents, null ids as empty texts."""
    sha, n, low, high, cents = hashlib.sha256(), 0, None, None, 0
    fs, at = files.resolve(path)
    with fs.open_input_file(at) as raw:
        source = pq.ParquetFile(raw)
        for batch in source.iter_batches(compaction.BATCH_ROWS, columns=["click_id", "value"]):
            ids, value = batch.column("click_id"), batch.column("value").fill_null(0.0).to_numpy()
            sha.update(b"," * bool(n) + ",".join("" if x is None else str(x) for x in ids.to_pylist()).encode())
            n += len(ids)
            ends = pc.min_max(ids).as_py()
            low, high = (f((x for x in (a, b) if x is not None), default=None) for f, a, b in ((min, low, ends["min"]), (max, high, ends["max"])))
            value = np.where(np.isfinite(value), value, 0.0)
            cents += sum(map(int, np.floor(100 * value + 0.5).tolist()))
        columns = ",".join(source.schema_arrow.names)
    return {"n_rows": n, "min_click_id": low, "max_click_id": high, "cents": cents, "ids_sha256": sha.hexdigest(), "columns": columns}


def digests(found: DataFrame) -> DataFrame:
    """The contract's row for every final file, read back from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r | _digest(r["path"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _RESULT], schema=_RESULT)
        common.give_back()

    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("-", s["lot"], s["piece"])), ",")
    rows = found.withColumn("sources", sources).repartition(common.partitions(found.sparkSession, 16))
    return rows.mapInArrow(run, ", ".join(f"{f.name} {_DDL[f.type]}" for f in _RESULT))
