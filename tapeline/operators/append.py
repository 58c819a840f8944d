"""Appending a batch of records to an append-only table as one job, with the outcome of each record.

The outcomes are those of appending the records one after another, in their order, where a record that is refused
leaves nothing behind:

* IDEMPOTENT: its id is there with the same digest, so it is a retry.
* CONFLICT: its id is there with another digest.
* DANGLING: it refers to a row that is not there.
* DUPLICATE: its unique key is taken by a record with another id. Keys with a null part are never taken.
* NEW: it is added.

The rules are judged by aggregates and joins over ids and keys, so a batch may be as large as the table. An id names
what a record is, its unique key and references included (an id is a hash of them), so records of one id have one key;
the order must tell records apart. References lead to other tables, or to records of earlier batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeline.ledger import sequenced

OUTCOMES = ("NEW", "IDEMPOTENT", "CONFLICT", "DUPLICATE", "DANGLING")


def _all_known(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def _with_dangling(batch: DataFrame, references: Mapping[str, DataFrame]) -> DataFrame:
    """The batch with _dangling; references: a column's targets, by their id."""
    out, lost = batch, F.lit(False)
    for k, (column, target) in enumerate(references.items()):
        there = target.select(F.col("id").alias(column)).distinct().withColumn(f"_there{k}", F.lit(True))
        out = out.join(there, column, "left")
        lost = lost | (F.col(column).isNotNull() & F.col(f"_there{k}").isNull())
    return out.withColumn("_dangling", lost).select(*batch.columns, "_dangling")


def judge(batch: DataFrame, held: DataFrame, *, order: Sequence[str], unique: Sequence[str] = (), references: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The batch with `outcome`; batch and held have id, result_digest and the columns of the unique key."""
    place = F.struct(*order)
    rows = _with_dangling(batch, references or {}).withColumn("_at", place)
    keys = list(unique)
    # the first record of each id that could be added
    first = F.min_by(F.struct("result_digest", "_at", *keys), "_at").alias("f")
    firsts = rows.where(~F.col("_dangling")).groupBy("id").agg(first).select("id", F.col("f.result_digest").alias("_digest"), F.col("f._at").alias("_first"), *[F.col(f"f.{k}") for k in keys])
    ids = rows.select("id").distinct()
    known = held.select("id", F.col("result_digest").alias("_held")).join(ids, "id", "left_semi")
    fresh = firsts.join(known, "id", "left_anti")
    if keys:
        taken = held.where(_all_known(keys)).select(*keys).distinct().withColumn("_taken", F.lit(True))
        winners = fresh.where(_all_known(keys)).groupBy(*keys).agg(F.min_by("id", "_first").alias("_winner"))
        fresh = fresh.join(taken, keys, "left").join(winners, keys, "left")
        duplicate = F.coalesce(F.col("_taken"), F.lit(False)) | F.coalesce(F.col("_winner") != F.col("id"), F.lit(False))
        fresh = fresh.withColumn("_duplicate", duplicate)
    else:
        fresh = fresh.withColumn("_duplicate", F.lit(False))
    judged = rows.join(known, "id", "left").join(fresh.select("id", "_digest", "_first", "_duplicate"), "id", "left")
    same = lambda digest: F.when(F.col("result_digest").eqNullSafe(F.col(digest)), "IDEMPOTENT").otherwise("CONFLICT")
    outcome = (
        F.when(F.col("_held").isNotNull(), same("_held"))
        .when(F.col("_first").isNull() | (F.col("_duplicate") & F.col("_dangling")), "DANGLING")
        .when(F.col("_duplicate"), "DUPLICATE")
        .when(F.col("_at") == F.col("_first"), "NEW")
        .when(F.col("_at") > F.col("_first"), same("_digest"))
        .otherwise("DANGLING")
    )
    return judged.select(*batch.columns, outcome.alias("outcome"))


def append(spark: SparkSession, path: str, batch: DataFrame, *, order: Sequence[str], unique: Sequence[str] = (), references: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Judge a batch against the table at `path`, add what is new, and return every record with its outcome and ledger_seq.

    The judged batch is written beside the table (a hidden folder of its own) before rows are added, so the outcomes
    stay what they were. New rows get the numbers after the table's highest, in the batch's order, and appear together
    when the job that writes them commits. A batch that is sent again after a failure is a retry, whatever came of it.
    The new rows are sorted in spark.checkpoint.dir, which must be set outside local mode.
    """
    schema = StructType(list(batch.schema.fields)).add("ledger_seq", "long")
    held = _table(spark, path, schema)
    last = held.agg(F.coalesce(F.max("ledger_seq"), F.lit(0))).first()[0]
    journal = f"{path}/_batches/{uuid.uuid4().hex}"
    judged = judge(batch, held, order=order, unique=unique, references=references)
    fresh = sequenced(judged.where("outcome = 'NEW'"), last, list(order))
    numbered = fresh.unionByName(judged.where("outcome <> 'NEW'").withColumn("ledger_seq", F.lit(None).cast("long")))
    numbered.write.parquet(journal)
    done = spark.read.schema(StructType(list(batch.schema.fields)).add("outcome", "string").add("ledger_seq", "long")).parquet(journal)
    done.where("outcome = 'NEW'").drop("outcome").write.mode("append").parquet(path)
    return done


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table, none if there is no such folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
