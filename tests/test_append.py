"""Set-wise appends against appending one record after another."""

import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import append as ap

SCHEMA = "no long, id string, result_digest string, a string, b long, ref string"


def one_by_one(batch, held, targets, unique):
    """Outcomes by a plain loop over the records in their order."""
    there = {r[1]: r[2] for r in held}
    keys = {tuple(r[3:5]) for r in held}
    out = {}
    for no, rid, digest, a, b, ref in sorted(batch):
        if rid in there:
            out[no] = "IDEMPOTENT" if there[rid] == digest else "CONFLICT"
        elif ref is not None and ref not in targets:
            out[no] = "DANGLING"
        elif unique and a is not None and b is not None and (a, b) in keys:
            out[no] = "DUPLICATE"
        else:
            out[no] = "NEW"
            there[rid] = digest
            keys.add((a, b))
    return out


def records(rng, n, start=0):
    out = []
    for k in range(n):
        a, b = rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None, *range(10, 16)])
        version = rng.randrange(2)
        ref = rng.choice([None, "r1", "r2", "gone"])
        rid = f"{a}/{b}/{version}/{ref}"  # the key and the reference are of the id
        out.append((start + k, rid, rng.choice(["d1", "d1", "d1", "d2"]), a, b, ref))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("unique", [("a", "b"), ()])
def test_outcomes_are_those_of_a_sequence(spark, tmp_path, seed, unique):
    rng = random.Random(seed)
    targets = spark.createDataFrame([("r1",), ("r2",), ("r2",)], "id string")
    path, held, seq = str(tmp_path / "table"), [], 0
    for k in range(2):
        batch = records(rng, 150, 1000 * k)
        frame = spark.createDataFrame(batch, SCHEMA).repartition(3)
        got = ap.append(spark, path, frame, order=["no"], unique=unique, references={"ref": targets}).collect()
        want = one_by_one(batch, held, {"r1", "r2"}, unique)
        assert {r.no: r.outcome for r in got} == want and set(want.values()) >= ({"NEW", "IDEMPOTENT", "CONFLICT", "DANGLING"} | ({"DUPLICATE"} if unique else set()))
        fresh = sorted(r.no for r in got if r.outcome == "NEW")
        assert {r.no: r.ledger_seq for r in got if r.ledger_seq is not None} == {no: seq + 1 + i for i, no in enumerate(fresh)}
        held, seq = held + [r for r in batch if r[0] in set(fresh)], seq + len(fresh)
    rows = spark.read.parquet(path)
    assert sorted(r.no for r in rows.collect()) == sorted(r[0] for r in held) and rows.select("ledger_seq").distinct().count() == seq
    again = ap.append(spark, path, spark.createDataFrame([r for r in held if r[2] == "d1"], SCHEMA), order=["no"], unique=unique, references={"ref": targets})
    assert {r.outcome for r in again.collect()} == {"IDEMPOTENT"} and spark.read.parquet(path).count() == seq


def test_cases_of_a_ledger(spark, tmp_path):
    """A retry, another result for one run, a slot and generation that are taken, and a reference to nothing."""
    path = str(tmp_path / "runs")
    artifacts = spark.createDataFrame([("config",)], "id string")

    def send(*rows):
        frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "no int, id string, result_digest string, slot string, generation long, config string")
        return [r.outcome for r in ap.append(spark, path, frame, order=["no"], unique=["slot", "generation"], references={"config": artifacts}).orderBy("no").collect()]

    run = ("run", "result", "slot", 1, "config")
    assert send(run, run) == ["NEW", "IDEMPOTENT"] and send(run) == ["IDEMPOTENT"]
    assert send(("run", "other result", "slot", 1, "config")) == ["CONFLICT"]
    assert send(("another", "result", "slot", 1, "config"), ("lost", "result", "slot", 2, "nothing"), ("next", "result", "slot", 2, "config")) == ["DUPLICATE", "DANGLING", "NEW"]
    assert sorted((r.id, r.ledger_seq) for r in spark.read.parquet(path).collect()) == [("next", 2), ("run", 1)]


def test_numbers_of_a_large_batch(spark, tmp_path):
    """Every new record gets a number of its own, in the batch's order, without gaps."""
    rows = spark.range(40_000, numPartitions=2)
    columns = [(F.col("id") * 7919 % 40_009).alias("no"), F.concat(F.lit("r"), "id").alias("id"), F.lit("d").alias("result_digest")]
    got = ap.append(spark, str(tmp_path / "t"), rows.select(*columns), order=["no"]).orderBy("no").collect()
    assert [r.ledger_seq for r in got] == list(range(1, 40_001))


def test_nothing_to_append(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert ap.append(spark, str(tmp_path / "t"), none, order=["no"], unique=["a"]).collect() == []
