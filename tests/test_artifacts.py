"""The artifact sink: whole or not at all."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tapeline.canonical import canonical_json
from tapeline.sources import artifacts


def frame(spark, n=200):
    return spark.range(n).select(F.col("id").alias("n"), (F.col("id") / 8).alias("x"), F.concat(F.lit('t"é '), "id").alias("t")).repartition(5)


def test_lines_and_manifest(spark, tmp_path):
    path = str(tmp_path / "one artifact")
    manifest = artifacts.write_artifact(frame(spark), path, order=["n"], parts=4)
    want = [canonical_json({"n": n, "x": n / 8, "t": f't"é {n}'}) for n in range(200)]
    lines = []
    for f in manifest["files"]:
        with open(os.path.join(path, f["name"]), "rb") as data:
            raw = data.read()
        assert (len(raw), hashlib.sha256(raw).hexdigest(), raw.count(b"\n")) == (f["bytes"], f["sha256"], f["rows"])
        lines += raw.decode().splitlines()
    assert lines == want and manifest["rows"] == 200 and len(manifest["files"]) == 4
    assert sorted(r.value for r in artifacts.read_artifact(spark, path).collect()) == sorted(want)
    assert sorted(os.listdir(path)) == sorted(["manifest.json", *(f["name"] for f in manifest["files"])])
    again = artifacts.write_artifact(frame(spark), str(tmp_path / "again"), order=["n"], parts=4)
    assert again["id"] == manifest["id"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "broken")
    bad = frame(spark).withColumn("x", F.when(F.col("n") == 150, float("nan")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="not finite"):
        artifacts.write_artifact(bad, path)
    assert [f for f in os.listdir(path) if not f.startswith(".")] == []
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_artifact(spark, path)
    assert artifacts.write_artifact(frame(spark, 3), path)["rows"] == 3  # a later run is not hindered


def test_what_the_manifest_does_not_list_is_not_read(spark, tmp_path):
    path = str(tmp_path / "a")
    artifacts.write_artifact(frame(spark, 10), path)
    with open(os.path.join(path, "part-999999.jsonl"), "w") as f:
        f.write("{}\n")
    assert artifacts.read_artifact(spark, path).count() == 10


def test_an_artifact_is_written_once(spark, tmp_path):
    path = str(tmp_path / "a")
    first = artifacts.write_artifact(frame(spark, 10), path)
    with pytest.raises(Exception, match="there already"):
        artifacts.write_artifact(frame(spark, 11), path)
    assert artifacts.manifest_of(path) == first


def test_an_artifact_without_rows(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert artifacts.write_artifact(frame(spark, 0), path) == {"files": [], "rows": 0, "id": hashlib.sha256(b"[]").hexdigest()}
    assert artifacts.read_artifact(spark, path).collect() == [] and json.loads((tmp_path / "empty" / "manifest.json").read_text())["rows"] == 0
