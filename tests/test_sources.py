"""The SQLite source over each kind of table, pushed filters, and verification of snapshots by tasks."""

import os
import shutil
import sqlite3

import pytest
from pyspark.sql import functions as F

from tapeline.functions import features as ft
from tapeline.sources import snapshot as snap


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "a.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE plain (day TEXT, "two words" INTEGER, x REAL, `tick``ed` TEXT COLLATE NOCASE)')
        db.executemany("INSERT INTO plain VALUES (?,?,?,?)", [(f"2024-01-{1 + i % 28:02}", i % 7 if i % 5 else None, i / 4, "aAbB"[i % 4]) for i in range(500)])
        db.execute("DELETE FROM plain WHERE rowid BETWEEN 100 AND 300")
        db.execute("CREATE TABLE keyed (k INTEGER, name TEXT, PRIMARY KEY (k, name)) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?,?)", [(i * 10**12 - 5 * 10**13, f"n{i}") for i in range(100)])
        db.execute("CREATE TABLE named (name TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        db.executemany("INSERT INTO named VALUES (?,?)", [(f"é{i}", i) for i in range(30)])
        db.execute("CREATE VIEW seen AS SELECT day, count(*) AS n FROM plain GROUP BY day")
        db.execute("CREATE TABLE mixed (v INTEGER, t TEXT)")
        db.executemany("INSERT INTO mixed VALUES (?,?)", [(1, "a"), ("2", "b"), (2.5, "c"), (None, "d"), (7, b"e")])
        db.execute("CREATE TABLE odd (rowid TEXT, _rowid_ TEXT, oid TEXT)")
        db.execute("INSERT INTO odd VALUES ('a', 'b', 'c')")
        db.execute("CREATE TABLE empty (a INTEGER)")
    return path


def test_every_kind_of_table(spark, database):
    with sqlite3.connect(database) as db:
        for table in ("plain", "keyed", "named", "seen", "odd", "empty"):
            want = db.execute(f"SELECT * FROM {table}").fetchall()
            got = snap.read_sqlite(spark, database, table)
            kinds = {"seen": "double"}
            rows = [tuple(r) for r in got.collect()]
            key = lambda r: [(v is not None, str(v)) for v in r]
            assert sorted(rows, key=key) == sorted([tuple(float(v) if kinds.get(table) and isinstance(v, float) else (v if table != "seen" else (v if isinstance(v, str) else str(v))) for v in r) for r in want], key=key)
    tasks = lambda table: spark.read.format("sqlite").options(path=database, table=table, rows=40).load()
    assert tasks("plain").rdd.getNumPartitions() > 4 and tasks("plain").count() == 299
    assert 1 < tasks("keyed").rdd.getNumPartitions() <= 4 and tasks("keyed").count() == 100  # sparse keys are no more ranges
    assert tasks("named").rdd.getNumPartitions() == 1


FILTERS = [
    ("plain", "day >= '2024-01-20' AND x < 100.0", 2),
    ("plain", "`two words` IN (1, 2) AND day = '2024-01-03'", 2),
    ("plain", "`two words` NOT IN (1, 2)", 1),
    ("plain", "`two words` IS NULL", 1),
    ("plain", "`tick``ed` = 'a'", 1),  # the column's own collation knows no case
    ("plain", "x > 1.5 AND x <= 90.25", 2),
    ("keyed", "k > -1000000000000", 1),
    ("named", "name > 'é2'", 1),
    ("seen", "day < '2024-01-05'", 1),
    ("mixed", "v = 2", 0),  # texts and reals among whole numbers are compared after they are read
    ("mixed", "t > 'a'", 0),
]


@pytest.mark.parametrize(("table", "test", "pushed"), FILTERS)
def test_pushed_filters(spark, database, table, test, pushed):
    if table == "mixed":
        frame = snap.read_sqlite(spark, database, table, ["v"] if "v" in test else ["t"])
    else:
        frame = snap.read_sqlite(spark, database, table)
    found = frame.where(test)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    line = next((x for x in plan.splitlines() if "PushedFilters" in x), "PushedFilters: []")
    inside = line.split("PushedFilters: [")[1].split("]")[0]
    took = [x for x in inside.split(", ") if x and not x.startswith("IsNotNull")]
    assert (len(took) > 0) == (pushed > 0), line
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        want = [tuple(r) for r in spark.createDataFrame(frame.collect(), frame.schema).where(test).collect()]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want)) and want


def test_columns_are_chosen_in_the_database(spark, database):
    got = snap.read_sqlite(spark, database, "plain", ["x", "day"])
    assert got.columns == ["x", "day"] and got.where("x = 0.5").collect() == [(0.5, "2024-01-03")]
    with pytest.raises(snap.SnapshotError, match="no columns"):
        snap.read_sqlite(spark, database, "plain", ["z"])
    assert snap.read_sqlite(spark, database, "plain").count() == 299


@pytest.fixture
def sealed(spark, database, tmp_path):
    root = str(tmp_path / "snap shots+%41")
    os.makedirs(root)
    source = snap.Source("one db", database, (("plain", "day"), ("keyed", None), ("seen", "day"), ("named", None)))
    manifest = snap.bridge(spark, [source], root)
    return os.path.join(root, manifest["snapshot_id"]), manifest


def test_snapshot_of_every_kind_of_table(spark, sealed):
    folder, manifest = sealed
    rows = {t["name"]: t["rows"] for t in manifest["datasets"][0]["tables"]}
    assert rows == {"plain": 299, "keyed": 100, "seen": 28, "named": 30} and snap.verify(spark, folder) == []
    assert manifest["total_bytes"] == sum(r.bytes for r in snap.expected_files(spark, folder).collect())


def test_what_is_wrong_with_files(spark, sealed):
    folder, _ = sealed
    table = os.path.join(folder, "one db", "plain")
    names = sorted(f for f in os.listdir(table) if f.endswith(".parquet"))
    other = os.path.join(folder, "one db", "keyed")
    gone = sorted(f for f in os.listdir(other) if f.endswith(".parquet"))[0]
    with open(os.path.join(table, names[0]), "r+b") as f:  # as long as before
        f.seek(10)
        byte = f.read(1)
        f.seek(10)
        f.write(bytes([byte[0] ^ 1]))
    os.remove(os.path.join(other, gone))
    shutil.copy(os.path.join(table, names[0]), os.path.join(table, "copy.parquet"))
    with open(os.path.join(folder, "notes.txt"), "w") as f:
        f.write("x")
    snap._write_manifest(folder, snap.load_manifest(folder) | {"status": "VALIDATING"})
    assert snap.verify(spark, folder) == ["status VALIDATING", f"changed one db.plain/{names[0]}", f"missing one db.keyed/{gone}", "unknown notes.txt", "unknown one db/plain/copy.parquet"]
    with pytest.raises(snap.SnapshotError, match="VALIDATING"):
        snap.Snapshot(spark, os.path.dirname(folder), os.path.basename(folder))


def test_files_are_hashed_by_tasks(spark, sealed):
    folder, _ = sealed
    plan = snap.file_digests(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan
    joined = snap.expected_files(spark, folder).join(snap.file_digests(spark, folder), ["path", "sha256", "bytes"])
    assert joined.count() == snap.expected_files(spark, folder).count() == snap.file_digests(spark, folder).where(F.col("path").endswith(".parquet")).count()


def test_price_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE prices (date TEXT, ticker TEXT, close REAL)")
        db.executemany("INSERT INTO prices VALUES (?,?,?)", [(f"2024-{m:02}-{d:02}", "A", 1.0) for m in (1, 2, 3) for d in range(1, 29)])
    root = str(tmp_path / "snapshots")
    os.makedirs(root)
    manifest = snap.bridge(spark, [snap.Source("idx_ohlcv", path, (("prices", "date"),))], root)
    window = snap.Snapshot(spark, root, manifest["snapshot_id"]).window(10)
    assert "GreaterThanOrEqual(date,2024-03-18)" in window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == 11 and dict(window.dtypes)["date"] == "date"


def test_windows_over_buckets_need_no_exchange(spark, tmp_path):
    path = str(tmp_path / "p.db")
    with sqlite3.connect(path) as db:
        for table in ("prices", "broken"):
            db.execute(f"CREATE TABLE {table} (date TEXT, ticker TEXT, open REAL, high REAL, low REAL, close REAL, volume REAL)")
            db.executemany(f"INSERT INTO {table} VALUES (?,?,?,?,?,?,?)", [(f"2024-{1 + d // 28:02}-{1 + d % 28:02}", f"T{t}", 1.0 + d, 2.0 + d, 0.5 + d, 1.5 + d, 100.0) for d in range(80) for t in range(9)])
        db.execute("INSERT INTO broken (date, ticker) VALUES ('2024-02-31', 'T1')")
    root = str(tmp_path / "snap's")
    os.makedirs(root)
    source = snap.Source("idx_ohlcv", path, (("prices", "date"), ("broken", "date")))
    plain, manifest = snap.bridge(spark, [source], root), snap.bridge(spark, [source], root, buckets=4)
    first, second = snap.Snapshot(spark, root, plain["snapshot_id"]), snap.Snapshot(spark, root, manifest["snapshot_id"])
    bars = second.window(20)
    assert dict(second.table("idx_ohlcv", "prices").dtypes)["date"] == "date" and dict(second.table("idx_ohlcv", "broken").dtypes)["date"] == "string"
    plan = ft.features(bars)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan and "GreaterThanOrEqual(date,2024-03-04)" in plan
    assert "Exchange" in ft.features(first.window(20))._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ft.features(bars).collect())) == sorted(map(tuple, ft.features(first.window(20)).collect()))
    assert manifest["effective_cutoff"] == plain["effective_cutoff"] and second.sql("idx_ohlcv", "SELECT count(*) AS n FROM prices WHERE ticker = 'T3'").first().n == 80
    files = {t["name"]: len(t["files"]) for t in manifest["datasets"][0]["tables"]}
    assert all(1 <= n <= 4 for n in files.values())
