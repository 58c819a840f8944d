"""Sealed, content-addressed snapshots of SQLite databases as Parquet, and their reader."""

from __future__ import annotations

import json
import math
import os
import re
import shutil
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
)
from pyspark.sql.types import StructType

from tapeline.canonical import canonical_id
from tapeline.sources.bucketed import read_bucketed, write_bucketed

#: Rows of a table that one read task takes.
ROWS_A_TASK = 200_000
#: The column by which tables are laid out in buckets.
KEY = "ticker"
#: Rows of a snapshot's file at most.
ROWS_A_FILE = 1_000_000
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_TYPES = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class SnapshotError(RuntimeError):
    pass


@dataclass(frozen=True)
class Source:
    """A database and its allowed tables, each with its date column or None."""

    name: str
    path: str
    tables: tuple[tuple[str, str | None], ...]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True, timeout=60)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteDataSource(DataSource):
    """spark.read.format("sqlite").options(path=..., table=...): tables and views of a database.

    Only the columns of the schema asked for are read (read_sqlite takes the names). Filters that SQLite
    judges as Spark does go into its WHERE clause. Tables are read by ranges of row ids, tables without row ids by ranges
    of their first key column where it is a whole number, and views in one task. The option `rows` is how many rows a
    task takes.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with closing(_open(self.options["path"])) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise SnapshotError(f"no table {self.options['table']}")
        return ", ".join(f"{_ticked(c[1])} {_TYPES.get((c[2] or 'TEXT').upper(), 'string')}" for c in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


@dataclass
class _Rows(InputPartition):
    """Rows whose key is in low..high; all rows if there is no key."""

    key: str | None = None
    low: int = 0
    high: int = 0


#: Storage classes under which SQLite compares a column as Spark compares its type.
_CLASSES = {"bigint": ("integer", "null"), "double": ("real", "null"), "string": ("text", "null")}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.table, self.fields = options["path"], options["table"], schema.fields
        self.rows = int(options.get("rows", ROWS_A_TASK))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that compare a column with constants, and returns the others for Spark to judge."""
        kinds = {f.name: f.dataType.simpleString() for f in self.fields}
        for f in filters:
            found = self._sql(f, kinds)
            if found:
                self.where.append(found)
            else:
                yield f

    def _sql(self, f: Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
        if isinstance(f, Not):
            inner = self._sql(f.child, kinds) if isinstance(f.child, IsNull | In | EqualTo) else None
            return inner and (f"NOT ({inner[0]})", inner[1])
        attribute = getattr(f, "attribute", None)
        if not attribute or len(attribute) != 1 or attribute[0] not in kinds:
            return None
        column, kind = _quoted(attribute[0]), kinds[attribute[0]]
        if isinstance(f, IsNull | IsNotNull):
            return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
        wanted = {"bigint": int, "double": int | float, "string": str}.get(kind)
        # a column may hold values of other classes, which are converted as they are read
        if wanted is None or not all(isinstance(v, wanted) and not isinstance(v, bool) and (not isinstance(v, float) or math.isfinite(v)) for v in values) or not self._plain(attribute[0], kind):
            return None
        compared = f"{column} COLLATE BINARY" if kind == "string" else column
        if isinstance(f, In):
            return f"{compared} IN ({', '.join('?' * len(values))})", values
        if type(f) in _COMPARED:
            return f"{compared} {_COMPARED[type(f)]} ?", values
        return None

    def _plain(self, column: str, kind: str) -> bool:
        """Whether every value of a column has a class that compares as its type does; texts by their UTF-8 bytes."""
        marks = ", ".join("?" * len(_CLASSES[kind]))
        with closing(_open(self.path)) as db:
            return db.execute("PRAGMA encoding").fetchone()[0] == "UTF-8" and not db.execute(f"SELECT EXISTS (SELECT 1 FROM {_quoted(self.table)} WHERE typeof({_quoted(column)}) NOT IN ({marks}))", _CLASSES[kind]).fetchone()[0]

    def _key(self, db: sqlite3.Connection) -> str | None:
        """What to cut the rows by: the row id, else a first key column that holds whole numbers only."""
        kind = db.execute("SELECT type FROM sqlite_master WHERE name = ?", (self.table,)).fetchone()
        if not kind or kind[0] != "table":
            return None
        columns = db.execute(f"PRAGMA table_info({_quoted(self.table)})").fetchall()
        taken = {c[1].lower() for c in columns}
        for name in (n for n in ("rowid", "_rowid_", "oid") if n not in taken):
            try:
                db.execute(f"SELECT {name} FROM {_quoted(self.table)} LIMIT 0")
                return name
            except sqlite3.OperationalError:  # a table without row ids
                break
        first = next((c[1] for c in columns if c[5] == 1), None)
        whole = first and db.execute(f"SELECT NOT EXISTS (SELECT 1 FROM {_quoted(self.table)} WHERE typeof({_quoted(first)}) <> 'integer')").fetchone()[0]
        return _quoted(first) if whole else None

    def partitions(self) -> list[_Rows]:
        with closing(_open(self.path)) as db:
            key = self._key(db)
            if not key:
                return [_Rows()]
            low, high, rows = db.execute(f"SELECT min({key}), max({key}), count(*) FROM {_quoted(self.table)}").fetchone()
        if not rows:
            return []
        # keys may be sparse, so that as many ranges are cut as the rows need
        width = max(1, -(-(high - low + 1) // max(1, -(-rows // self.rows))))
        return [_Rows(key, a, min(high, a + width - 1)) for a in range(low, high + 1, width)]

    def read(self, part: _Rows | None) -> Iterator[tuple]:
        if part is None:  # of a table without rows
            return
        kinds = {"bigint": int, "double": float, "string": str}
        casts = [kinds.get(f.dataType.simpleString(), lambda x: x) for f in self.fields]
        tests, values = [t for t, _ in self.where], [v for _, some in self.where for v in some]
        if part.key:
            tests.append(f"{part.key} BETWEEN ? AND ?")
            values += [part.low, part.high]
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        with closing(_open(self.path)) as db:
            names = ", ".join(_quoted(f.name) for f in self.fields) or "1"
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}", values):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=False))


def _ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_sqlite(spark: SparkSession, path: str, table: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A table or view of a database; of its columns only those named are read."""
    spark.dataSource.register(SqliteDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").options(path=path, table=table)
    if columns is None:
        return reader.load()
    whole = SqliteDataSource({"path": path, "table": table}).schema()
    fields = {f.name: f for f in StructType.fromDDL(whole).fields}
    if absent := [c for c in columns if c not in fields]:
        raise SnapshotError(f"{table} has no columns {absent}")
    return reader.schema(StructType([fields[c] for c in columns])).load()


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes and sha256 of every data file; tasks read and hash the files.

    Files are listed as Spark lists tables: what starts with a dot or an underscore, or is empty, is no data. A file that can't be
    read, as its checksum says that it was changed, has no sha256.
    """
    base = os.path.abspath(folder)
    read = spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreCorruptFiles=True)
    files = read.load(f"file://{base}").withColumn("path", F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) + 2, 1 << 20))
    listed = files.select("path", F.col("length").alias("bytes"))  # reads no file
    return listed.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path", "left")


def _content_id(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order: it names the content, not a file."""
    row = F.xxhash64(*[F.coalesce(F.col(_ticked(c)).cast("string"), F.lit("\0")) for c in df.columns])
    got = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return canonical_id([df.dtypes and [list(t) for t in df.dtypes], got.n, got.x, str(got.s)])


def effective_cutoff(tables: Iterable[dict]) -> str | None:
    """The earliest last day of the tables; watermarks that are no days don't count."""
    return min((t["max_date"] for t in tables if t["max_date"] and _DAY.fullmatch(t["max_date"])), default=None)


def backup(source: str, target: str) -> None:
    """A consistent copy of a database that may be written to meanwhile, sealed and checked."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with closing(_open(source)) as live, closing(sqlite3.connect(target)) as copy:
        live.backup(copy)
        copy.execute("PRAGMA journal_mode=DELETE")
        copy.commit()
        if (found := copy.execute("PRAGMA integrity_check").fetchone()[0]) != "ok":
            raise SnapshotError(f"{source}: {found}")


def _dated(df: DataFrame, column: str) -> DataFrame:
    """df with a text column as dates, if every text is an ISO date."""
    c = F.col(_ticked(column))
    wrong = c.isNotNull() & ~(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull())
    return df.withColumn(column, c.cast("date")) if dict(df.dtypes)[column] == "string" and df.where(wrong).isEmpty() else df


def _sealed_table(spark: SparkSession, database: str, source: Source, name: str, column: str | None, staging: str, buckets: int) -> dict:
    """Copy one table of a database's copy to Parquet and describe it."""
    with closing(_open(database)) as db:
        rows = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
    df = read_sqlite(spark, database, name)
    target = os.path.join(staging, source.name, name)
    # a file is hashed as one value, so it stays far below what such a value can hold
    layout = {}
    if buckets and column and KEY in df.columns:
        df = _dated(df, column)
        write_bucketed(df, f"file://{os.path.abspath(target)}", KEY, buckets, [column], ROWS_A_FILE)
        layout = {"layout": {"key": KEY, "buckets": buckets, "sort": [column], "schema": json.loads(df.schema.json())}}
    else:
        df.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(target)
    back = spark.read.schema(df.schema).parquet(target)
    got = back.agg(F.count("*").alias("n"), *(f(_ticked(column)).cast("string").alias(k) for k, f in (("min", F.min), ("max", F.max)) if column)).first().asDict()
    if got["n"] != rows:
        raise SnapshotError(f"{source.name}.{name}: {got['n']} of {rows} rows after the copy")
    written = sorted(file_digests(spark, target).collect())  # a row for each file
    files, sizes = {r.path: r.sha256 for r in written}, {r.path: r.bytes for r in written}
    return {"name": name, "rows": rows, "date_column": column, "min_date": got.get("min"), "max_date": got.get("max"), "content": _content_id(back), "files": files, "bytes": sizes} | layout


def bridge(spark: SparkSession, sources: Iterable[Source], root: str, keep: int = 2, created_at: str = "", buckets: int = 0) -> dict:
    """Copy the allowed tables into a new snapshot and return its manifest; the same content gives the same snapshot.

    Each database is backed up first, so all of its tables are of one moment. Tables are written to a staging
    folder, read back and compared; the folder is VALIDATING until it is whole, and then renamed. What fails
    is removed from staging; old snapshots beyond `keep` go. buckets: dated tables with a ticker are laid out in so many
    buckets of tickers, sorted by date and with dates of their own type, so that windows over a ticker need no exchange.
    """
    staging = os.path.join(root, f".staging-{uuid.uuid4().hex}")
    copies = f"{staging}-copies"
    try:
        datasets = []
        for source in sources:
            database = os.path.join(copies, f"{source.name}.db")
            backup(source.path, database)
            with closing(_open(database)) as db:
                there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
            if absent := sorted({name for name, _ in source.tables} - there):
                raise SnapshotError(f"{source.name}: no tables {absent}")
            tables = [_sealed_table(spark, database, source, name, column, staging, buckets) for name, column in source.tables]
            datasets.append({"name": source.name, "tables": sorted(tables, key=lambda t: t["name"])})
        datasets.sort(key=lambda d: d["name"])
        every = [t for d in datasets for t in d["tables"]]
        cutoff = effective_cutoff(every)
        snapshot_id = canonical_id({"kind": "SNAPSHOT", "cutoff": cutoff, "datasets": [[d["name"], [[t["name"], t["content"]] for t in d["tables"]]] for d in datasets]})
        totals = {"total_rows": sum(t["rows"] for t in every), "total_bytes": sum(sum(t["bytes"].values()) for t in every)}
        manifest = {"snapshot_id": snapshot_id, "status": "VALIDATING", "created_at": created_at, "effective_cutoff": cutoff, "datasets": datasets} | totals
        final = os.path.join(root, snapshot_id)
        if os.path.isdir(final):
            return load_manifest(final)
        _write_manifest(staging, manifest)
        if found := [x for x in verify(spark, staging) if x != "status VALIDATING"]:
            raise SnapshotError("; ".join(found))
        manifest["status"] = "READY"
        _write_manifest(staging, manifest)
        os.rename(staging, final)
        _sync(root)
        kept = sorted((e for e in os.scandir(root) if e.is_dir() and not e.name.startswith(".") and e.name != "quarantine"), key=lambda e: -e.stat().st_mtime)
        for old in kept[keep:]:
            shutil.rmtree(old.path)
        return manifest
    finally:
        shutil.rmtree(staging, ignore_errors=True)
        shutil.rmtree(copies, ignore_errors=True)


def _sync(path: str) -> None:
    """Wait until a file or folder is on disk."""
    at = os.open(path, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def _write_manifest(folder: str, manifest: dict) -> None:
    """Replace a manifest as a whole."""
    path = os.path.join(folder, "manifest.json")
    with open(f"{path}.new", "w") as f:
        json.dump(manifest, f, sort_keys=True, indent=1)
    _sync(f"{path}.new")
    os.replace(f"{path}.new", path)
    _sync(folder)


def load_manifest(folder: str) -> dict:
    with open(os.path.join(folder, "manifest.json")) as f:
        return json.load(f)


_MANIFEST = "status string, datasets array<struct<name:string,tables:array<struct<name:string,files:map<string,string>,bytes:map<string,long>>>>>"


def expected_files(spark: SparkSession, folder: str) -> DataFrame:
    """table, path, bytes and sha256 of every file that a snapshot's manifest lists."""
    manifest = spark.read.schema(_MANIFEST).option("multiLine", True).json(f"file://{os.path.abspath(folder)}/manifest.json")
    tables = manifest.select(F.explode("datasets").alias("d")).select("d.name", F.explode("d.tables").alias("t"))
    listed = tables.select("name", "t.name", "t.bytes", F.explode("t.files").alias("file", "sha256")).toDF("dataset", "name", "sizes", "file", "sha256")
    return listed.select(F.concat_ws(".", "dataset", "name").alias("table"), "file", F.concat_ws("/", "dataset", "name", "file").alias("path"), F.col("sizes")[F.col("file")].alias("bytes"), "sha256")


def verify(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with a snapshot: its status; missing, changed or additional files.

    The files are hashed by tasks and joined with the manifest both ways; only what is wrong comes back.
    """
    status = load_manifest(folder)["status"]
    wanted, found = expected_files(spark, folder), file_digests(spark, folder).where("path <> 'manifest.json'")
    pairs = wanted.join(found.select("path", F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now")), "path", "full_outer")
    name = F.concat("table", F.lit("/"), "file")
    problem = (
        F.when(F.col("table").isNull(), F.concat(F.lit("unknown "), "path"))
        .when(F.col("now_bytes").isNull(), F.concat(F.lit("missing "), name))
        .when(~F.col("now").eqNullSafe(F.col("sha256")) | (F.col("now_bytes") != F.col("bytes")), F.concat(F.lit("changed "), name))
    )
    wrong = pairs.select(problem.alias("problem")).where("problem is not null").orderBy("problem").collect()
    return [f"status {status}"] * (status != "READY") + [r.problem for r in wrong]


def quarantine(folder: str, reason: str) -> str:
    """Mark a snapshot as bad and move it aside."""
    _write_manifest(folder, load_manifest(folder) | {"status": "QUARANTINED", "reason": reason})
    target = os.path.join(os.path.dirname(folder), "quarantine", os.path.basename(folder))
    os.makedirs(os.path.dirname(target), exist_ok=True)
    os.rename(folder, target)
    return target


class Snapshot:
    """A verified snapshot: its tables as DataFrames and SQL over them."""

    def __init__(self, spark: SparkSession, root: str, snapshot_id: str):
        if not re.fullmatch(r"[0-9a-f]{64}", snapshot_id):
            raise SnapshotError("not a snapshot id")
        self.spark, self.folder = spark, os.path.join(os.path.abspath(root), snapshot_id)
        if os.path.islink(self.folder) or not os.path.isdir(self.folder):
            raise SnapshotError(f"no snapshot {snapshot_id}")
        if problems := verify(spark, self.folder):
            raise SnapshotError("; ".join(problems))
        self.manifest = load_manifest(self.folder)

    def table(self, dataset: str, name: str) -> DataFrame:
        for d in self.manifest["datasets"]:
            for t in d["tables"] if d["name"] == dataset else ():
                path = f"file://{os.path.join(self.folder, dataset, name)}"
                if t["name"] == name and "layout" in t:
                    of = t["layout"]
                    return read_bucketed(self.spark, path, StructType.fromJson(of["schema"]), of["key"], of["buckets"], of["sort"])
                if t["name"] == name:
                    return self.spark.read.parquet(path)
        raise SnapshotError(f"no table {dataset}.{name}")

    def sql(self, dataset: str, query: str, **args: object) -> DataFrame:
        """Any SQL over the tables of a dataset, which it names plainly."""
        for d in self.manifest["datasets"]:
            if d["name"] == dataset:
                for t in d["tables"]:
                    self.table(dataset, t["name"]).createOrReplaceTempView(t["name"])
        return self.spark.sql(query, args=args or None)

    def window(self, days: int) -> DataFrame:
        """Prices from `days` days before the cut-off on; there is no upper bound.

        Dates are ISO texts, which sort as dates do, so the bound reaches the scan as one.
        """
        start = str(date.fromisoformat(self.manifest["effective_cutoff"]) - timedelta(days=days))
        return self.table("idx_ohlcv", "prices").where(F.col("date") >= start).withColumn("date", F.to_date("date"))
