"""Compaction of a folder of Parquet files that a plan packs by first fit and tasks carry out.

Files lie in Hive folders of three whole-number keys: day, lot and piece. Of each day the files of fewer than `small`
rows, by falling rows, then lot, then piece, join the first opened group that stays within `most` rows, or open one. A
group of several becomes one file, its sources concatenated in joining order; all other files stay as they are.

The first group with room is found by binary search in the prefix maxima of the groups' residuals, a staircase: the
first maximum that reaches the file's size stands where the first residual does. A placement lowers one residual, and
maxima are repaired from there up to the first that stays. mapInPandas processes the days of a partition one by one.

A plan holds a row for each file, never rows of the table. Merging copies batches from one file to the next in one task
for each group. It happens in two jobs: merged files are written to the hidden folder _compacting under
temporary names and renamed, and only when all are there are they moved beside their first source and the sources
deleted. Every step can be repeated, so lost executors do no harm; if the driver is lost, the next call finds the plan
in _compacting and carries it out. The folder must not be read or written by others meanwhile.

A null day is a day of its own. Rows that repeat are kept. The table's own columns may have the keys' names: the
folders' names then get underscores. An empty folder or table gives an empty result. Timestamps of Spark's older
physical type (INT96) are rewritten in microseconds; within a structure they raise ValueError.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import common, files

KEYS = ("day", "lot", "piece")
#: Stands for a null day; no timestamp reaches it.
NO_DAY = -(1 << 40)
#: Rows copied at a time, and bytes of rows in a row group of a merged file.
BATCH_ROWS, GROUP_BYTES = 1 << 16, 64 << 20
_PLAN = "day long, lot long, piece long, n_rows long, sources array<struct<lot:long,piece:long,n_rows:long,path:string>>"


def spare(names: Iterable[str], columns: list[str]) -> list[str]:
    """The names, with underscores where a column of the table has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def write_files(table: DataFrame, path: str, columns: list[str], keys: tuple[Column, Column, Column], order: list[str], partitions: int) -> None:
    """One sorted file for each (day, lot, piece) that occurs, with these columns of the table in this order."""
    names = spare(KEYS, columns)
    keyed = table.select(*[F.col(f"`{c}`") for c in columns], *[c.cast("long").alias(name) for name, c in zip(names, keys, strict=True)])
    dealt = keyed.repartition(partitions, *names).sortWithinPartitions(*names, *order)
    dealt.write.option("maxRecordsPerFile", 0).partitionBy(*names).parquet(path)


def files_of(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """day, lot, piece, n_rows and path of every file; reads no column of the table."""
    names = spare(KEYS, columns)
    rows = spark.read.schema(", ".join(f"{n} long" for n in names)).parquet(path)
    rows = rows.select(*[F.col(n).alias(k) for n, k in zip(names, KEYS, strict=True)], F.col("_metadata.file_path").alias("path"))
    return rows.groupBy(*KEYS, "path").agg(F.count("*").alias("n_rows"))


def first_fit(sizes: list[int], most: int) -> list[int]:
    """The group of each size, in order: the first with room for it, or a new one."""
    room, peaks, out = [], [], []
    for size in sizes:
        k = bisect_left(peaks, size)
        if k == len(room):
            room.append(most - size)
            peaks.append(max(peaks[-1], room[-1]) if peaks else room[-1])
        else:
            room[k] -= size
            for i in range(k, len(room)):
                peak = max(peaks[i - 1], room[i]) if i else room[i]
                if i > k and peak == peaks[i]:
                    break
                peaks[i] = peak
        out.append(k)
    return out


def plan(found: DataFrame, small: int, most: int) -> DataFrame:
    """A row for each final file: the keys of its first source, its rows, and its sources in joining order."""

    def packed(day: pd.DataFrame) -> Iterator[dict]:
        rows = day.to_dict("records")
        few = [r for r in rows if r["n_rows"] < small]
        groups: dict[int, list[dict]] = {}
        for r, k in zip(few, first_fit([r["n_rows"] for r in few], most), strict=True):
            groups.setdefault(k, []).append(r)
        for g in [*groups.values(), *([r] for r in rows if r["n_rows"] >= small)]:
            yield {k: g[0][k] for k in KEYS} | {"n_rows": sum(r["n_rows"] for r in g), "sources": [{k: r[k] for k in ("lot", "piece", "n_rows", "path")} for r in g]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last day may go on in the next batch
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rest):
                continue
            last = rest["day"].iloc[-1]
            whole, rest = rest[rest["day"] != last], rest[rest["day"] == last]
            for _, day in whole.groupby("day", sort=False):
                yield pd.DataFrame(packed(day))
        if rest is not None and len(rest):
            yield pd.DataFrame(packed(rest))

    days = found.select(F.coalesce("day", F.lit(NO_DAY)).alias("day"), "lot", "piece", "n_rows", "path")
    days = days.repartition("day").sortWithinPartitions("day", F.desc("n_rows"), "lot", "piece", "path")
    return days.mapInPandas(run, _PLAN).withColumn("day", F.when(F.col("day") != NO_DAY, F.col("day")))


def _schema(source: pq.ParquetFile) -> pa.Schema:
    schema = source.schema_arrow
    for i in range(len(source.schema)):
        column = source.schema.column(i)
        if column.physical_type == "INT96":
            if "." in column.path:
                raise ValueError(f"{column.path}: a timestamp of 96 bits within a structure")
            schema = schema.set(schema.get_field_index(column.path), pa.field(column.path, pa.timestamp("us", "UTC")))
    return schema


def concatenate(paths: list[str], folder: str, name: str) -> None:
    """One file with the rows of all paths in their order; a batch of rows and a row group are held at a time."""
    out, writer, schema, held, size = files.Pending(folder, name), None, None, [], 0
    for path in paths:
        fs, at = files.resolve(path)
        with fs.open_input_file(at) as raw:
            source = pq.ParquetFile(raw, coerce_int96_timestamp_unit="us")
            if writer is None:
                schema = _schema(source)
                codec = source.metadata.row_group(0).column(0).compression if source.metadata.num_row_groups else "SNAPPY"
                writer = pq.ParquetWriter(out.stream, schema, compression="NONE" if codec == "UNCOMPRESSED" else codec)
            for batch in source.iter_batches(BATCH_ROWS):
                held.append(pa.Table.from_batches([batch]).cast(schema))
                size += batch.nbytes
                if size >= GROUP_BYTES:
                    writer.write_table(pa.concat_tables(held))
                    held, size = [], 0
    if held:
        writer.write_table(pa.concat_tables(held))
    writer.close()
    out.commit()


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _exists(uri: str) -> bool:
    fs, path = files.resolve(uri)
    return fs.get_file_info(path).is_file


def _remove(uri: str) -> None:
    fs, path = files.resolve(uri)
    folder, _, name = path.rpartition("/")
    for p in (path, f"{folder}/.{name}.crc"):  # with the checksum that Hadoop writes beside local files
        if fs.get_file_info(p).is_file:
            fs.delete_file(p)


def _place(row) -> tuple[str, str]:
    """Name of a merged file, and its URI beside its first source."""
    day = "none" if pd.isna(row.day) else int(row.day)
    name = f"compacted-{day}-{row.lot}-{row.piece}.parquet"
    return name, f"{row.sources[0]['path'].rpartition('/')[0]}/{name}"


def _each(rows: DataFrame, work: Callable[[object], None]) -> None:
    """A task's work on each row of a plan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                work(row)
            yield pd.DataFrame({"done": [len(batch)]})
        common.give_back()

    # a partition for each few rows, whatever their keys
    rows.repartition(common.partitions(rows.sparkSession, 16)).mapInPandas(run, "done long").agg(F.sum("done")).collect()


def compact(spark: SparkSession, path: str, columns: list[str], *, small: int, most: int) -> DataFrame:
    """Compacts the folder in place: day, lot, piece, n_rows, sources (structs), path and rewritten of every final file."""
    hidden = f"{path}/_compacting"
    if not _there(spark, f"{hidden}/plan/_SUCCESS"):  # else a run was broken off
        plan(files_of(spark, path, columns), small, most).write.mode("overwrite").parquet(f"{hidden}/plan")
    plans = spark.read.schema(_PLAN).parquet(f"{hidden}/plan")
    several = plans.where(F.size("sources") > 1)

    def merge(row) -> None:
        name, final = _place(row)
        if not _exists(final) and not _exists(f"{hidden}/{name}"):
            concatenate([s["path"] for s in row.sources], hidden, name)

    def publish(row) -> None:
        name, final = _place(row)
        if _exists(f"{hidden}/{name}"):
            (fs, old), (_, new) = files.resolve(f"{hidden}/{name}"), files.resolve(final)
            fs.move(old, new)
        for s in row.sources:
            _remove(s["path"])

    _each(several, merge)
    _each(several, publish)
    first = F.get("sources", F.lit(0))["path"]
    merged = F.concat(F.regexp_replace(first, "/[^/]*$", "/compacted-"), F.coalesce(F.col("day").cast("string"), F.lit("none")), F.lit("-"), "lot", F.lit("-"), "piece", F.lit(".parquet"))
    rewritten = F.size("sources") > 1
    done = common.stage(plans.select(*KEYS, "n_rows", "sources", F.when(rewritten, merged).otherwise(first).alias("path"), rewritten.alias("rewritten")), "compacted")
    common.delete(spark, hidden)
    return done
