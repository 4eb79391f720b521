"""Far too many small files: fewer well-sized ones, with exactly the same rows.

The files lie in one folder per date and hour.  The engine packs many small files into one split (maximum partition bytes,
file-open cost); the combined splits of a folder are coalesced to the planned number of files.  No row is shuffled.  The
copy is staged, compared with the source by row count and order-free hash of every folder, and published by rename only if
nothing differs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import materialize, scratch
from tidemark.sources import storage

MB = 1 << 20


@dataclass(frozen=True)
class Packing:
    """``target_bytes``: size aimed at per written file.  ``split_bytes`` and ``open_cost``: a read task takes files
    until their bytes plus ``open_cost`` each exceed ``split_bytes``."""

    target_bytes: int = 128 * MB
    split_bytes: int = 256 * MB
    open_cost: int = 64 << 10

    def files(self, size: int) -> int:
        return max(1, ceil(size / self.target_bytes))


def unused(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


class RowsDiffer(RuntimeError):
    """The staged copy has other rows than the source; nothing was published."""


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row as a decimal, so that sums over any number of rows stay exact; nulls are marked."""
    marks = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns])
    values = [F.to_json(F.col(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes]
    return F.xxhash64(marks, *values).cast("decimal(20,0)")


def digest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows, checksum): equal for two tables if and (but for hash collisions) only if they hold the same rows."""
    return df.select(*keys, row_hash(df).alias("_h")).groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("_h").cast("decimal(38,0)").alias("checksum"))


def listing_totals(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, files_before, listed_bytes): a file listed twice counts once."""
    once = files.groupBy("file_id", *keys).agg(F.max("n_bytes").alias("n_bytes"))
    return once.groupBy(*keys).agg(F.count("*").alias("files_before"), F.sum("n_bytes").alias("listed_bytes"))


def cut_by_folder(table: DataFrame, place: str, keys: Sequence[str]) -> None:
    """Lay a table out as an ingest leaves it: every task writes one file to each folder it has rows for.

    The folders are named by hidden copies of the keys, so the files keep the exact values and types.
    """
    hidden = {k: unused(f"p_{k}", table) for k in keys}
    table.withColumns({v: F.col(k) for k, v in hidden.items()}).write.partitionBy(*hidden.values()).parquet(place)


def pack_folders(spark: SparkSession, found: Sequence[tuple[str, int, int]], root: str, staged: str, schema: StructType, packing: Packing, threads: int = 8) -> None:
    """Write each folder of ``found`` (folder, files, bytes) anew below ``staged``, packed into few files.

    Folders run side by side, in a session of its own, so that the split sizes concern nothing else.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(packing.split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(packing.open_cost))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))

    def one(folder: str, size: int) -> None:
        out = f"{staged}/{folder[len(root) :].strip('/')}".rstrip("/")
        own.read.schema(schema).parquet(folder).coalesce(packing.files(size)).write.parquet(out)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(lambda x: one(x[0], x[2]), sorted(found, key=lambda x: -x[2])))


def compact_rows(table: DataFrame, files: DataFrame, keys: Sequence[str] = ("event_date", "event_hour"), packing: Packing = Packing(), out: str | None = None) -> tuple[str, DataFrame]:
    """(folder of the compacted table, report per key) of a table that is first cut into small files by its keys.

    Sizes come from the files that are there, not from the listing, which may be wrong.  Report: keys, rows, files_before
    (as listed; null if nothing was listed), files_cut (as they lay there), files_after, largest_file_bytes.  Rows with null
    keys form a folder of their own; an empty table gives an empty report.
    """
    spark, keys = table.sparkSession, list(keys)
    place = out or scratch(spark, "compacted")
    source, staged = f"{place}-source", f"{place}-staged"
    cut_by_folder(table, source, keys)
    found = storage.folders(spark, source)
    root = storage.qualified(spark, source)
    if found:
        pack_folders(spark, found, root, staged, table.schema, packing)
    else:
        table.limit(0).write.parquet(staged)
    before = materialize(digest(table, keys), "rows-before")
    after = _checked(spark, staged, table, keys, before)
    storage.rename(spark, staged, place)
    lay = spark.read.schema(table.schema).parquet(source).select(*keys, F.col("_metadata.file_path").alias("_f")).groupBy(*keys, "_f").agg(F.lit(1)) if found else table.limit(0).select(*keys)
    parts = {"_l_": listing_totals(files, keys), "_c_": lay.groupBy(*keys).agg(F.count("*").alias("files_cut"))}
    report = after
    for mark, part in parts.items():
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
        report = report.join(part.withColumnsRenamed({k: f"{mark}{k}" for k in keys}), match, "left")
    report = materialize(report.select(*keys, "rows", "files_before", "files_cut", "files_after", "largest_file_bytes"), "compaction-report")
    storage.delete(spark, source)
    return place, report


def read_compacted(spark: SparkSession, place: str, like: DataFrame) -> DataFrame:
    """The compacted table with the columns of the source."""
    return spark.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(place).select(*[f"`{c}`" for c in like.columns])


def _checked(spark: SparkSession, staged: str, source: DataFrame, keys: list[str], before: DataFrame) -> DataFrame:
    """Compares the staged copy with the source; (keys, rows, files_after, largest_file_bytes)."""
    copy = spark.read.schema(source.schema).option("recursiveFileLookup", "true").parquet(staged)
    by_file = copy.select(*keys, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), row_hash(source).alias("_h"))
    files = by_file.groupBy(*keys, "_file").agg(F.count("*").alias("rows"), F.sum("_h").alias("_h"), F.max("_size").alias("_size"))
    after = materialize(files.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("_h").cast("decimal(38,0)").alias("checksum"), F.count("*").alias("files_after"), F.max("_size").alias("largest_file_bytes")), "rows-after")
    sides = ["rows", "checksum"]
    differ = before.select(*keys, *sides).exceptAll(after.select(*keys, *sides)).unionByName(after.select(*keys, *sides).exceptAll(before.select(*keys, *sides)))
    if not differ.isEmpty():
        storage.delete(spark, staged)
        raise RowsDiffer(f"the staged copy differs, for example at {differ.first()}")
    return after.drop("checksum")


def compact_directories(spark: SparkSession, source: str, target: str, packing: Packing = Packing(), threads: int = 8) -> DataFrame:
    """Compact each folder below ``source`` that holds Parquet files; (folder, rows, files_before, files_after).

    A folder is published whole, by rename, after all its rows were compared; one that was published before is skipped, so
    a broken run can be started again.  The schema is the union of all files' columns.  Empty files vanish; a folder of
    only empty files keeps one.
    """
    root, staged = storage.qualified(spark, source), f"{target}/.staged"
    there = {f for f, _, _ in storage.folders(spark, target)}
    place = lambda folder: f"{target}/{folder[len(root) :].strip('/')}".rstrip("/")
    found = [x for x in storage.folders(spark, source) if storage.qualified(spark, place(x[0])) not in there]
    if not found:
        return spark.createDataFrame([], "folder string, rows long, files_before long, files_after long")
    storage.delete(spark, staged)
    whole = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
    schema = whole.parquet(*[f for f, _, _ in found]).schema
    pack_folders(spark, found, root, staged, schema, packing, threads)
    name = lambda where: F.regexp_replace(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1), f"^{re.escape(storage.qualified(spark, where))}/?", "").alias("_folder")
    sides = []
    for where, paths in ((source, [f for f, _, _ in found]), (staged, [f for f, _, _ in storage.folders(spark, staged)])):
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
        sides.append(rows.select(name(where), row_hash(rows).alias("_h")).groupBy("_folder").agg(F.count("*").alias("rows"), F.sum("_h").cast("decimal(38,0)").alias("checksum")))
    a, b = (materialize(x, "folder-digest") for x in sides)
    differ = a.exceptAll(b).unionByName(b.exceptAll(a))
    if not differ.isEmpty():
        storage.delete(spark, staged)
        raise RowsDiffer(f"the staged copy differs in the folder {differ.first()['_folder']!r}")
    counted = {r["_folder"]: r["rows"] for r in a.collect()}  # a row per folder
    after = {f: n for f, n, _ in storage.folders(spark, staged)}
    done = []
    for folder, n, _ in found:
        short = folder[len(root) :].strip("/")
        at = f"{staged}/{short}".rstrip("/")
        done.append((short, counted.get(short, 0), n, after.get(storage.qualified(spark, at), 0)))
        storage.rename(spark, at, place(folder))
    return spark.createDataFrame(done, "folder string, rows long, files_before long, files_after long")
