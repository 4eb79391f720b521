"""Small file-system steps through Hadoop's API, so any mounted store works."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, as file listings give it."""
    fs, where, _ = _fs(spark, path)
    return fs.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where, _ = _fs(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a finished folder to its published name; fails if the target exists."""
    fs, where, jvm = _fs(spark, source)
    to = jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to):
        raise FileExistsError(target)
    fs.mkdirs(to.getParent())
    if not fs.rename(where, to):
        raise OSError(f"could not move {source} to {target}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file; the target must not exist."""
    fs, where, jvm = _fs(spark, source)
    to_fs, to, _ = _fs(spark, target)
    if to_fs.exists(to):
        raise FileExistsError(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to_fs, to, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {source}")


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty marker file (and its folders)."""
    fs, where, _ = _fs(spark, path)
    fs.mkdirs(where.getParent())
    fs.create(where, True).close()


def claim(spark: SparkSession, path: str) -> bool:
    """Create a file that must not exist; False if another writer has it.  The file system decides between two writers."""
    fs, where, _ = _fs(spark, path)
    fs.mkdirs(where.getParent())
    try:
        fs.create(where, False).close()
    except Exception as e:  # the file system says so in its own words
        if fs.exists(where):
            return False
        raise e
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file whole: under another name first, then renamed."""
    fs, where, jvm = _fs(spark, path)
    fs.mkdirs(where.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.staged")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(staged, where):
        raise OSError(f"could not write {path}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; empty if the folder is missing."""
    fs, where, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def folders(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(folder, files, bytes) of every folder below a path that holds data files; Spark leaves hidden ones out.

    Spark lists them, in parallel where there are many; the driver gets a row per folder, not per file.
    """
    if not exists(spark, path):
        return []
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    by_folder = listing.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    return sorted((r["folder"], r["n"], r["b"]) for r in by_folder.collect())
