"""Raw files kept under the hash of their content: the same bytes are stored once, and never changed."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import storage

STORED = "path string, sha256 string, bytes long, stored_path string, reused boolean"


def store_files(spark: SparkSession, paths: Sequence[str], root: str, expected: dict[str, str] | None = None) -> DataFrame:
    """(path, sha256, bytes, stored_path, reused) of every file, copied to ``root`` unless its content is there already.

    The executors hash the files; a file whose hash is not the one ``expected`` of it is refused before anything is stored.
    A copy is made under another name and renamed, so a broken copy is never seen.
    """
    if not paths:
        return spark.createDataFrame([], STORED)
    hashed = spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("h"), "length").collect()  # a row per file
    wanted = {storage.qualified(spark, p): h for p, h in (expected or {}).items()}
    for r in hashed:
        if wanted.get(storage.qualified(spark, r["path"]), r["h"]) != r["h"]:
            raise ValueError(f"{r['path']} has other content than expected")
    done = []
    for r in sorted(hashed):
        place = f"{root}/{r['h'][:2]}/{r['h']}"
        reused = storage.exists(spark, place)
        if not reused:
            staged = f"{root}/.staged-{uuid.uuid4().hex[:12]}"
            storage.copy(spark, r["path"], staged)
            storage.rename(spark, staged, place)
        done.append((r["path"], r["h"], r["length"], place, reused))
    return spark.createDataFrame(done, STORED)
