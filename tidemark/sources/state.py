"""A small ledger of what was done: archives, publications and runs, by key, the newest entry of each being the state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources import storage

KINDS = ("archives", "publications", "runs")
ENTRY = "kind string, key string, version long, body string"


class StateLedger:
    """Every entry is a file of its own, named by a version that is claimed exclusively; nothing is ever changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, kind: str, key: str, body: dict) -> int:
        """Record the state of a key; returns its version.  Of two writers each gets a version of its own."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        version = len(storage.children(self.spark, f"{self.root}/claims")) + 1
        while not storage.claim(self.spark, f"{self.root}/claims/{version:010d}"):
            version += 1
        entry = {"kind": kind, "key": key, "version": version, "body": json.dumps(body, sort_keys=True)}
        storage.write_text(self.spark, f"{self.root}/entries/{version:010d}.json", json.dumps(entry))
        return version

    def history(self) -> DataFrame:
        """(kind, key, version, body) of all entries; body is JSON."""
        there = storage.exists(self.spark, f"{self.root}/entries")
        return self.spark.read.schema(ENTRY).json(f"{self.root}/entries") if there else self.spark.createDataFrame([], ENTRY)

    def state(self, kind: str) -> DataFrame:
        """The newest entry of every key of a kind."""
        newest = W.partitionBy("key").orderBy(F.desc("version"))
        return self.history().where(F.col("kind") == kind).withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("key", "version", "body")
