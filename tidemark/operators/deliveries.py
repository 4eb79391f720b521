"""Messages delivered more than once: exactly one copy of each stays.

Storage: one bucketed table, hashed by identifier and sorted inside each bucket by identifier and delivery order.
``add`` appends sorted runs, one per batch or range of commits; a run that comes again writes nothing.  ``compact`` reads
each bucket with all its runs, where rows of equal identifier meet without a shuffle, collapses them to the first and
writes the result as new sorted buckets, with the verdict on every other copy beside it.  Identifiers that hold a large
share of the rows never enter a bucket: they are few by definition, their first delivery is found by a map-side combined
aggregate and broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.skew import heavy_keys, is_one_of
from tidemark.session import scratch
from tidemark.sources import storage

IDENTITY = ("stream_id", "event_id")
ORDER = ("batch_id", "partition_id", "offset_id", "delivery_id")
CONTENT = ("event_time", "event_type", "payload_action", "repo_id", "repo_name", "actor_id", "actor_login")


def fingerprint(columns: Sequence[str] = CONTENT) -> list[Column]:
    """128 bits over the columns, null told apart from every value: two rows agree if both words agree."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "n").otherwise("v") for c in columns])
    return [F.xxhash64(nulls, *columns).alias("_fp1"), F.xxhash64(*reversed(columns), nulls, F.lit("second word")).alias("_fp2")]


RUN = "_run"


class IdentifierStore:
    """Hash-bucketed, sorted storage by identifier with idempotent runs."""

    def __init__(self, spark: SparkSession, keys: Sequence[str] = IDENTITY, order: Sequence[str] = ORDER, buckets: int | None = None, root: str | None = None):
        self.spark, self.keys, self.order = spark, list(keys), list(order)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = root or scratch(spark, "store")
        self.name = f"tidemark_store_{uuid.uuid4().hex[:12]}"
        self.compactions = 0

    def upsert(self, rows: DataFrame, run: str) -> bool:
        """Add one run; False if a run of this name was committed before: then nothing is written."""
        return bool(self.add(rows.withColumn(RUN, F.lit(run)), [run]))

    def add(self, rows: DataFrame, runs: Sequence[str]) -> list[str]:
        """Add the runs that the column ``_run`` names, all in one pass; returns those that were not there before.

        A crash between the write and the marks lets runs be written twice; reading collapses such rows too, since they
        carry the same delivery.
        """
        new = [r for r in runs if not storage.exists(self.spark, f"{self.root}/runs/{r}")]
        if not new:
            return []
        some = rows.where(F.col(RUN).isin(*new)).repartition(self.buckets, *self.keys)
        if self.spark.catalog.tableExists(self.name):
            some.select(*self.spark.table(self.name).columns).write.insertInto(self.name)
        else:
            some.write.format("parquet").partitionBy(RUN).bucketBy(self.buckets, *self.keys).sortBy(*self.keys, *self.order).option("path", f"{self.root}/data-{self.compactions}").saveAsTable(self.name)
        for r in new:
            storage.mark(self.spark, f"{self.root}/runs/{r}")
        return new

    def rows(self) -> DataFrame:
        """What the store holds: the kept rows of the last compaction and all later runs."""
        parts = []
        if self.spark.catalog.tableExists(f"{self.name}_kept"):
            parts.append(self.spark.table(f"{self.name}_kept").where("disposition = 'kept'").drop("disposition"))
        if self.spark.catalog.tableExists(self.name):
            parts.append(self.spark.table(self.name).drop(RUN))
        return reduce(DataFrame.unionByName, parts)

    def ranked(self) -> DataFrame:
        """All stored rows with ``_rank`` (1: the one that stays) and the first row's fingerprint.

        A delivery stored twice (see add) counts once.
        """
        whole = W.partitionBy(*self.keys).orderBy(*self.order)
        again = F.lag(self.order[-1]).over(whole).eqNullSafe(F.col(self.order[-1])) & (F.row_number().over(whole) > 1)
        rows = self.rows().withColumn("_again", again).where(~F.col("_again")).drop("_again")
        return rows.withColumns({"_rank": F.row_number().over(whole), "_kept1": F.first("_fp1").over(whole), "_kept2": F.first("_fp2").over(whole)})

    def compact(self) -> DataFrame:
        """Merge all runs: one row per identifier stays in the store, the runs go.

        Returns every row that was merged with its disposition: kept, duplicate or conflict.
        """
        old_data, old_name = f"{self.root}/data-{self.compactions}", f"{self.name}_kept"
        place = f"{self.root}/compacted-{self.compactions}"
        settled = self.ranked().withColumn("disposition", verdict()).drop("_rank", "_kept1", "_kept2")
        schema = settled.schema
        new_name = f"{self.name}_new"
        settled.write.format("parquet").partitionBy("disposition").bucketBy(self.buckets, *self.keys).sortBy(*self.keys, *self.order).option("path", place).saveAsTable(new_name)
        for name in (old_name, self.name):
            self.spark.sql(f"drop table if exists {name}")
        self.spark.sql(f"alter table {new_name} rename to {old_name}")
        storage.delete(self.spark, old_data)
        if self.compactions:
            storage.delete(self.spark, f"{self.root}/compacted-{self.compactions - 1}")
        self.compactions += 1
        return self.spark.read.schema(schema).parquet(place)

    def close(self) -> None:
        """Forget the tables; the files stay for those who read them."""
        for name in (self.name, f"{self.name}_kept"):
            self.spark.sql(f"drop table if exists {name}")


def verdict() -> Column:
    """kept, duplicate or conflict, from the rank and the fingerprints of a ranked row."""
    same = (F.col("_fp1") == F.col("_kept1")) & (F.col("_fp2") == F.col("_kept2"))
    return F.when(F.col("_rank") == 1, "kept").when(same, "duplicate").otherwise("conflict")


def commit_ranges(rows: DataFrame, column: str, ranges: int) -> tuple[Column, int]:
    """(number of the range of commits a row belongs to, ranges): about equally many rows each; nulls come first."""
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.approxQuantile(column, cuts, 0.01))) if cuts else []
    return sum((F.coalesce(F.col(column) > b, F.lit(False)).cast("int") for b in bounds), F.lit(0)), len(bounds) + 1


def _hot_ranked(rows: DataFrame) -> DataFrame:
    """The same columns as ``ranked`` for identifiers that hold many rows; the broadcast side has a row per identifier."""
    spot = F.struct(*ORDER)
    first = rows.groupBy(*IDENTITY).agg(F.min(F.struct(*ORDER, "_fp1", "_fp2")).alias("_first"))
    joined = rows.join(F.broadcast(first), list(IDENTITY))
    return joined.select(
        *rows.columns,
        F.when(spot == F.struct(*[F.col(f"_first.{c}").alias(c) for c in ORDER]), 1).otherwise(2).alias("_rank"),
        F.col("_first._fp1").alias("_kept1"),
        F.col("_first._fp2").alias("_kept2"),
    )


def settle_deliveries(messages: DataFrame, carry: Sequence[str] = (), hot_share: float = 1 / 256, ranges: int = 4) -> DataFrame:
    """Every valid delivery with its disposition: kept, duplicate or conflict.

    Among the messages of a stream with one event_id the first by batch, partition and offset (then delivery_id, so
    ties have one result) is kept.  Another is a duplicate if its content equals the kept one's, null equal to null,
    else a conflict.  Rows marked 'invalid' take no part; a row without stream_id or event_id is its own message and
    kept; an empty table gives an empty result.  Columns out: delivery_id, stream_id, event_id, batch_id, carry,
    disposition; further columns of the input are ignored whatever their names.

    The messages enter the store as one run per range of commits and are read from its compaction.
    """
    spark = messages.sparkSession
    valid = messages.where(~F.col("disposition").eqNullSafe(F.lit("invalid")))
    wanted = list(dict.fromkeys([*IDENTITY, *ORDER, *carry]))
    slim = valid.select(*wanted, *fingerprint())
    named = slim.dropna(subset=list(IDENTITY))
    hot = heavy_keys(valid, IDENTITY, hot_share)
    number, n = commit_ranges(valid.where(F.col("batch_id").isNotNull()), "batch_id", ranges)
    store = IdentifierStore(spark)
    runs = F.concat(F.lit("commits-"), number.cast("string"))
    store.add((named.where(~is_one_of(IDENTITY, hot)) if hot else named).withColumn(RUN, runs), [f"commits-{i}" for i in range(n)])
    out = list(dict.fromkeys(["delivery_id", *IDENTITY, "batch_id", *carry]))
    settled = store.compact().select(*out, "disposition")
    store.close()
    if hot:
        settled = settled.unionByName(_hot_ranked(named.where(is_one_of(IDENTITY, hot))).select(*out, verdict().alias("disposition")))
    alone = slim.where(F.col("stream_id").isNull() | F.col("event_id").isNull()).select(*out, F.lit("kept").alias("disposition"))
    return settled.unionByName(alone)
