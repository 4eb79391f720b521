"""Late and out-of-order events: minutes by event time, corrected as late records arrive, up to a cut-off.

Each batch touches some hours.  Their minutes are recomputed entirely from the retained raw events of those hours and
replace the published ones in one step, by a manifest that names the current files of every hour; hours nobody touched
are not read.  An event is late when it lies more than the run's ``late_after_seconds`` behind the greatest event time of
earlier batches; beyond ``cutoff_seconds`` it is dropped and reopens nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.deliveries import commit_ranges, settle_deliveries
from tidemark.operators.skew import lookup_join, running_max, salted_join
from tidemark.session import scratch
from tidemark.sources import storage

EVENT_COLUMNS = ("event_time", "event_type", "payload_action", "actor_id")


def minute_of(instant: Column) -> Column:
    return F.date_trunc("minute", instant)


def watermarks(kept: DataFrame, runs: DataFrame) -> DataFrame:
    """Per (stream_id, batch_id): ``seen`` (greatest event time of earlier batches), late_from and cut_from.

    An event before late_from is late, one before cut_from is dropped.  Both are null (nothing is late) in a stream's
    first batch and in streams without a run.  A run listed twice counts with its greater limits.
    """
    limits = runs.groupBy("stream_id").agg(F.max("late_after_seconds").alias("_late"), F.max("cutoff_seconds").alias("_cut"))
    batches = kept.groupBy("stream_id", "batch_id").agg(F.max("event_time").alias("_latest"))
    seen = running_max(batches, "stream_id", "batch_id", "_latest", "seen").join(limits, "stream_id", "left")
    back = lambda seconds: F.timestamp_micros(F.unix_micros("seen") - F.col(seconds).cast("long") * 1_000_000)
    return seen.select("stream_id", "batch_id", "seen", back("_late").alias("late_from"), back("_cut").alias("cut_from"))


def outcome() -> Column:
    """dropped, late or on_time, from event_time and the batch's limits; an event without a time is on_time."""
    t = F.col("event_time")
    return F.when(t < F.col("cut_from"), "dropped").when(t < F.col("late_from"), "late").otherwise("on_time")


def judged_messages(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """All kept messages with outcome, is_late (late or dropped) and the columns the minute totals need.

    Messages with a null stream, batch or time are never late; an empty table gives an empty result.
    """
    kept = settle_deliveries(messages, carry=EVENT_COLUMNS).where("disposition = 'kept'").drop("disposition")
    judged = salted_join(kept, watermarks(kept, runs).drop("seen"), ["stream_id", "batch_id"], ["delivery_id"], "left")
    return judged.withColumn("outcome", outcome()).withColumn("is_late", F.col("outcome") != "on_time").drop("late_from", "cut_from")


NO_HOUR = "none"  # where events without a time are kept


def hour_of(instant: Column) -> Column:
    return F.coalesce(F.date_format(instant, "yyyy-MM-dd-HH"), F.lit(NO_HOUR))


def touched_periods(batch: DataFrame) -> list[str]:
    """The hours whose minutes a batch changes; what lies beyond the cut-off changes none."""
    return sorted(r[0] for r in batch.where("outcome <> 'dropped'").select(hour_of(F.col("event_time")).alias("hour")).distinct().collect())


MINUTES = "stream_id string, minute_utc timestamp, total_events long, star_events long, fork_events long, active_accounts long, late_corrections long"


class PeriodTable:
    """Retained events and the minutes made of them, by hour.

    Every batch writes one folder of events, sorted by hour so that a read of some hours skips the rest, and one folder
    with the minutes of the hours it touched.  The manifest says which folder holds the current minutes of an hour; a new
    version of it makes a batch visible as a whole.  A version is claimed exclusively, so of two writers one fails.  A
    batch that was applied before changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch(spark, "periods")

    def manifest(self) -> dict:
        names = [n for n in storage.children(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return {"batches": {}, "minutes": {}, "schema": None}
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/manifest/{names[-1]}").first()[0])

    def _read(self, kind: str, m: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(m["schema"])).add("hour", "string")
        paths = [f"{p}/{kind}" for p in m["batches"].values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def events(self, hours: list[str] | None = None, m: dict | None = None) -> DataFrame:
        """The retained events of some hours or all, with the outcome stored when their batch came."""
        rows = self._read("events", m or self.manifest())
        return (rows if hours is None else rows.where(F.col("hour").isin(*hours))).drop("hour")

    def dropped(self) -> DataFrame:
        return self._read("dropped", self.manifest()).drop("hour")

    def minutes(self) -> DataFrame:
        """The current minutes: of every hour those of the last batch that touched it."""
        m = self.manifest()
        if not m["minutes"]:
            return self.spark.createDataFrame([], MINUTES)
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/minutes/[^/]*$", 1).alias("_folder")
        places = {m["batches"][n] for n in m["minutes"].values()}
        rows = self.spark.read.schema(f"{MINUTES}, hour string").parquet(*[f"{p}/minutes" for p in sorted(places)]).select("*", folder)
        now = self.spark.createDataFrame([(h, m["batches"][n].rsplit("/", 1)[1]) for h, n in m["minutes"].items()], "hour string, _folder string")
        return lookup_join(rows, now, ["hour", "_folder"], ["minute_utc"]).drop("hour", "_folder")

    def apply(self, batch: DataFrame, name: str) -> list[str]:
        """Take in one batch of judged messages; returns the hours recomputed."""
        m = self.manifest()
        if name in m["batches"]:
            return []
        work = f"{self.root}/data/{uuid.uuid4().hex[:12]}"
        m["schema"] = m["schema"] or batch.schema.json()
        hours = touched_periods(batch)
        rows = batch.withColumn("hour", hour_of(F.col("event_time")))
        gone = F.col("outcome").eqNullSafe(F.lit("dropped"))
        rows.where(~gone).sortWithinPartitions("hour").write.parquet(f"{work}/events")
        rows.where(gone).write.parquet(f"{work}/dropped")
        m["batches"][name] = work
        retained = self.events(hours, m).where("stream_id is not null and event_time is not null")
        minute_totals(retained).withColumn("hour", hour_of(F.col("minute_utc"))).write.parquet(f"{work}/minutes")
        m["minutes"].update({h: name for h in hours if h != NO_HOUR})
        version = f"{self.root}/manifest/{len(m['batches']):08d}"
        if not storage.claim(self.spark, f"{version}.claim"):
            raise RuntimeError(f"another writer made version {len(m['batches'])}")
        storage.write_text(self.spark, f"{version}.json", json.dumps(m))
        return hours


def repaired(messages: DataFrame, runs: DataFrame, batches: int = 4) -> PeriodTable:
    """The messages taken in batch by batch, a batch being a range of commits of about equally many rows.

    Lateness is judged by commit, so where the batches are cut changes no result.
    """
    spark = messages.sparkSession
    judged = judged_messages(messages, runs)
    number, n = commit_ranges(messages.where(F.col("batch_id").isNotNull()), "batch_id", batches)
    place = scratch(spark, "judged")
    judged.withColumn("_batch", number).write.partitionBy("_batch").parquet(place)
    table = PeriodTable(spark)
    for i in range(n):
        part = f"{place}/_batch={i}"
        table.apply(spark.read.schema(judged.schema).parquet(part) if storage.exists(spark, part) else spark.createDataFrame([], judged.schema), f"commits-{i}")
    return table


def late_messages(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(delivery_id, outcome) of the kept messages that are late or dropped, as the batches stored them."""
    table = repaired(messages, runs)
    late = table.events().where("outcome = 'late'").select("delivery_id", "outcome")
    return late.unionByName(table.dropped().select("delivery_id", "outcome"))


def lateness(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(delivery_id, is_late) of all kept messages."""
    table = repaired(messages, runs)
    return table.events().unionByName(table.dropped()).select("delivery_id", "is_late")


def minute_totals(events: DataFrame) -> DataFrame:
    """The minute table of retained events: exact distinct accounts by two levels, so a hot minute is spread by account."""
    by_account = (
        events.withColumn("minute_utc", minute_of(F.col("event_time")))
        .groupBy("stream_id", "minute_utc", "actor_id")
        .agg(
            F.count("*").alias("n"),
            F.count_if((F.col("event_type") == "WatchEvent") & (F.col("payload_action") == "started")).alias("stars"),
            F.count_if(F.col("event_type") == "ForkEvent").alias("forks"),
            F.count_if(F.col("outcome") == "late").alias("late"),
        )
    )
    return by_account.groupBy("stream_id", "minute_utc").agg(
        F.sum("n").alias("total_events"), F.sum("stars").alias("star_events"), F.sum("forks").alias("fork_events"), F.count("actor_id").alias("active_accounts"), F.sum("late").alias("late_corrections")
    )


def repaired_minutes(messages: DataFrame, runs: DataFrame, published: DataFrame) -> DataFrame:
    """The minute table after all batches: touched minutes recomputed, untouched ones as published, each key once.

    A touched minute whose events were all dropped disappears.  Of an untouched minute published twice the row with
    the greatest counts stays.  Events without a stream or time belong to no minute.
    """
    table = repaired(messages, runs)
    fresh = table.minutes()
    gone = table.dropped().where("stream_id is not null and event_time is not null").select("stream_id", minute_of(F.col("event_time")).alias("minute_utc"))
    touched = fresh.select("stream_id", "minute_utc").unionByName(gone).distinct()
    counts = ["total_events", "star_events", "fork_events", "active_accounts", "late_corrections"]
    stale = published.groupBy("stream_id", "minute_utc").agg(F.max(F.struct(*counts)).alias("_c")).select("stream_id", "minute_utc", "_c.*")
    return fresh.unionByName(stale.join(touched, ["stream_id", "minute_utc"], "left_anti"))
