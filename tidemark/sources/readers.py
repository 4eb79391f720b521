"""Sources and sinks of activity data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_SCHEMA = "id string, type string, actor struct<id: string, login: string>, repo struct<id: string, name: string>, created_at string, public boolean"


def text_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(raw_json, source_uri) of gzip or plain line files; every physical line is a row."""
    return spark.read.text(list(paths)).select(F.col("value").alias("raw_json"), F.col("_metadata.file_path").alias("source_uri"))


def json_strict(spark: SparkSession, path: str) -> DataFrame:
    """Inferred schema; a damaged line fails the read."""
    return spark.read.option("mode", "FAILFAST").json(path)


def json_typed(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def many_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many Parquet paths as one relation."""
    return spark.read.parquet(*paths)


def hour_range(first: datetime, last: datetime) -> list[datetime]:
    """The hours from first to last, both included."""
    if first > last or any(t.minute or t.second or t.microsecond for t in (first, last)):
        raise ValueError("give whole hours, the first not after the last")
    return [first + timedelta(hours=i) for i in range(int((last - first).total_seconds() // 3600) + 1)]


def latest_complete_hour(now: datetime, lag_hours: int = 2) -> datetime:
    if lag_hours < 1:
        raise ValueError("the lag is at least an hour")
    return now.replace(minute=0, second=0, microsecond=0) - timedelta(hours=lag_hours)


def write_events(events: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """Hive-partitioned by date and hour, bounded files; an existing table is an error."""
    events.repartition("event_date", "event_hour").write.option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").partitionBy("event_date", "event_hour").parquet(path)


def write_formats(rows: DataFrame, root: str) -> dict[str, str]:
    """The same rows as JSON lines, gzip JSON lines, flat Parquet and hour-partitioned Parquet."""
    out = {n: f"{root}/{n}" for n in ("jsonl", "jsonl_gzip", "parquet", "parquet_by_hour")}
    rows.write.json(out["jsonl"])
    rows.write.option("compression", "gzip").json(out["jsonl_gzip"])
    rows.write.option("compression", "zstd").parquet(out["parquet"])
    rows.repartition("event_hour").write.partitionBy("event_hour").parquet(out["parquet_by_hour"])
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """Comma-separated with a header; quotes are doubled, and a null is told apart from an empty text."""
    rows.write.option("header", "true").option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").option("quoteAll", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", "true").option("nullValue", "\\N").option("emptyValue", "").csv(path)


def cached_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Repository metadata from a cache of JSON answers, one object a line; of several answers the last fetched counts.

    Fetching is not the engine's work: a collector fills the cache.
    """
    from tidemark.operators.language import METADATA

    last = W.partitionBy("repo_id").orderBy(F.desc("fetched_at"), F.xxhash64("status", "primary_language", "description"))
    rows = spark.read.schema(f"{METADATA}, fetched_at timestamp").json(path).where(F.col("repo_id") > 0)
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "fetched_at")


def usable_lines(lines: DataFrame, text: str = "raw_json", max_bytes: int = 8 << 20, on_invalid: str = "skip") -> DataFrame:
    """The lines that hold a JSON object of bounded size; blank lines are left out.

    ``on_invalid``: 'skip' leaves damaged and oversized lines out, 'raise' fails the job on the first one.
    """
    if on_invalid not in ("skip", "raise"):
        raise ValueError("on_invalid is 'skip' or 'raise'")
    from tidemark.operators.raw_lines import parse_json_lines

    there = lines.where(F.coalesce(F.trim(F.col(text)) != "", F.lit(False)))
    judged = parse_json_lines(there, text).withColumn("_good", (F.col("_p.record") == "true") & (F.octet_length(text) <= max_bytes)).drop("_p")
    if on_invalid == "raise":
        judged = judged.withColumn("_good", F.when(F.col("_good"), True).otherwise(F.raise_error(F.concat(F.lit("damaged line: "), F.substring(F.col(text), 1, 80))).cast("boolean")))
    return judged.where("_good").drop("_good")


def replay_hour(events: DataFrame, day: date, hour: int, limit: int = 250_000) -> DataFrame:
    """One hour of events with their place by time and id; between 1 and ``limit`` of them, at most 250,000."""
    if not 1 <= limit <= 250_000:
        raise ValueError("a replay holds from 1 to 250,000 events")
    rows = events.where((F.col("event_date") == F.lit(day)) & (F.col("event_hour") == hour))
    n = rows.limit(limit + 1).count()
    if not 1 <= n <= limit:
        raise ValueError(f"the hour holds {'no' if not n else 'too many'} events for a replay")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("event_date", "event_hour").orderBy("event_time", "event_id")))
