"""The historical corpus: comma-separated lines to one clean Parquet table, and roll-ups of what was collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.raw_lines import load_lines
from tidemark.operators.skew import rank_in_blocks
from tidemark.sources import storage

COLLECTED = "filename string, status string, compressed_bytes long, records long, reused_download boolean, reused_validation boolean, reused_publication boolean, type_counts map<string, long>"


class TooManyRejected(RuntimeError):
    """More lines were damaged than the corpus allows; nothing was published."""


def first_rows(rows: DataFrame) -> DataFrame:
    """Each event_id once: the row of the earliest archive (nulls last), then filename, source row and hash."""
    never = F.lit("9999-12-31").cast("timestamp")
    order = [F.coalesce("source_archive_start", never), F.coalesce("source_filename", F.lit("")), F.coalesce("source_row", F.lit(-1).cast("long")), F.coalesce("raw_record_sha256", F.lit(""))]
    return rank_in_blocks(rows.where(F.col("event_id").isNotNull()), ["event_id"], order, "_rank").where("_rank = 1").drop("_rank")


def write_corpus(spark: SparkSession, lines: DataFrame, place: str, most_rejected: float = 0.01) -> dict[str, int]:
    """Good lines as zstd Parquet in ``place``/events, damaged ones with their reason as JSON lines in ``place``/quarantine.

    Refused, with nothing left behind, if more than the share ``most_rejected`` of all lines is damaged, or none is good.
    Returns the counts of both.
    """
    if not 0 <= most_rejected <= 1:
        raise ValueError("a share lies between 0 and 1")
    staged = f"{place}-staged"
    storage.delete(spark, staged)
    good, bad = load_lines(lines, "csv")
    good.drop("line_id").write.option("compression", "zstd").parquet(f"{staged}/events")
    bad.write.json(f"{staged}/quarantine")
    n = {"events": spark.read.parquet(f"{staged}/events").count(), "quarantine": spark.read.text(f"{staged}/quarantine").count() if storage.folders(spark, f"{staged}/quarantine") else 0}
    if not n["events"] or n["quarantine"] > most_rejected * sum(n.values()):
        storage.delete(spark, staged)
        raise TooManyRejected(f"{n['quarantine']} of {sum(n.values())} lines are damaged")
    storage.rename(spark, staged, place)
    return n


def collected(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    """Results of a collection, one row per wanted archive, from driver objects; missing fields are null."""
    names = [c.split()[0] for c in COLLECTED.replace("map<string, long>", "map").split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], COLLECTED)


def roll_up(results: DataFrame) -> DataFrame:
    """One row: complete and missing archives, bytes, records, reused steps of the complete ones, and the status."""
    done = F.col("status") == "complete"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0))
    out = results.agg(
        F.count("*").alias("wanted"), F.count_if(done).alias("completed"), F.count_if(~F.coalesce(done, F.lit(False))).alias("missing"),
        total("compressed_bytes").alias("compressed_bytes"), total("records").alias("validated_records"), F.count_if(done & ~F.coalesce("reused_download", F.lit(False))).alias("downloaded_files"),
        *[F.count_if(done & F.col(f"reused_{x}")).alias(f"reused_{x}s") for x in ("download", "validation", "publication")],
    )
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("wanted") > 0), "complete").otherwise("failed"))


def type_totals(results: DataFrame) -> DataFrame:
    """(event_type, records) over all complete archives."""
    return results.where("status = 'complete'").select(F.explode("type_counts").alias("event_type", "n")).groupBy("event_type").agg(F.sum("n").alias("records"))
