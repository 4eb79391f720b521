"""Source lists of a build: which archives, with which checksums, merged across builds."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = re.compile(r"(\d{4}-\d{2}-\d{2})-(\d{1,2})\.json\.gz")


class SourceChanged(ValueError):
    """An archive that a build already used came with another checksum."""


def plan_sources(entries: Iterable[dict], hours: Sequence[datetime] | None = None) -> list[dict]:
    """Usable archives (status 'ok', a proper name, a sha256) of the wanted hours, in order of time.

    A wanted hour without its archive is an error.
    """
    found = {}
    for e in entries:
        m = ARCHIVE.fullmatch(e.get("filename", ""))
        if not m or not 0 <= int(m[2]) <= 23:
            raise ValueError(f"not an archive name: {e.get('filename')!r}")
        if e.get("status") != "ok":
            continue
        if not re.fullmatch("[0-9a-f]{64}", e.get("sha256") or ""):
            raise ValueError(f"{e['filename']} has no checksum")
        hour = datetime.strptime(m[1], "%Y-%m-%d").replace(hour=int(m[2]))
        if hour in found and found[hour]["sha256"] != e["sha256"]:
            raise SourceChanged(e["filename"])
        found[hour] = {**e, "hour": hour}
    if hours is not None:
        missing = [h for h in hours if h not in found]
        if missing:
            raise ValueError(f"no archive for {missing[0]:%Y-%m-%d-%H}")
        found = {h: found[h] for h in hours}
    return [found[h] for h in sorted(found)]


def merge_sources(existing: Iterable[dict], incoming: Iterable[dict]) -> list[dict]:
    """Both lists as one, by filename; a changed checksum is refused."""
    merged = {e["filename"]: e for e in existing}
    for e in incoming:
        old = merged.setdefault(e["filename"], e)
        if old["sha256"] != e["sha256"]:
            raise SourceChanged(e["filename"])
    return [merged[k] for k in sorted(merged)]


def count_against(lines: DataFrame, sources: Sequence[dict]) -> DataFrame:
    """(filename, lines, records): archives whose physical lines differ from the records their source entry promises."""
    promised = lines.sparkSession.createDataFrame([(s["filename"], s["records"]) for s in sources], "filename string, records long")
    there = lines.groupBy(F.regexp_extract("source_uri", r"([^/]+)$", 1).alias("filename")).agg(F.count("*").alias("lines"))
    both = there.join(promised, "filename", "full")
    return both.where(~F.col("lines").eqNullSafe(F.col("records"))).select("filename", "lines", "records")


def read_planned(spark: SparkSession, sources: Sequence[dict]) -> DataFrame:
    from tidemark.sources.readers import text_lines

    return text_lines(spark, [s["uri"] for s in sources])
