"""Quality and shape of raw records: missing fields, duplicates, histograms, JSON paths, samples."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from tidemark.session import materialize, send_by_value

UNREADABLE = "unreadable"
FIELDS = ["id", "type", "actor.id", "actor.login", "repo.id", "repo.name", "created_at", "public", "payload"]


def field_quality(lines: DataFrame, text: str = "raw_json") -> DataFrame:
    """Per field: absent, null and blank records and the percentage missing.  ``lines`` holds valid JSON objects.

    One pass: each record yields a state per field, counted map-side.
    """
    top = F.json_object_keys(F.col(text))

    def state(field: str) -> Column:
        parent, _, leaf = field.rpartition(".")
        keys = F.json_object_keys(F.get_json_object(text, f"$.{parent}")) if parent else top
        there = F.coalesce(F.array_contains(keys, leaf), F.lit(False))
        value = F.get_json_object(text, f"$.{field}")
        return F.when(~there, "absent").when(value.isNull(), "null").when(F.trim(value) == "", "blank").otherwise("present")

    states = lines.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in FIELDS])).alias("_s")).select("_s.*")
    out = states.groupBy("field").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("absent", "null", "blank")], F.count("*").alias("_n"))
    missing = F.col("absent") + F.col("null") + F.col("blank")
    return out.select("field", "absent", "null", "blank", missing.alias("missing_total"), (missing * 100.0 / F.col("_n")).alias("missing_percent"))


def duplicate_ids(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def type_counts(events: DataFrame, missing: str = "<missing>") -> DataFrame:
    """Events per type, those without a type under a name of their own."""
    return events.groupBy(F.coalesce("event_type", F.lit(missing)).alias("event_type")).agg(F.count("*").alias("events"))


def unique_ids(events: DataFrame, public: Column | None = None) -> DataFrame:
    """One row: different ids of events, repositories and accounts, and of public events only, one reduction per id."""
    told = F.coalesce(public, F.lit(False)) if public is not None else F.lit(True)
    out = None
    for name, c in (("events", "event_id"), ("repositories", "repo_id"), ("accounts", "actor_id")):
        ids = events.where(F.col(c).isNotNull()).groupBy(c).agg(F.max(told.cast("int")).alias("_p"))
        one = ids.agg(F.count("*").alias(f"unique_{name}"), F.count_if(F.col("_p") == 1).alias(f"public_{name}")).withColumn("_one", F.lit(1))
        out = one if out is None else out.join(one, "_one")
    return out.drop("_one")


def overview(events: DataFrame) -> DataFrame:
    """Records, ids that repeat, records with repeated ids and excess records."""
    ids = events.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > 1, F.col("n"))
    return ids.agg(F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("duplicate_event_ids"), F.coalesce(F.sum(more), F.lit(0)).alias("records_with_duplicated_ids"), F.coalesce(F.sum(more - 1), F.lit(0)).alias("duplicate_excess_records"))


def ranking(events: DataFrame, key: str, name: str, order: Column, limit: int = 20) -> DataFrame:
    """Raw event counts per id with the last known name; the id stands in for a missing name."""
    out = events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("events"), F.max_by(name, F.when(F.col(name).isNotNull(), order)).alias("name"))
    return out.withColumn("name", F.coalesce("name", F.col("id").cast("string"))).orderBy(F.desc("events"), "id").limit(limit)


def events_per_minute(events: DataFrame) -> DataFrame:
    """Counts per minute with empty minutes between the first and the last."""
    minute = F.floor(F.unix_seconds("event_time") / 60)
    counts = events.where(F.col("event_time").isNotNull()).groupBy(minute.alias("m")).agg(F.count("*").alias("events"))
    span = counts.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo is not null")
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("m"))
    return grid.join(counts, "m", "left").select(F.date_format(F.timestamp_seconds(F.col("m") * 60), "yyyy-MM-dd HH:mm").alias("utc_minute"), F.coalesce("events", F.lit(0)).alias("events"))


def account_bins(accounts: DataFrame, column: str = "total_events") -> DataFrame:
    """Accounts per activity bin: (0,1], (1,5], (5,10], (10,50], (50,inf)."""
    c = F.col(column)
    label = F.when(c <= 1, "1").when(c <= 5, "2-5").when(c <= 10, "6-10").when(c <= 50, "11-50").otherwise("51+")
    return accounts.where(c > 0).groupBy(label.alias("bin")).agg(F.count("*").alias("accounts"))


def _walk(value: object, path: str, found: dict[str, set[str]]) -> None:
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        found.setdefault(p or "$", set()).add(kind)
        if isinstance(v, dict):
            stack += [(x, f"{p}.{k}" if p else k) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, f"{p}[]") for x in v]


def json_paths(lines: DataFrame, text: str = "raw_json") -> DataFrame:
    """(event_type, path, types, records): every path of valid JSON records, with the set of types it takes in a record.
    Records that cannot be read are counted under an empty path with the type 'unreadable'.

    The depth is open, so records are walked in Python, in Arrow batches; a batch is counted before it leaves Python.
    """

    def discover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[tuple[str, str, str], int] = {}
            for s in b[text]:
                try:
                    record = json.loads(s, parse_int=lambda _: 0)
                except (ValueError, TypeError, RecursionError):
                    counts["", "", UNREADABLE] = counts.get(("", "", UNREADABLE), 0) + 1
                    continue
                found: dict[str, set[str]] = {}
                _walk(record, "", found)
                kind = record.get("type") if isinstance(record, dict) and isinstance(record.get("type"), str) else ""
                for p, types in found.items():
                    k = (kind, p, ",".join(sorted(types)))
                    counts[k] = counts.get(k, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["event_type", "path", "types", "n"])

    return lines.select(text).mapInPandas(discover, "event_type string, path string, types string, n long").groupBy("event_type", "path", "types").agg(F.sum("n").alias("records"))


def uniform_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, each as likely as any other, the same for the same seed: those with the smallest seeded hash of the key."""
    if n < 0:
        raise ValueError("n must not be negative")
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n).orderBy(key)


def result_digest(rows: DataFrame, total: str) -> DataFrame:
    """Rows, the sum of a column, and an order-free checksum: equal for equal results of two configurations."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("rows"), F.sum(total).alias("total"), F.sum(h).cast("decimal(38,0)").alias("checksum"))


def read_stats(lines: DataFrame, text: str = "raw_json", max_bytes: int = 8 << 20) -> DataFrame:
    """Lines, blank lines, lines over the size limit and lines that are no JSON object."""
    from tidemark.operators.raw_lines import parse_json_lines

    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    long = F.octet_length(text) > max_bytes
    parsed = parse_json_lines(lines.select(text), text)
    return parsed.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(long).alias("too_long"), F.count_if(~blank & ~F.coalesce(long, F.lit(False)) & (F.col("_p.record") != "true")).alias("invalid"))


def delays(rows: DataFrame, begun: str, done: str) -> DataFrame:
    """One row: mean, 95th percentile (a delay that occurs) and greatest delay in seconds, from a histogram of whole seconds."""
    from tidemark.operators.learn import exact_quantile

    d = rows.select((F.unix_seconds(done) - F.unix_seconds(begun)).alias("d")).where(F.col("d").isNotNull())
    histogram = materialize(d.groupBy("d").agg(F.count("*").alias("n")), "delays")
    p95 = exact_quantile(histogram, "d", "n", 0.95)
    return histogram.agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_seconds"), F.lit(None if p95 is None else float(p95)).cast("double").alias("p95_seconds"), F.max("d").cast("double").alias("max_seconds"))


def trial_stats(trials: DataFrame, keys: Sequence[str], seconds: str = "seconds") -> DataFrame:
    """Trials and their least, median and greatest time per configuration; a configuration has few trials."""
    return trials.groupBy(*keys).agg(F.count(seconds).alias("trials"), F.min(seconds).alias("least"), F.median(seconds).alias("median"), F.max(seconds).alias("greatest"))


send_by_value(__name__)
