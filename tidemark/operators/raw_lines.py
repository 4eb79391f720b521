"""Rows that fail to parse: typed rows where good, ``_corrupt_record`` with the reason where not.

A line is parsed once into cells (row, column, value).  A small rule table joined on the column says which checks a
column must pass; the failed checks are gathered per row, and an anti-join with the failed rows leaves the good ones.
Only failures are shuffled: a good line costs no exchange before the anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import strict_csv, strict_json
from tidemark.session import materialize

JSON_SCHEMA = (
    "id string, type string, actor struct<id: string, login: string>, repo struct<id: string, name: string>, created_at string, public boolean, "
    "payload struct<action: string, ref: string, ref_type: string>, org struct<id: string, login: string>"
)
CSV_COLUMNS = ["event_id", "repo_id", "repo_name", "actor_id", "event_type", "payload_action", "event_time", "source_archive_start", "source_filename", "source_row", "raw_sha256"]

# Reasons in the order in which the first that applies is reported.
JSON_RULES = [
    ("record", "flag", "invalid_json_or_field_type"),
    ("event_id", "event_id", "invalid_event_id"),
    ("event_type", "event_type", "invalid_event_type"),
    ("actor_id", "positive_long", "invalid_actor_id"),
    ("actor_login", "not_blank", "missing_actor_login"),
    ("repo_id", "positive_long", "invalid_repo_id"),
    ("repo_name", "repo_name", "invalid_repo_name"),
    ("event_time", "instant", "invalid_timestamp"),
    ("public", "flag", "not_public"),
    ("payload", "flag", "missing_payload"),
]
CSV_RULES = [
    ("quoting", "flag", "broken_quoting"),
    ("columns", "flag", "wrong_column_count"),
    ("event_id", "event_id", "invalid_value"),
    ("repo_id", "positive_long", "invalid_value"),
    ("repo_name", "repo_name", "invalid_value"),
    ("actor_id", "positive_long", "invalid_value"),
    ("event_type", "event_type", "invalid_value"),
    ("event_time", "instant", "invalid_value"),
    ("source_archive_start", "instant", "invalid_value"),
    ("source_row", "digits", "invalid_value"),
    ("raw_sha256", "sha256", "invalid_value"),
]
RULES = {"json": JSON_RULES, "csv": CSV_RULES}


def instant_text(v: Column) -> Column:
    """Whether a text is an existing yyyy-MM-ddTHH:mm:ss[.fraction] with Z or an offset below 24 hours."""
    shape = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z")
    return shape & (F.substring(v, 1, 4) != "0000") & F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()


def instant(v: Column) -> Column:
    """The instant of a text that passed ``instant_text``; digits beyond microseconds are cut."""
    local = F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    micros = F.rpad(F.substring(F.regexp_extract(v, r"\.([0-9]+)", 1), 1, 6), 6, "0").cast("long")
    zone = F.regexp_extract(v, r"([+-][0-9]{2}:[0-9]{2})\z", 1)
    minutes = F.when(zone == "", 0).otherwise((F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long")) * F.when(zone.startswith("-"), -1).otherwise(1))
    return F.timestamp_micros(F.unix_micros(local) + micros - minutes * 60_000_000)


def passes(check: Column, v: Column) -> Column:
    """Whether the value passes the named check; a null value passes none."""
    digits = v.rlike(r"^[0-9]+\z")
    ok = (
        F.when(check == "flag", v == "true")
        .when(check == "event_id", v.rlike(r"^[1-9][0-9]*\z"))
        .when(check == "event_type", v.rlike(r"^[A-Z][A-Za-z0-9]*Event\z"))
        .when(check == "positive_long", digits & (F.ltrim(v, F.lit("0")).try_cast("bigint") > 0))
        .when(check == "not_blank", v.rlike(r"(?U)\S"))
        .when(check == "repo_name", v.rlike(r"(?U)^[^\s/]+/[^\s/]+\z"))
        .when(check == "instant", instant_text(v))
        .when(check == "digits", digits)
        .when(check == "sha256", v.rlike(r"^[0-9a-f]{64}\z"))
    )
    return F.coalesce(ok, F.lit(False))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Column, check and reason with its place in the order: a fixed number of rows, so it may be broadcast."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "place int, cell string, check string, reason string")


def parse_json_lines(lines: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """The lines with ``_p``, a struct of text cells by name.  A null or empty line is a damaged record.

    Without ``strict`` text after the object is no failure.
    """
    if strict:
        ok = F.col(f"_j.{strict_json.CORRUPT}").isNull() & F.col("_j.r").isNotNull() & strict_json.is_one_value(F.col(text))
        parsed = lines.withColumn("_j", strict_json.parse_object(F.col(text), JSON_SCHEMA)).withColumn("_ok", ok)
    else:
        ok = F.col(f"_j.r.{strict_json.CORRUPT}").isNull() & F.trim(text).startswith("{")
        parsed = lines.withColumn("_j", F.struct(strict_json.parse_start(F.col(text), JSON_SCHEMA).alias("r"))).withColumn("_ok", ok)
    r = F.col("_j.r")
    cells = {
        "record": F.coalesce(F.col("_ok"), F.lit(False)).cast("string"),
        "event_id": r["id"],
        "event_type": r["type"],
        "actor_id": r["actor"]["id"],
        "actor_login": r["actor"]["login"],
        "repo_id": r["repo"]["id"],
        "repo_name": r["repo"]["name"],
        "event_time": r["created_at"],
        "public": r["public"].cast("string"),
        "payload": r["payload"].isNotNull().cast("string"),
        "payload_action": r["payload"]["action"],
        "payload_ref": r["payload"]["ref"],
        "payload_ref_type": r["payload"]["ref_type"],
        "org_id": r["org"]["id"],
        "org_login": r["org"]["login"],
    }
    return parsed.withColumn("_p", F.struct(*[v.alias(k) for k, v in cells.items()])).drop("_j", "_ok")


def parse_csv_lines(lines: DataFrame, text: str) -> DataFrame:
    """As ``parse_json_lines``.  Fields are read only from lines with sound quoting and the right number of them."""
    line = F.col(text)
    sound = lines.withColumn("_q", strict_csv.well_formed(line))
    sound = sound.withColumn("_n", F.when(F.col("_q"), strict_csv.field_count(line) == len(CSV_COLUMNS)))
    sound = sound.withColumn("_c", F.when(F.col("_n"), strict_csv.fields(line, CSV_COLUMNS)))
    cells = [F.col("_q").cast("string").alias("quoting"), F.coalesce(F.col("_n"), F.lit(False)).cast("string").alias("columns"), *[F.col(f"_c.{c}").alias(c) for c in CSV_COLUMNS]]
    return sound.withColumn("_p", F.struct(*cells)).drop("_q", "_n", "_c")


def failures(parsed: DataFrame, row_key: list[str], rules: list[tuple[str, str, str]]) -> DataFrame:
    """(row_key, errors): the reasons of each failed row in rule order, each reason once."""
    spark = parsed.sparkSession
    cells = parsed.select(*row_key, F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"_p.{c}").alias("value")) for c in dict.fromkeys(r[0] for r in rules)])).alias("_cell")).select(*row_key, "_cell.*")
    checked = cells.join(F.broadcast(rule_table(spark, rules)), "cell").where(~passes(F.col("check"), F.col("value")))
    # At most as many errors a row as there are rules; the set also drops repeats of rows with the same key.
    return checked.groupBy(*row_key).agg(F.array_sort(F.collect_set(F.struct("place", "reason"))).alias("_e")).select(*row_key, F.array_distinct(F.col("_e.reason")).alias("errors"))


def _keyed(lines: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """The key of a row is its own key and a hash of its text, so rows that share a key are still judged apart.

    Only the key, the text and the source come along: further columns cannot clash with anything.
    """
    source = F.col("source_uri") if "source_uri" in lines.columns else F.lit(None).cast("string")
    return lines.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(text, F.lit("")), F.col(text).isNull()).alias("_text"), F.col(text).alias(text), source.alias("source_uri")), ["_key", "_text"]


def judge_lines(lines: DataFrame, kind: str, key: str = "line_id", text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed lines with _key, _text, _p; failures with errors) for kind 'json' or 'csv'."""
    text = text or {"json": "raw_json", "csv": "raw_csv"}[kind]
    keyed, row_key = _keyed(lines, key, text)
    parsed = (parse_json_lines if kind == "json" else parse_csv_lines)(keyed, text)
    return parsed, failures(parsed, row_key, RULES[kind])


def first_reasons(lines: DataFrame, kind: str, key: str = "line_id") -> DataFrame:
    """(key, reason): each damaged line with the first reason that applies; equal lines under one key count once."""
    return judge_lines(lines, kind, key)[1].select(F.col("_key").alias(key), F.element_at("errors", 1).alias("reason"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_key"].eqNullSafe(b["_key"]) & (a["_text"] == b["_text"])


def load_lines(lines: DataFrame, kind: str, key: str = "line_id", text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good typed rows, bad rows with key, source_uri, _corrupt_record and reasons).

    Every physical line comes out exactly once, on one side: repeated lines and lines with a null key included.  A
    null or empty line is damaged.  Further columns of the input are left out.
    """
    text = text or {"json": "raw_json", "csv": "raw_csv"}[kind]
    parsed, _ = judge_lines(lines, kind, key, text)
    parsed = materialize(parsed, "parsed-lines")  # every line is parsed once, for good and bad rows alike
    bad = failures(parsed, ["_key", "_text"], RULES[kind])
    clean = parsed.join(bad, _same(parsed, bad), "left_anti")
    p = lambda name: F.col(f"_p.{name}")
    common = [F.col("_key").alias(key), p("event_id").alias("event_id"), p("event_type").alias("event_type"), p("actor_id").cast("long").alias("actor_id"), p("repo_id").cast("long").alias("repo_id"), p("repo_name").alias("repo_name"), instant(p("event_time")).alias("event_time")]
    if kind == "json":
        more = [p("actor_login").alias("actor_login"), p("org_id").try_cast("long").alias("org_id"), p("org_login").alias("org_login"), p("payload_action").alias("payload_action"), F.get_json_object(text, "$.payload").alias("payload_json"), F.sha2(text, 256).alias("raw_record_sha256")]
    else:
        more = [F.nullif(p("payload_action"), F.lit("")).alias("payload_action"), instant(p("source_archive_start")).alias("source_archive_start"), p("source_filename").alias("source_filename"), p("source_row").try_cast("long").alias("source_row"), p("raw_sha256").alias("raw_record_sha256")]
    good = clean.select(*common, *more, "source_uri")
    corrupt = parsed.join(bad.withColumnsRenamed({"_key": "_k2", "_text": "_t2"}), F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_text") == F.col("_t2")))
    return good, corrupt.select(F.col("_key").alias(key), "source_uri", F.col(text).alias("_corrupt_record"), F.element_at("errors", 1).alias("reason"), "errors")
