"""Queries of Silver, sources, exploration, the stream ledger and the models, with SQL where SQL can say it."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.model import EVENT_TYPES
from tidemark.operators import explore as ex
from tidemark.operators import learn as le
from tidemark.operators import corpus, language, raw_lines, silver
from tidemark.operators import serving as sv
from tidemark.operators.skew import rank_in_blocks
from tidemark.plans.activity_queries import EV, MEASURES, events, rounded
from tidemark.plans.pipeline_queries import P1_SQL
from tidemark.plans.registry import Registry
from tidemark.session import materialize, scratch
from tidemark.sources import readers, snapshots, storage
from tidemark.sources.tables import table
from tidemark.streaming import ledger

MORE = Registry()

# ---------------------------------------------------------------- sources and sinks


@MORE.add("src_text_lines", "select raw_json from raw_lines")
def src_text_lines(spark, folder):
    place = scratch(spark, "lines")
    table(spark, folder, "raw_lines").select("raw_json").write.option("compression", "gzip").text(place)
    return readers.text_lines(spark, [place]).select("raw_json")


@MORE.add("src_json_infer", P1_SQL + "select id, type, t as created_at from c where record")
def src_json_infer(spark, folder):
    """The usable lines, read back with an inferred schema; a damaged line would fail the read (tested)."""
    place = scratch(spark, "good-lines")
    readers.usable_lines(table(spark, folder, "raw_lines").select("raw_json")).write.text(place)
    return readers.json_strict(spark, place).select(F.col("id").cast("string").alias("id"), "type", F.col("created_at").cast("string").alias("created_at"))


@MORE.add("src_parquet_projection", "select event_id, repo_id from silver_events where event_type = 'ForkEvent'")
def src_parquet_projection(spark, folder):
    """A narrow scan of the hive-partitioned table."""
    return _by_hour(spark, folder).where("event_type = 'ForkEvent'").select("event_id", "repo_id")


@MORE.add("src_multi_path", "select event_type, count(*) * 2 as n from silver_events group by 1")
def src_multi_path(spark, folder):
    path = f"{folder}/silver_events.parquet"
    return readers.many_paths(spark, [path, path]).groupBy("event_type").agg(F.count("*").alias("n"))


def _by_hour(spark, folder):
    place = scratch(spark, "by-hour")
    readers.write_events(table(spark, folder, "silver_events").select("event_id", "event_type", "repo_id", "event_date", "event_hour"), place)
    return spark.read.parquet(place)


@MORE.add("src_partition_filter", "select event_id, event_date from silver_events where event_hour = 12 and event_date = date '2026-01-08'")
def src_partition_filter(spark, folder):
    return _by_hour(spark, folder).where("event_hour = 12 and event_date = date'2026-01-08'").select("event_id", "event_date")


@MORE.add("bench_storage_json", "select event_type, count(*) as n from silver_events where event_hour = 12 group by 1")
def bench_storage_json(spark, folder):
    place = scratch(spark, "json")
    table(spark, folder, "silver_events").select("event_id", "event_type", "event_hour").write.option("compression", "gzip").json(place)
    return readers.json_typed(spark, place, "event_id string, event_type string, event_hour int").where("event_hour = 12").groupBy("event_type").agg(F.count("*").alias("n"))


@MORE.add("snk_formats", "select f as format, n from (values ('jsonl'), ('jsonl_gzip'), ('parquet'), ('parquet_by_hour')) t(f), (select count(*) as n from silver_events where event_hour = 12)")
def snk_formats(spark, folder):
    """The same rows in four formats, each read back with the hour filter."""
    out = readers.write_formats(table(spark, folder, "silver_events").select("event_id", "event_type", "event_hour"), scratch(spark, "formats"))
    schema = "event_id string, event_type string, event_hour int"
    counts = None
    for name, path in out.items():
        rows = readers.json_typed(spark, path, schema) if name.startswith("json") else spark.read.parquet(path)
        one = rows.where("event_hour = 12").agg(F.count("*").alias("n")).select(F.lit(name).alias("format"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@MORE.add("src_driver_rows", "select repo_id::bigint as repo_id, language, language_bytes::bigint as language_bytes, byte_share::double as byte_share from (values (1, 'C', 30, 0.75), (1, 'Go', 10, 0.25), (2, 'No language reported', 0, 1.0), (3, 'Metadata unavailable', 0, 1.0)) t(repo_id, language, language_bytes, byte_share)")
def src_driver_rows(spark, folder):
    """Rows made of objects on the driver, with a fixed schema, and their language shares."""
    entries = [{"repo_id": 1, "status": "ok", "language_bytes": {"Go": 10, "C": 30, "Vim": 0}}, {"repo_id": 2, "status": "ok"}, {"repo_id": 3, "status": "not_found"}]
    return language.language_shares(language.metadata_frame(spark, entries))


@MORE.add("result_digest", EV + "select count(*) as rows, sum(n)::bigint as total, true as equal from (select repo_id, count(*) as n from ev group by 1)")
def result_digest(spark, folder):
    """The flagship counts by two plans, with and without a reduction by account first: their digests agree."""
    ev = events(spark, folder)
    plain = ev.groupBy("repo_id").agg(F.count("*").alias("n"))
    by_account = ev.groupBy("repo_id", "actor_id").agg(F.count("*").alias("k")).groupBy("repo_id").agg(F.sum("k").alias("n"))
    a, b = (ex.result_digest(df, "n").withColumnsRenamed({c: f"{c}_{i}" for c in ("rows", "total", "checksum")}).withColumn("_one", F.lit(1)) for i, df in enumerate((plain, by_account)))
    same = (F.col("rows_0") == F.col("rows_1")) & (F.col("total_0") == F.col("total_1")) & (F.col("checksum_0") == F.col("checksum_1"))
    return a.join(b, "_one").select(F.col("rows_0").alias("rows"), F.col("total_0").alias("total"), same.alias("equal"))


@MORE.add("hour_range_plan", "select strftime(timestamp '2026-01-05' + to_hours(i), '%Y-%m-%d-') || hour(timestamp '2026-01-05' + to_hours(i)) as archive from range(49) t(i)")
def hour_range_plan(spark, folder):
    hours = readers.hour_range(datetime(2026, 1, 5), datetime(2026, 1, 7))
    return spark.createDataFrame([(f"{h:%Y-%m-%d}-{h.hour}",) for h in hours], "archive string")


# ---------------------------------------------------------------- Silver


def lines(spark, folder):
    """The settled raw lines, strict so that SQL can say the same."""
    return silver.settled(silver.normalize(table(spark, folder, "raw_lines"), strict=True))


_ID = lambda c: f"coalesce(regexp_full_match({c}, '[0-9]+') and try_cast(ltrim({c}, '0') as bigint) > 0, false)"
_SETTLED_LINES = (
    """with j as (select raw_json, source_uri, case when json_valid(raw_json) and not regexp_matches(raw_json, ',\\s*[}\\]]|[:,\\[]\\s*-?(?i:nan|inf|infinity)\\s*[,}\\]]') then case when json_type(raw_json) = 'OBJECT' then raw_json::json end end as o from raw_lines),
c as (select raw_json, source_uri, sha256(raw_json) as raw_record_sha256, regexp_extract(source_uri, '([^/]+)$', 1) as source_filename,
  o is not null and """
    + " and ".join(f"coalesce(json_type(o, '$.{x}'), 'NULL') in ('OBJECT', 'NULL')" for x in ("actor", "repo", "payload", "org"))
    + """ and coalesce(json_type(o, '$.public'), 'NULL') in ('BOOLEAN', 'NULL') as record,
  trim(o->>'$.id', ' ') as event_id, trim(o->>'$.type', ' ') as event_type, trim(o->>'$.actor.id', ' ') as actor, trim(o->>'$.actor.login', ' ') as actor_login, trim(o->>'$.repo.id', ' ') as repo,
  trim(o->>'$.repo.name', ' ') as repo_name, trim(o->>'$.created_at', ' ') as t, o->>'$.public' as public, coalesce(json_type(o, '$.payload'), 'NULL') <> 'NULL' as payload, o->>'$.payload.action' as payload_action, trim(o->>'$.org.id', ' ') as org from j),
k as (select *, coalesce(regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') and try_strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S') is not null and left(t, 4) <> '0000', false) as timed,
  try_strptime(regexp_extract(source_filename, '^([0-9]{4}-[0-9]{2}-[0-9]{2})-', 1) || '-' || regexp_extract(source_filename, '-([0-9]{1,2})[.]json[.]gz$', 1), '%Y-%m-%d-%H') as started from c),
e as (select *, case when timed then epoch_us(try_strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S')) + coalesce(try_cast(rpad(left(regexp_extract(t, '[.]([0-9]+)', 1), 6), 6, '0') as bigint), 0)
    - case when right(t, 1) = 'Z' then 0 else (case when left(right(t, 6), 1) = '-' then -1 else 1 end) * (substr(right(t, 6), 2, 2)::bigint * 60 + right(t, 2)::bigint) * 60000000 end end as event_us,
  list_filter([case when not record then 'invalid_json_or_field_type' end, case when strlen(raw_json) > 8388608 then 'record_exceeds_8_mib' end,
    case when not coalesce(regexp_full_match(event_id, '[1-9][0-9]*'), false) then 'invalid_event_id' end, case when not coalesce(regexp_full_match(event_type, '[A-Z][A-Za-z0-9]*Event'), false) then 'invalid_event_type' end,
    case when not """
    + _ID("actor")
    + r""" then 'invalid_actor_id' end, case when not coalesce(regexp_matches(actor_login, '[^\s\pZ]'), false) then 'missing_actor_login' end, case when not """
    + _ID("repo")
    + r""" then 'invalid_repo_id' end,
    case when not coalesce(regexp_full_match(repo_name, '[^\s\pZ/]+/[^\s\pZ/]+'), false) then 'invalid_repo_name' end, case when not timed then 'invalid_timestamp' end, case when public is distinct from 'true' then 'not_public' end,
    case when not payload then 'missing_payload' end], lambda x: x is not null) as validation_errors from k),
w as (select *, floor(event_us / 1000000)::bigint - epoch(started)::bigint as off, list_filter([case when event_type not in ("""
    + ", ".join(map(repr, EVENT_TYPES))
    + """) then 'unknown_event_type' end, case when floor(event_us / 1000000)::bigint - epoch(started)::bigint not between 0 and 3599 then 'outside_archive_hour' end,
    case when org is not null and coalesce(try_cast(org as bigint), 0) <= 0 then 'invalid_optional_org_id' end], lambda x: x is not null) as quality_warnings from e),
s as (select *, len(validation_errors) = 0 as good, row_number() over (partition by len(validation_errors) = 0, event_id order by started nulls last, source_filename, raw_record_sha256) as duplicate_rank from w)
"""
)


@MORE.add("silver_normalize", _SETTLED_LINES + "select event_id, event_type, actor::bigint as actor_id, actor_login, repo::bigint as repo_id, repo_name, event_us, payload_action, try_cast(org as bigint) as org_id, source_filename, off as archive_hour_offset_seconds, raw_record_sha256, array_to_string(quality_warnings, ',') as warnings from s where good and duplicate_rank = 1")
def silver_normalize(spark, folder):
    clean = silver.split(lines(spark, folder))[0]
    return clean.select("event_id", "event_type", "actor_id", "actor_login", "repo_id", "repo_name", F.unix_micros("event_time").alias("event_us"), "payload_action", "org_id", "source_filename", "archive_hour_offset_seconds", "raw_record_sha256", F.array_join("quality_warnings", ",").alias("warnings"))


_READABLE_SQL = "case when validation_errors[1] = 'invalid_json_or_field_type' then validation_errors[1:1] else validation_errors end"


def _readable():
    return F.when(F.get("validation_errors", F.lit(0)) == "invalid_json_or_field_type", F.slice("validation_errors", 1, 1)).otherwise(F.col("validation_errors"))


@MORE.add("silver_quarantine", _SETTLED_LINES + f"select raw_record_sha256, source_filename, array_to_string({_READABLE_SQL}, ',') as errors from s where not good")
def silver_quarantine(spark, folder):
    """What a line that is no record still shows of its fields depends on the parser, so only the first reason is compared."""
    return silver.split(lines(spark, folder))[1].select("raw_record_sha256", "source_filename", F.array_join(_readable(), ",").alias("errors"))


@MORE.add("silver_quarantine_reasons", _SETTLED_LINES + f"select label, count(*) as n from (select unnest({_READABLE_SQL}) as label from s) group by 1")
def silver_quarantine_reasons(spark, folder):
    return silver.label_counts(lines(spark, folder).withColumn("validation_errors", _readable()), "validation_errors")


@MORE.add("silver_warning_counts", _SETTLED_LINES + "select label, count(*) as n from (select unnest(quality_warnings) as label from s where good) group by 1")
def silver_warning_counts(spark, folder):
    return silver.label_counts(lines(spark, folder).where("disposition <> 'quarantined'"), "quality_warnings")


@MORE.add("silver_accounting", _SETTLED_LINES + "select count(*) as lines, count(*) filter (good and duplicate_rank = 1) as clean, count(*) filter (not good) as quarantined, count(*) filter (good and duplicate_rank > 1) as duplicates from s")
def silver_accounting(spark, folder):
    return silver.accounting(lines(spark, folder))


@MORE.add("silver_line_duplicates", _SETTLED_LINES + "select event_id, raw_record_sha256, source_filename, duplicate_rank from s where good and duplicate_rank > 1")
def silver_line_duplicates(spark, folder):
    return silver.split(lines(spark, folder))[2].select("event_id", "raw_record_sha256", "source_filename", "duplicate_rank")


@MORE.add("silver_publish", _SETTLED_LINES + """, d as (select cast(make_timestamp(event_us) as date) as day, repo::bigint as repo_id from s where good and duplicate_rank = 1)
select 'events' as dataset, (select count(*) from d) as rows union all select 'quarantine', (select count(*) from s where not good) union all select 'duplicates', (select count(*) from s where good and duplicate_rank > 1)
union all select 'repository_daily_stats', (select count(*) from (select distinct day, repo_id from d))""")  # fmt: skip
def silver_publish(spark, folder):
    """Raw lines to a published Silver snapshot; rows of its tables as its manifest has them."""
    place, _ = silver.publish(spark, table(spark, folder, "raw_lines"), scratch(spark, "silver"), {"lines": folder}, strict=True)
    return spark.createDataFrame(list(snapshots.verify(spark, place)["rows"].items()), "dataset string, rows long")


@MORE.add("silver_dedup", EV + "select event_id, source_filename, raw_record_sha256 from ev")
def silver_dedup(spark, folder):
    return events(spark, folder).select("event_id", "source_filename", "raw_record_sha256")


@MORE.add("silver_duplicates", "select event_id, raw_record_sha256, row_number() over (partition by event_id order by source_archive_start nulls last, source_filename, raw_record_sha256) as duplicate_rank from silver_events qualify duplicate_rank > 1")
def silver_duplicates(spark, folder):
    rows = table(spark, folder, "silver_events").select("event_id", "raw_record_sha256", "source_archive_start", "source_filename")
    order = [F.coalesce("source_archive_start", F.lit("9999-12-31").cast("timestamp")), F.coalesce("source_filename", F.lit("")), F.coalesce("raw_record_sha256", F.lit(""))]
    return rank_in_blocks(rows, ["event_id"], order, "duplicate_rank").where("duplicate_rank > 1").select("event_id", "raw_record_sha256", "duplicate_rank")


_DAILY = {**{k: MEASURES[k] for k in ("push_events", "star_events", "fork_events", "pull_request_events", "pull_requests_opened", "issues_opened")}, "watch_events": "event_type = 'WatchEvent'", "issue_events": "event_type = 'IssuesEvent'"}


@MORE.add("silver_daily_stats", EV + "select event_date, repo_id, arg_max(repo_name, (event_time, raw_record_sha256)) as repo_name, count(*) as total_events, count(distinct actor_id) as active_accounts, " + ", ".join(f"count(*) filter ({p}) as {n}" for n, p in _DAILY.items()) + " from ev group by 1, 2")
def silver_daily_stats(spark, folder):
    return silver.daily_stats(events(spark, folder))


@MORE.add("duplicate_variants", "select event_id, count(*) as copies, count(distinct raw_record_sha256) as variants from silver_events group by 1 having count(*) > 1 and count(distinct raw_record_sha256) > 1")
def duplicate_variants(spark, folder):
    return silver.duplicate_variants(table(spark, folder, "silver_events"))


@MORE.add("silver_summary", "select count(*) as rows, count(distinct event_id) as unique_event_ids, count(distinct repo_id) as unique_repositories, count(distinct actor_id) as unique_accounts, strftime(min(event_time) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as first_time, strftime(max(event_time) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_time from silver_events")
def silver_summary(spark, folder):
    return silver.summary(table(spark, folder, "silver_events"))


_CORPUS = P1_SQL + """, rows as (select v[1] as event_id, v[2]::bigint as repo_id, v[3] as repo_name, v[4]::bigint as actor_id, v[5] as event_type, nullif(v[6], '') as payload_action, v[8] as started, v[9] as source_filename, v[10]::bigint as source_row, v[11] as raw_record_sha256
  from f join g using (line_id) where reason is null)
"""


@MORE.add("corpus_project", _CORPUS + "select event_id, repo_id, repo_name, actor_id, event_type, payload_action, source_filename, source_row, raw_record_sha256 from rows")
def corpus_project(spark, folder):
    return raw_lines.load_lines(table(spark, folder, "raw_corpus_lines"), "csv")[0].select("event_id", "repo_id", "repo_name", "actor_id", "event_type", "payload_action", "source_filename", "source_row", "raw_record_sha256")


@MORE.add("corpus_dedup", _CORPUS + "select event_id, repo_id, source_filename, source_row from rows qualify row_number() over (partition by event_id order by started::timestamptz, source_filename, source_row, raw_record_sha256) = 1")
def corpus_dedup(spark, folder):
    return corpus.first_rows(raw_lines.load_lines(table(spark, folder, "raw_corpus_lines"), "csv")[0]).select("event_id", "repo_id", "source_filename", "source_row")


@MORE.add("corpus_write", P1_SQL + "select count(*) filter (reason is null) as events, count(*) filter (reason is not null) as quarantine from g")
def corpus_write(spark, folder):
    """The corpus as zstd Parquet with its quarantine; up to a tenth of these lines may be damaged."""
    n = corpus.write_corpus(spark, table(spark, folder, "raw_corpus_lines"), scratch(spark, "corpus"), most_rejected=0.1)
    return spark.createDataFrame([(n["events"], n["quarantine"])], "events long, quarantine long")


@MORE.add("collection_roll_up", "select count(*) as wanted, count(*) filter (n > 0) as completed, count(*) filter (not coalesce(n > 0, false)) as missing, coalesce(sum(b) filter (n > 0), 0)::bigint as compressed_bytes, coalesce(sum(n) filter (n > 0), 0)::bigint as validated_records from (select event_date, event_hour, sum(n_rows) as n, sum(n_bytes) as b from event_files group by 1, 2)")
def collection_roll_up(spark, folder):
    """Hours of the file listing as a collection: those with records are complete."""
    hours = table(spark, folder, "event_files").groupBy("event_date", "event_hour").agg(F.sum("n_rows").alias("records"), F.sum("n_bytes").alias("compressed_bytes"))
    some = hours.withColumns({"status": F.when(F.col("records") > 0, "complete").otherwise("missing"), **{f"reused_{x}": F.lit(False) for x in ("download", "validation", "publication")}})
    return corpus.roll_up(some).select("wanted", "completed", "missing", "compressed_bytes", "validated_records")


@MORE.add("snk_csv_round_trip", "select event_id, actor_login, payload_action from silver_events where event_type = 'IssuesEvent'")
def snk_csv_round_trip(spark, folder):
    place = scratch(spark, "csv")
    readers.write_csv(table(spark, folder, "silver_events").where("event_type = 'IssuesEvent'").select("event_id", "actor_login", "payload_action"), place)
    return readers.read_csv(spark, place, "event_id string, actor_login string, payload_action string")


# ---------------------------------------------------------------- exploration


@MORE.add("eda_summary", "select count(*) as records, count(*) filter (n > 1) as duplicate_event_ids, coalesce(sum(n) filter (n > 1), 0)::bigint as records_with_duplicated_ids, coalesce(sum(n - 1) filter (n > 1), 0)::bigint as duplicate_excess_records from (select event_id, count(*) as n from silver_events group by 1)".replace("count(*) as records", "sum(n)::bigint as records"))
def eda_summary(spark, folder):
    return ex.overview(table(spark, folder, "silver_events"))


@MORE.add("eda_duplicate_ids", "select event_id, count(*) as occurrences from silver_events group by 1 having count(*) > 1")
def eda_duplicate_ids(spark, folder):
    return ex.duplicate_ids(table(spark, folder, "silver_events"))


@MORE.add("eda_top_repositories", "select repo_id as id, count(*) as events, arg_max(repo_name, (event_time, raw_record_sha256)) as name from silver_events group by 1 order by 2 desc, 1 limit 20")
def eda_top_repositories(spark, folder):
    return ex.ranking(table(spark, folder, "silver_events"), "repo_id", "repo_name", F.struct("event_time", "raw_record_sha256"))


@MORE.add("eda_top_accounts", "select actor_id as id, count(*) as events, arg_max(actor_login, (event_time, raw_record_sha256)) as name from silver_events group by 1 order by 2 desc, 1 limit 20")
def eda_top_accounts(spark, folder):
    return ex.ranking(table(spark, folder, "silver_events"), "actor_id", "actor_login", F.struct("event_time", "raw_record_sha256"))


_FIELD_SQL = " union all ".join(
    f"select '{f}' as field, count(*) filter (t is null) as absent, count(*) filter (t = 'NULL') as null, count(*) filter (t not in ('NULL', 'OBJECT', 'ARRAY') and trim(x, ' ') = '') as blank from (select json_type(o, '$.{f}') as t, o->>'$.{f}' as x from j join c using (line_id) where record)" for f in ex.FIELDS
)


@MORE.add("eda_missing_fields", P1_SQL + _FIELD_SQL)
def eda_missing_fields(spark, folder):
    return ex.field_quality(readers.usable_lines(table(spark, folder, "raw_lines"))).select("field", "absent", "null", "blank")


@MORE.add("eda_type_counts", "select coalesce(event_type, '<missing>') as event_type, count(*) as events from silver_events group by 1")
def eda_type_counts(spark, folder):
    return ex.type_counts(table(spark, folder, "silver_events"))


@MORE.add("eda_unique_ids", P1_SQL + "select count(distinct id) as unique_events, count(distinct id) filter (public = 'true') as public_events, count(distinct repo) as unique_repositories, count(distinct repo) filter (public = 'true') as public_repositories, count(distinct actor) as unique_accounts, count(distinct actor) filter (public = 'true') as public_accounts from c where record")
def eda_unique_ids(spark, folder):
    parsed = raw_lines.parse_json_lines(table(spark, folder, "raw_lines"), "raw_json").where("_p.record = 'true'")
    rows = parsed.select("_p.event_id", "_p.repo_id", "_p.actor_id", (F.col("_p.public") == "true").alias("public"))
    return ex.unique_ids(rows, F.col("public"))


@MORE.add("eda_events_per_minute", "with c as (select date_trunc('minute', event_time) as m, count(*) as n from silver_events group by 1), g as (select unnest(generate_series(min(m), max(m), interval 1 minute)) as m from c) select strftime(m at time zone 'UTC', '%Y-%m-%d %H:%M') as utc_minute, coalesce(n, 0) as events from g left join c using (m)")
def eda_events_per_minute(spark, folder):
    return ex.events_per_minute(table(spark, folder, "silver_events"))


@MORE.add("eda_hour_of_day", "select event_hour, count(*) as events from silver_events group by 1")
def eda_hour_of_day(spark, folder):
    return table(spark, folder, "silver_events").groupBy("event_hour").agg(F.count("*").alias("events"))


@MORE.add("eda_account_bins", "select case when total_events <= 1 then '1' when total_events <= 5 then '2-5' when total_events <= 10 then '6-10' when total_events <= 50 then '11-50' else '51+' end as bin, count(*) as accounts from account_metrics where total_events > 0 group by 1")
def eda_account_bins(spark, folder):
    return ex.account_bins(table(spark, folder, "account_metrics"))


@MORE.add("eda_json_paths")
def eda_json_paths(spark, folder):
    return ex.json_paths(table(spark, folder, "raw_lines"))


@MORE.add("eda_read_stats", P1_SQL + "select count(*) as lines, count(*) filter (coalesce(trim(raw_json, ' ') = '', true)) as blank, count(*) filter (strlen(raw_json) > 8388608) as too_long, count(*) filter (trim(raw_json, ' ') <> '' and strlen(raw_json) <= 8388608 and not record) as invalid from j join c using (line_id)")
def eda_read_stats(spark, folder):
    return ex.read_stats(table(spark, folder, "raw_lines"))


@MORE.add("eda_sample")
def eda_sample(spark, folder):
    """A sampling operator: 100 rows, each as likely as any other."""
    return ex.uniform_sample(events(spark, folder), 100, "event_id").select("event_id", "event_type", "repo_id")


@MORE.add("delay_stats", "select avg(d)::double as mean_seconds, quantile_disc(d, 0.95)::double as p95_seconds, max(d)::double as max_seconds from (select epoch(received_at)::bigint - epoch(event_time)::bigint as d from (select date_trunc('second', received_at) as received_at, date_trunc('second', event_time) as event_time from stream_messages where disposition is distinct from 'invalid'))".replace("avg(d)::double", "round(avg(d), 6)::double"))
def delay_stats(spark, folder):
    return rounded(ex.delays(table(spark, folder, "stream_messages").where(~F.col("disposition").eqNullSafe(F.lit("invalid"))), "event_time", "received_at"), "mean_seconds")


@MORE.add("load_audit", EV + "select count(*) as rows, sum(repo_id)::double as repo_sum, sum(event_hour)::bigint as hour_sum from ev")
def load_audit(spark, folder):
    return events(spark, folder).agg(F.count("*").alias("rows"), F.sum(F.col("repo_id").cast("decimal(38,0)")).cast("double").alias("repo_sum"), F.sum("event_hour").alias("hour_sum"))


# ---------------------------------------------------------------- stream ledger

_LEDGER = """with spot as (select * from stream_messages qualify row_number() over (partition by stream_id, topic, partition_id, offset_id order by delivery_id) = 1),
checked as (select *, (event_id is null or not regexp_full_match(event_id, '[1-9][0-9]{0,29}') or repo_id is null or repo_id <= 0 or actor_id is null or actor_id <= 0 or coalesce(length(repo_name), 0) not between 1 and 512
  or coalesce(length(actor_login), 0) not between 1 and 256 or event_type is null or event_type not in (""" + ", ".join(map(repr, EVENT_TYPES)) + """) or event_time is null) as bad from spot),
content as (select *, (event_time, event_type, payload_action, repo_id, repo_name, actor_id, actor_login) as c from checked),
ranked as (select *, row_number() over w as rn, first_value(c) over w as c1 from content where not bad window w as (partition by stream_id, event_id order by topic, partition_id, offset_id)),
kept as (select * from ranked where rn = 1)
"""  # fmt: skip


def replayed(spark, folder) -> ledger.Ledger:
    """The message table replayed through Structured Streaming into a new ledger."""
    root = scratch(spark, "ledger")
    out = ledger.Ledger(spark, root, strict_offsets=False)
    source = table(spark, folder, "stream_messages").select(*[c.strip().split(" ")[0] for c in ledger.MESSAGE.split(",")])
    source.write.parquet(f"{root}/dropped")
    out.run(ledger.file_source(spark, f"{root}/dropped"), f"{root}/checkpoint")
    return out


@MORE.add("stream_minute_activity", _LEDGER + f"select stream_id, epoch_us(date_trunc('minute', event_time)) as minute_us, count(*) as total_events, count(*) filter ({MEASURES['star_events']}) as star_events, count(*) filter (event_type = 'ForkEvent') as fork_events, count(distinct actor_id) as active_accounts from kept group by 1, 2")
def stream_minute_activity(spark, folder):
    minutes = replayed(spark, folder).table("minutes")
    return minutes.select("stream_id", F.unix_micros("minute_utc").alias("minute_us"), "total_events", "star_events", "fork_events", "active_accounts")


@MORE.add("stream_repo_minutes", _LEDGER + f"select stream_id, epoch_us(date_trunc('minute', event_time)) as minute_us, repo_id, count(*) as total_events, count(*) filter ({MEASURES['star_events']}) as star_events, count(*) filter (event_type = 'ForkEvent') as fork_events from kept group by 1, 2, 3")
def stream_repo_minutes(spark, folder):
    return replayed(spark, folder).table("repo_minutes").select("stream_id", F.unix_micros("minute_utc").alias("minute_us"), "repo_id", "total_events", "star_events", "fork_events")


@MORE.add("stream_dispositions", _LEDGER + "select delivery_id, 'invalid' as disposition from content where bad union all select delivery_id, case when rn = 1 then 'accepted' when c is distinct from c1 then 'conflict' else 'duplicate' end from ranked")
def stream_dispositions(spark, folder):
    return replayed(spark, folder).table("messages").select("delivery_id", "disposition")


@MORE.add("stream_batch_counters", _LEDGER + "select (select count(*) from content) as new_messages, (select count(*) from kept) as accepted, (select count(*) from ranked where rn > 1 and c is not distinct from c1) as duplicate, (select count(*) from ranked where rn > 1 and c is distinct from c1) as conflict, (select count(*) from content where bad) as invalid")
def stream_batch_counters(spark, folder):
    out = replayed(spark, folder).receipts
    names = ("new_messages", "accepted", "duplicate", "conflict", "invalid")
    return spark.createDataFrame([tuple(sum(r[n] for r in out) for n in names)], ", ".join(f"{n} long" for n in names))


@MORE.add("stream_first_message", _LEDGER + "select stream_id, event_id, delivery_id from kept")
def stream_first_message(spark, folder):
    return replayed(spark, folder).table("events").select("stream_id", "event_id", "delivery_id")


_COMMITS = (
    _LEDGER.replace("order by delivery_id", "order by batch_id, delivery_id").replace("order by topic,", "order by batch_id, topic,")
    .replace("or event_time is null) as bad from spot)", "or event_time is null or event_time < start_utc or event_time >= end_utc) as bad from spot left join (select stream_id, start_utc, end_utc from stream_runs) using (stream_id))")
    + """, seen as (select stream_id, batch_id, max(max(event_time)) over (partition by stream_id order by batch_id rows between unbounded preceding and 1 preceding) as seen from kept group by 1, 2),
runs as (select stream_id, max(late_after_seconds) as late_after, max(cutoff_seconds) as cutoff from stream_runs group by 1),
judged as (select k.*, coalesce(k.event_time < s.seen - to_seconds(r.late_after), false) as late, coalesce(k.event_time < s.seen, false) as out_of_order, coalesce(k.event_time < s.seen - to_seconds(r.cutoff), false) as dropped
  from kept k left join seen s using (stream_id, batch_id) left join runs r using (stream_id))
"""
)


def replayed_commits(spark, folder, batches: int = 4) -> ledger.Ledger:
    """The message table replayed in commit order: one micro-batch per range of batch_id, under each run's limits."""
    root = scratch(spark, "ledger")
    runs = table(spark, folder, "stream_runs")
    out = ledger.Ledger(spark, root, limits=runs, by_commit=True, require_contract=True)
    out.register_all(runs)
    source = table(spark, folder, "stream_messages").select(*ledger.columns(ledger.COMMITTED))
    bounds = sorted(set(source.approxQuantile("batch_id", [i / batches for i in range(1, batches)], 0.001)))
    place = sum((F.coalesce(F.col("batch_id") > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    source.withColumn("_range", place).write.partitionBy("_range").parquet(f"{root}/dropped")
    for i in range(len(bounds) + 1):
        if storage.exists(spark, f"{root}/dropped/_range={i}"):
            out.run(ledger.file_source(spark, f"{root}/dropped/_range={i}", schema=ledger.COMMITTED), f"{root}/checkpoint-{i}")
    return out


@MORE.add("stream_commit_minutes", _COMMITS + f"select stream_id, epoch_us(date_trunc('minute', event_time)) as minute_us, count(*) as total_events, count(*) filter ({MEASURES['star_events']}) as star_events, count(*) filter (event_type = 'ForkEvent') as fork_events, count(distinct actor_id) as active_accounts, count(*) filter (late) as late_events from judged where not dropped group by 1, 2")
def stream_commit_minutes(spark, folder):
    minutes = replayed_commits(spark, folder).table("minutes")
    return minutes.select("stream_id", F.unix_micros("minute_utc").alias("minute_us"), "total_events", "star_events", "fork_events", "active_accounts", "late_events")


@MORE.add("stream_commit_dispositions", _COMMITS + "select delivery_id, 'invalid' as disposition from content where bad union all select delivery_id, case when c is distinct from c1 then 'conflict' else 'duplicate' end from ranked where rn > 1 union all select delivery_id, case when dropped then 'dropped' else 'accepted' end from judged")
def stream_commit_dispositions(spark, folder):
    return replayed_commits(spark, folder).table("messages").select("delivery_id", "disposition")


@MORE.add("stream_commit_counters", _COMMITS + "select (select count(*) from content) as new_messages, (select count(*) from judged where not dropped) as accepted, (select count(*) from ranked where rn > 1 and c is not distinct from c1) as duplicate, (select count(*) from ranked where rn > 1 and c is distinct from c1) as conflict, (select count(*) from content where bad) as invalid, (select count(*) from judged where dropped) as dropped, (select count(*) from judged where late) as late, (select count(*) from judged where out_of_order) as out_of_order")
def stream_commit_counters(spark, folder):
    out = replayed_commits(spark, folder).receipts
    names = ("new_messages", "accepted", "duplicate", "conflict", "invalid", "dropped", "late", "out_of_order")
    return spark.createDataFrame([tuple(sum(r[n] for r in out) for n in names)], ", ".join(f"{n} long" for n in names))


@MORE.add("stream_commit_parity", "select 0 as minutes_off, 0 as repo_minutes_off")
def stream_commit_parity(spark, folder):
    """Minutes of a replay in several batches against those recomputed from all its events: none differs."""
    return replayed_commits(spark, folder).parity()


@MORE.add("stream_recent_spikes", _LEDGER + f""", t as (select *, epoch_us(max(event_time) over ()) - epoch_us(event_time) as age from kept),
w as (select repo_id, count(*) filter (age < 600000000) as recent_events, count(*) filter (age < 600000000 and {MEASURES['star_events']}) as recent_stars, count(*) filter (age < 600000000 and event_type = 'ForkEvent') as recent_forks, count(*) filter (age >= 600000000) as previous_events, arg_max(repo_name, (event_time, event_id)) as repo_name from t where age < 1200000000 group by 1)
select *, recent_events >= 10 and (recent_events + 1.0) / (previous_events + 1.0) >= 2 as activity_spike, round((recent_events + 1.0)::double / (previous_events + 1.0), 2)::double as activity_ratio from w order by recent_events desc, repo_id limit 20""")  # fmt: skip
def stream_recent_spikes(spark, folder):
    """The last ten minutes of the ledger against the ten before."""
    return sv.recent_repositories(replayed(spark, folder).table("events"))


@MORE.add("sql_with_parameters", EV + "select event_type, count(*) as n from ev where event_hour between 3 and 5 and contains(lower(repo_name), 'or') group by 1")
def sql_with_parameters(spark, folder):
    """Parameterized SQL over a table: values are bound, never pasted into the text."""
    return spark.sql("select event_type, count(*) as n from {ev} where event_hour between :first and :last and contains(lower(repo_name), :part) group by 1", args={"first": 3, "last": 5, "part": "or"}, ev=events(spark, folder))


@MORE.add("stream_offset_ranges", "select topic, partition_id, min(offset_id) as first_offset, max(offset_id) + 1 as end_offset, count(*) as rows from stream_messages group by 1, 2")
def stream_offset_ranges(spark, folder):
    return ledger.offset_ranges(table(spark, folder, "stream_messages"))


@MORE.add("stream_offset_conflict", "select topic, partition_id, offset_id from stream_messages group by 1, 2, 3 having count(distinct value_sha256) > 1")
def stream_offset_conflict(spark, folder):
    spot = ["topic", "partition_id", "offset_id"]
    return table(spark, folder, "stream_messages").where("value_sha256 is not null").groupBy(*spot, "value_sha256").agg(F.lit(1)).groupBy(*spot).agg(F.count("*").alias("n")).where("n > 1").drop("n")


@MORE.add("replay_order", EV + "select event_id, row_number() over (order by event_time, event_id) as place from ev where event_hour = 12 and event_date = date '2026-01-08'")
def replay_order(spark, folder):
    return readers.replay_hour(events(spark, folder), date(2026, 1, 8), 12).select("event_id", "place")


# ---------------------------------------------------------------- models: seven periods of two days, all 14 days of the data

HORIZON = le.Horizon(datetime(2026, 1, 5), days=2, first_days=1, min_events=5, min_future=2, splits=(("train", 0, 3), ("validation", 4, 4), ("test", 5, 5), ("forecast", 6, 6)))
_P = "floor((epoch(date_trunc('second', source_archive_start))::bigint - 1767571200) / 172800)::int"
_FEATURES = EV + f""", framed as (select *, {_P} as period from ev),
inside as (select *, floor((epoch(source_archive_start)::bigint - (1767571200 + period * 172800)) / 86400) as d from framed where epoch_us(event_time) >= (1767571200 + period * 172800) * 1000000::bigint and epoch_us(event_time) < (1767571200 + (period + 1) * 172800) * 1000000::bigint),
features as (select period, repo_id, count(*) as total_events, {', '.join(f'count(*) filter ({MEASURES[m]}) as {m}' for m in ('star_events', 'fork_events', 'push_events', 'pull_requests_opened', 'issues_opened'))},
  count(*) filter ({MEASURES['star_events']} and d < 1) as stars_first, count(*) filter ({MEASURES['star_events']} and d >= 1) as stars_last, count(distinct actor_id) as active_accounts,
  count(distinct actor_id) filter (event_type = 'PushEvent' or event_type = 'PullRequestEvent' and payload_action = 'opened') as code_accounts, count(distinct event_date) as active_days, 1767571200 + (period + 1) * 172800 as as_of_seconds from inside group by 1, 2),
ex as (select f.*, case when f.period <= 3 then 'train' when f.period = 4 then 'validation' when f.period = 5 then 'test' else 'forecast' end as split,
  case when f.period < 6 then coalesce(n.star_events, 0) end as future_stars, case when f.period < 6 then coalesce(n.star_events, 0) end - f.star_events as star_delta
  from features f left join features n on n.repo_id = f.repo_id and n.period = f.period + 1 where f.total_events >= 5 and f.period between 0 and 6),
th as (select case when count(*) > 0 then greatest(1, quantile_disc(star_delta, 0.9)) end as t from ex where split = 'train' and star_delta > 0),
lab as (select ex.*, case when split <> 'forecast' then (future_stars >= 2 and star_delta >= t)::int::double end as label from ex, th),
sc as (select *, star_events / (star_events + 1.0) as score from lab where split = 'validation')
"""  # fmt: skip
_COLUMNS = ["period", "repo_id", "total_events", "star_events", "fork_events", "push_events", "pull_requests_opened", "issues_opened", "stars_first", "stars_last", "active_accounts", "code_accounts", "active_days"]


@MORE.add("weekly_features", _FEATURES + f"select {', '.join(_COLUMNS)}, round((stars_last / 1 + 1) / (stars_first / 1 + 1), 6) as star_growth_rate, {', '.join(f'round(ln(1 + {c}), 6) as log_{c}' for c in le.COUNTS)} from features")
def weekly_features(spark, folder):
    made = ["star_growth_rate", *[f"log_{c}" for c in le.COUNTS]]
    return rounded(le.period_features(events(spark, folder), HORIZON).select(*_COLUMNS, *made), *made)


def labelled(spark, folder):
    ex_ = materialize(le.examples(le.period_features(events(spark, folder), HORIZON), HORIZON), "examples")
    return le.labelled(ex_, le.growth_threshold(ex_).first()["threshold"], HORIZON)


@MORE.add("weekly_labels", _FEATURES + "select period, repo_id, split, future_stars, star_delta, label from lab")
def weekly_labels(spark, folder):
    return labelled(spark, folder).select("period", "repo_id", "split", "future_stars", "star_delta", "label")


@MORE.add("growth_threshold", _FEATURES + "select t::bigint as threshold from th")
def growth_threshold(spark, folder):
    return le.growth_threshold(le.examples(le.period_features(events(spark, folder), HORIZON), HORIZON))


@MORE.add("split_audit", _FEATURES + "select split, count(*) as rows, sum(label)::bigint as positives, min(as_of_seconds)::bigint as first_as_of, max(as_of_seconds)::bigint as last_as_of, max(as_of_seconds)::bigint + 172800 as last_label_end from lab group by 1")
def split_audit(spark, folder):
    return le.split_audit(labelled(spark, folder), HORIZON)


def _scored(spark, folder):
    return le.baseline_score(labelled(spark, folder).where("split = 'validation'"))


@MORE.add("predicted_flags", _FEATURES + "select repo_id, label, score >= 0.7 as predicted from sc")
def predicted_flags(spark, folder):
    return le.predicted(_scored(spark, folder), 0.7).select("repo_id", "label", "predicted")


@MORE.add("confusion_curve", _FEATURES + ", g as (select unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7])::double as t), c as (select g.t as decision_threshold, count(*) filter (score >= g.t and label = 1) as tp, count(*) filter (score >= g.t and label = 0) as fp, count(*) filter (score < g.t and label = 1) as fn, count(*) filter (score < g.t and label = 0) as tn from sc, g group by 1), p as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall from c) select decision_threshold, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) as f1 from p")
def confusion_curve(spark, folder):
    return rounded(le.confusion_curve(_scored(spark, folder)), "precision", "recall", "f1")


@MORE.add("ranking_metrics", _FEATURES + "select count(*) as rows, sum(label)::bigint as positives, round(avg(label), 6) as prevalence, round(avg(pow(score - label, 2)), 6) as brier_score, round((select avg(label) from (select label from sc order by score desc, repo_id limit 10)), 6) as precision_at_10, round((select avg(label) from (select label from sc order by score desc, repo_id limit 100)), 6) as precision_at_100 from sc")
def ranking_metrics(spark, folder):
    return rounded(le.ranking_metrics(_scored(spark, folder)), "prevalence", "brier_score", "precision_at_10", "precision_at_100")


@MORE.add("reliability_bins", _FEATURES + "select least(floor(score * 10), 9)::int as bin, count(*) as rows, round(avg(score), 6) as mean_score, round(avg(label), 6) as observed_positive_fraction from sc group by 1")
def reliability_bins(spark, folder):
    return rounded(le.reliability_bins(_scored(spark, folder)), "mean_score", "observed_positive_fraction")


def _baseline(spark, folder):
    rows = labelled(spark, folder)
    return rows, le.baseline_score(rows)


@MORE.add("baseline_forecasts", _FEATURES.replace("count(*) as total_events, ", "arg_max(repo_name, (event_time, source_archive_start, raw_record_sha256)) as repo_name, count(*) as total_events, ", 1) + "select repo_id, repo_name, as_of_seconds::bigint as as_of_seconds, 2 as horizon_days, round(star_events / (star_events + 1.0), 6) as predicted_probability, star_events as recent_stars, fork_events as recent_forks, push_events as recent_pushes, total_events as recent_events, active_accounts from lab where split = 'forecast' and contains(lower(repo_name), 'or') order by star_events / (star_events + 1.0) desc, repo_id limit 20")
def baseline_forecasts(spark, folder):
    """Forecasts of the baseline joined with their context, searched by name."""
    rows, scored = _baseline(spark, folder)
    out = le.serve_forecasts(le.predictions(scored, "baseline", HORIZON), le.forecast_context(rows, "baseline"), "baseline", "OR")
    return rounded(out.withColumn("as_of_seconds", F.unix_seconds("as_of_utc")).drop("as_of_utc"), "predicted_probability")


@MORE.add("baseline_heldout", _FEATURES.replace("count(*) as total_events, ", "arg_max(repo_name, (event_time, source_archive_start, raw_record_sha256)) as repo_name, count(*) as total_events, ", 1) + "select repo_id, repo_name, as_of_seconds::bigint as as_of_seconds, star_events as past_stars, future_stars, label = 1 as actual_label, round(star_events / (star_events + 1.0), 6) as predicted_probability from lab where split = 'test' order by star_events / (star_events + 1.0) desc, repo_id limit 100")
def baseline_heldout(spark, folder):
    out = le.serve_heldout(le.heldout(_baseline(spark, folder)[1], "baseline"), "baseline")
    return rounded(out.withColumn("as_of_seconds", F.unix_seconds("as_of_utc")).drop("as_of_utc"), "predicted_probability")


def _fitted(spark, folder):
    rows = labelled(spark, folder)
    le.check_splits(rows, HORIZON, ("train", "validation"))  # the test split of small tables may have no positive
    name, model, metrics = le.fit_and_choose(rows)
    return rows, name, metrics, materialize(le.with_score(model, rows.where("split in ('test', 'forecast')")), "scores")


@MORE.add("model_forecasts")
def model_forecasts(spark, folder):
    """Forecasts of the model chosen among all three, published with their context, most likely first."""
    rows, name, metrics, scored = _fitted(spark, folder)
    recipe = {"data": folder, "start": HORIZON.start.isoformat(), "days": HORIZON.days}
    place, _ = le.publish_model(spark, scratch(spark, "models"), recipe, name, metrics, rows, scored, HORIZON)
    model_id = snapshots.verify(spark, place)["facts"]["model_id"]
    return le.serve_forecasts(*(spark.read.parquet(f"{place}/{t}") for t in ("predictions", "forecast_context")), model_id, limit=50)


@MORE.add("heldout_top")
def heldout_top(spark, folder):
    """Held-out scores of the chosen model with what came true, most likely first."""
    return le.serve_heldout(le.heldout(_fitted(spark, folder)[3], "chosen"), "chosen", 50)
