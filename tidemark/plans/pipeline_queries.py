"""Queries of the data-pipeline operators (p1, p2, p4 to p7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.model import ACTIONS, EVENT_TYPES
from tidemark.operators import deliveries, late_events, raw_lines, small_files
from tidemark.operators import feature_table as ft
from tidemark.operators import heavy_results as hr
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

PIPELINE = Registry()

# ---------------------------------------------------------------- p1: raw lines


_ID = lambda c: f"coalesce(regexp_full_match({c}, '[0-9]+') and try_cast(ltrim({c}, '0') as bigint) > 0, false)"
_INSTANT = lambda c: f"coalesce(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') and try_strptime(left({c}, 19), '%Y-%m-%dT%H:%M:%S') is not null and left({c}, 4) <> '0000', false)"
_MATCH = lambda c, pattern: f"coalesce(regexp_full_match({c}, '{pattern}'), false)"
_REPO, _TYPE, _EVENT = r"[^\s\pZ/]+/[^\s\pZ/]+", "[A-Z][A-Za-z0-9]*Event", "[1-9][0-9]*"
_FIELD = '("([^"]|"")*"|[^",]*)'
P1_SQL = (
    """with j as (select line_id, raw_json, case when json_valid(raw_json) and not regexp_matches(raw_json, ',\\s*[}\\]]|[:,\\[]\\s*-?(?i:nan|inf|infinity)\\s*[,}\\]]') then case when json_type(raw_json) = 'OBJECT' then raw_json::json end end as o from raw_lines),
c as (select line_id, o is not null and """
    + " and ".join(f"coalesce(json_type(o, '$.{x}'), 'NULL') in ('OBJECT', 'NULL')" for x in ("actor", "repo", "payload", "org"))
    + """ and coalesce(json_type(o, '$.public'), 'NULL') in ('BOOLEAN', 'NULL') as record, o->>'$.id' as id, o->>'$.type' as type, o->>'$.actor.id' as actor, o->>'$.actor.login' as login,
  o->>'$.repo.id' as repo, o->>'$.repo.name' as name, o->>'$.created_at' as t, o->>'$.public' as public, coalesce(json_type(o, '$.payload'), 'NULL') <> 'NULL' as payload from j),
r as (select line_id, case when not record then 'invalid_json_or_field_type' when not """
    + f"{_MATCH('id', _EVENT)} then 'invalid_event_id' when not {_MATCH('type', _TYPE)} then 'invalid_event_type' when not {_ID('actor')} then 'invalid_actor_id' "
    + r"when not coalesce(regexp_matches(login, '[^\s\pZ]'), false) then 'missing_actor_login' "
    + f"when not {_ID('repo')} then 'invalid_repo_id' when not {_MATCH('name', _REPO)} then 'invalid_repo_name' when not {_INSTANT('t')} then 'invalid_timestamp' when public is distinct from 'true' then 'not_public' when not payload then 'missing_payload' end as reason from c),\n"
    + f"""q as (select line_id, raw_csv, coalesce(regexp_full_match(raw_csv, '(?s){_FIELD}(,{_FIELD})*'), false) as sound from raw_corpus_lines),
f as (select line_id, sound, case when sound then list_transform(regexp_extract_all(',' || raw_csv, '(?s),("([^"]|"")*"|[^",]*)', 1), lambda x: case when left(x, 1) = '"' then replace(x[2:-2], '""', '"') else x end) end as v from q),
g as (select line_id, case when not sound then 'broken_quoting' when len(v) <> 11 then 'wrong_column_count' when not ({_MATCH('v[1]', _EVENT)} and {_ID('v[2]')} and {_MATCH('v[3]', _REPO)} and {_ID('v[4]')} and {_MATCH('v[5]', _TYPE)}
  and {_INSTANT('v[7]')} and {_INSTANT('v[8]')} and {_MATCH('v[10]', '[0-9]+')} and {_MATCH('v[11]', '[0-9a-f]{64}')}) then 'invalid_value' end as reason from f)
"""
)


@PIPELINE.add("p1_found", P1_SQL + "select line_id, reason from r where reason is not null union all select line_id, reason from g where reason is not null")
def p1_found(spark, folder):
    return raw_lines.first_reasons(table(spark, folder, "raw_lines"), "json").unionByName(raw_lines.first_reasons(table(spark, folder, "raw_corpus_lines"), "csv"))


@PIPELINE.add("p1_events", P1_SQL + "select c.line_id, c.id as event_id, c.type as event_type, c.actor::bigint as actor_id, c.repo::bigint as repo_id, c.name as repo_name, c.login as actor_login from c join r using (line_id) where r.reason is null")
def p1_events(spark, folder):
    good = raw_lines.load_lines(table(spark, folder, "raw_lines"), "json")[0]
    return good.select("line_id", "event_id", "event_type", "actor_id", "repo_id", "repo_name", "actor_login")


@PIPELINE.add("p1_corpus_rows", P1_SQL + "select f.line_id, v[1] as event_id, v[2]::bigint as repo_id, v[3] as repo_name, v[4]::bigint as actor_id, v[5] as event_type, nullif(v[6], '') as payload_action, v[9] as source_filename, v[10]::bigint as source_row, v[11] as raw_record_sha256 from f join g using (line_id) where reason is null")
def p1_corpus_rows(spark, folder):
    return raw_lines.load_lines(table(spark, folder, "raw_corpus_lines"), "csv")[0].drop("event_time", "source_archive_start", "source_uri")


@PIPELINE.add("p1_corrupt", P1_SQL + "select line_id, raw_json as _corrupt_record, source_uri, reason from r join raw_lines using (line_id) where reason is not null union all select line_id, raw_csv, source_uri, reason from g join raw_corpus_lines using (line_id) where reason is not null")
def p1_corrupt(spark, folder):
    bad = [raw_lines.load_lines(table(spark, folder, t), kind)[1] for t, kind in (("raw_lines", "json"), ("raw_corpus_lines", "csv"))]
    return bad[0].unionByName(bad[1]).drop("errors")


# ---------------------------------------------------------------- p2 and p7: the message stream

_SETTLED = """
with valid as (select * from stream_messages where disposition is distinct from 'invalid'),
ranked as (
  select *, row_number() over w as rn,
    first_value((event_time, event_type, payload_action, repo_id, repo_name, actor_id, actor_login)) over w as first_content
  from valid
  window w as (partition by stream_id, event_id order by batch_id, partition_id, offset_id, delivery_id)),
kept as (select * from ranked where rn = 1),
seen as (
  select stream_id, batch_id, max(max(event_time)) over (partition by stream_id order by batch_id rows between unbounded preceding and 1 preceding) as seen
  from kept group by stream_id, batch_id),
judged as (
  select k.*, case when k.event_time < s.seen - to_seconds(r.cutoff_seconds) then 'dropped'
                   when k.event_time < s.seen - to_seconds(r.late_after_seconds) then 'late' else 'on_time' end as outcome
  from kept k left join seen s using (stream_id, batch_id) left join stream_runs r using (stream_id))
"""


@PIPELINE.add("p2_found", _SETTLED + "select delivery_id, outcome from judged where outcome <> 'on_time'")
def p2_found(spark, folder):
    return late_events.late_messages(table(spark, folder, "stream_messages"), table(spark, folder, "stream_runs"))


@PIPELINE.add("p2_is_late", _SETTLED + "select delivery_id, outcome <> 'on_time' as is_late from judged")
def p2_is_late(spark, folder):
    return late_events.lateness(table(spark, folder, "stream_messages"), table(spark, folder, "stream_runs"))


@PIPELINE.add(
    "p2_minute_activity",
    _SETTLED
    + """, fresh as (
  select stream_id, date_trunc('minute', event_time) as minute_utc, count(*) as total_events,
    count(*) filter (event_type = 'WatchEvent' and payload_action = 'started') as star_events,
    count(*) filter (event_type = 'ForkEvent') as fork_events, count(distinct actor_id) as active_accounts,
    count(*) filter (outcome = 'late') as late_corrections
  from judged where outcome <> 'dropped' group by 1, 2),
touched as (select distinct stream_id, date_trunc('minute', event_time) as minute_utc from judged),
stale as (
  select stream_id, minute_utc, max((total_events, star_events, fork_events, active_accounts, late_corrections)) as c
  from minute_activity m where not exists (select 1 from touched t where t.stream_id = m.stream_id and t.minute_utc = m.minute_utc) group by 1, 2)
select stream_id, epoch_us(minute_utc) as minute_us, total_events, star_events, fork_events, active_accounts, late_corrections from fresh
union all select stream_id, epoch_us(minute_utc), c[1], c[2], c[3], c[4], c[5] from stale""",
)
def p2_minute_activity(spark, folder):
    fixed = late_events.repaired_minutes(table(spark, folder, "stream_messages"), table(spark, folder, "stream_runs"), table(spark, folder, "minute_activity"))
    return fixed.selectExpr("stream_id", "unix_micros(minute_utc) as minute_us", "total_events", "star_events", "fork_events", "active_accounts", "late_corrections")


@PIPELINE.add(
    "p7_found",
    _SETTLED
    + """select delivery_id, case when first_content is not distinct from (event_time, event_type, payload_action, repo_id, repo_name, actor_id, actor_login)
    then 'duplicate' else 'conflict' end as disposition from ranked where rn > 1""",
)
def p7_found(spark, folder):
    return deliveries.settle_deliveries(table(spark, folder, "stream_messages")).where("disposition <> 'kept'").select("delivery_id", "disposition")


@PIPELINE.add("p7_kept", _SETTLED + "select stream_id, event_id, delivery_id from kept")
def p7_kept(spark, folder):
    return deliveries.settle_deliveries(table(spark, folder, "stream_messages")).where("disposition = 'kept'").select("stream_id", "event_id", "delivery_id")


# ---------------------------------------------------------------- p4: features per entity

_ONCE = "with once as (select distinct event_id, repo_id, actor_id, event_type, payload_action, event_time from silver_events)"


@PIPELINE.add(
    "p4_found",
    _ONCE
    + """, truth as (
  select f.repo_id, f.as_of_utc, count(*) filter (event_type = 'WatchEvent' and payload_action = 'started') as stars,
    count(*) filter (event_type = 'PushEvent') as pushes, count(distinct actor_id) as accounts
  from (select distinct repo_id, as_of_utc from forecast_context) f join once o
    on o.repo_id = f.repo_id and o.event_time >= f.as_of_utc - interval 7 day and o.event_time < f.as_of_utc group by 1, 2)
select f.repo_id, strftime(f.as_of_utc at time zone 'UTC', '%Y-%m-%d') as as_of_day from forecast_context f left join truth t using (repo_id, as_of_utc)
where (f.recent_stars, f.recent_pushes, f.active_accounts) is distinct from (coalesce(t.stars, 0), coalesce(t.pushes, 0), coalesce(t.accounts, 0))""",
)
def p4_found(spark, folder):
    stale = ft.stale_features(table(spark, folder, "silver_events"), table(spark, folder, "forecast_context"))
    return stale.select("repo_id", F.date_format("as_of_utc", "yyyy-MM-dd").alias("as_of_day"))


def _p4_columns(alias: str) -> str:
    columns = ["count(*) as total_events", "count(distinct actor_id) as active_accounts", f"{alias} - max(epoch(event_time))::bigint as recency_any"]
    for t in EVENT_TYPES:
        mine, name = f"event_type = '{t}'", ft.snake(t)
        columns += [f"count(*) filter ({mine}) as n_{name}", f"{alias} - max(epoch(event_time)::bigint) filter ({mine}) as recency_{name}"]
        columns += [f"count(*) filter ({mine} and payload_action = '{a}') as n_{name}_{a}" for a in ACTIONS]
    columns += [f"count(*) filter (event_type not in ({', '.join(map(repr, EVENT_TYPES))})) as n_other", *[f"count(*) filter (payload_action = '{a}') as n_action_{a}" for a in ACTIONS]]
    return ", ".join(columns)


@PIPELINE.add(
    "p4_features",
    _ONCE.replace("event_time from", "date_trunc('second', event_time) as event_time from")
    + f", points as (select distinct as_of_utc from forecast_context) select repo_id, strftime(as_of_utc at time zone 'UTC', '%Y-%m-%d') as as_of_day, {_p4_columns('any_value(epoch(as_of_utc)::bigint)')} "
    + "from once join points on event_time >= as_of_utc - interval 7 day and event_time < as_of_utc group by repo_id, as_of_utc",
)
def p4_features(spark, folder):
    wide = ft.entity_features(table(spark, folder, "silver_events"), table(spark, folder, "forecast_context"))
    return wide.withColumn("as_of_day", F.date_format("as_of_utc", "yyyy-MM-dd")).drop("as_of_utc")


# ---------------------------------------------------------------- p6: few keys with most rows

_ONCE_ALL = "with once as (select distinct event_id, event_type, payload_action, repo_id, actor_id, event_time, event_date from silver_events)"


@PIPELINE.add(
    "p6_found",
    """
select 'repo_id' as key_field, repo_id as key_value from silver_events where repo_id is not null group by repo_id
having count(*) >= 0.02 * (select count(*) from silver_events)
union all
select 'actor_id', actor_id from silver_events where actor_id is not null group by actor_id having count(*) >= 0.02 * (select count(*) from silver_events)""",
)
def p6_found(spark, folder):
    return hr.dominant_keys(table(spark, folder, "silver_events"), ["repo_id", "actor_id"], 0.02)


@PIPELINE.add(
    "p6_repository_metrics",
    _ONCE_ALL
    + """ select repo_id, count(*) as total_events, count(distinct actor_id) as active_accounts, count(*) filter (event_type = 'PushEvent') as push_events,
  count(*) filter (event_type = 'WatchEvent' and payload_action = 'started') as star_events, count(*) filter (event_type = 'ForkEvent') as fork_events,
  count(*) filter (event_type = 'PullRequestEvent' and payload_action = 'opened') as pull_requests_opened,
  epoch_us(min(event_time)) as first_event_us, epoch_us(max(event_time)) as last_event_us from once group by repo_id""",
)
def p6_repository_metrics(spark, folder):
    out = hr.repository_results(table(spark, folder, "silver_events"))
    return out.withColumns({"first_event_us": F.unix_micros("first_event_time"), "last_event_us": F.unix_micros("last_event_time")}).drop("first_event_time", "last_event_time")


@PIPELINE.add(
    "p6_account_metrics",
    _ONCE_ALL
    + """ select actor_id, count(*) as total_events, count(distinct repo_id) as active_repositories, count(distinct event_date) as active_days,
  count(*) filter (event_type = 'PushEvent') as push_events, count(*) filter (event_type = 'PullRequestEvent' and payload_action = 'opened') as pull_requests_opened,
  count(*) filter (dayofweek(event_date) in (0, 6)) as weekend_events from once group by actor_id""",
)
def p6_account_metrics(spark, folder):
    return hr.account_results(table(spark, folder, "silver_events"))


@PIPELINE.add(
    "p6_stored_bytes",
    "select repo_id, count(*) as joined_rows, sum(n_bytes)::bigint as joined_bytes from silver_events join event_files using (file_id) group by repo_id",
)
def p6_stored_bytes(spark, folder):
    return hr.stored_bytes_by_repository(table(spark, folder, "silver_events"), table(spark, folder, "event_files"))


# ---------------------------------------------------------------- p5: small files


def _compacted(spark, folder):
    events = table(spark, folder, "silver_events")
    place, report = small_files.compact_rows(events, table(spark, folder, "event_files"))
    return events, place, report


@PIPELINE.add("p5_compaction")
def p5_compaction(spark, folder):
    """Rows, files before and after and the largest file per date and hour; fails if a row was lost, changed or added."""
    return _compacted(spark, folder)[2]


@PIPELINE.add(
    "p5_rows",
    """select event_id, event_type, actor_id, actor_login, repo_id, repo_name, epoch_us(event_time) as event_us, event_date, event_hour, payload_action, org_id, source_filename,
  epoch_us(source_archive_start) as archive_us, raw_record_sha256, case when quality_warnings is null then 'null' else array_to_string(quality_warnings, ',') end as warnings, file_id from silver_events""",
)
def p5_rows(spark, folder):
    """The compacted table read back: exactly the rows of silver_events."""
    events, place, _ = _compacted(spark, folder)
    back = small_files.read_compacted(spark, place, events)
    warnings = F.when(F.col("quality_warnings").isNull(), "null").otherwise(F.array_join("quality_warnings", ","))
    return back.withColumns({"event_us": F.unix_micros("event_time"), "archive_us": F.unix_micros("source_archive_start"), "warnings": warnings}).drop("event_time", "source_archive_start", "quality_warnings")


@PIPELINE.add("p5_hours", "select event_date, event_hour, count(*) as rows, (select count(distinct file_id) from event_files f where f.event_date = e.event_date and f.event_hour = e.event_hour) as files_before from silver_events e group by 1, 2")
def p5_hours(spark, folder):
    """Rows and listed files per date and hour, from the report of the compaction."""
    return _compacted(spark, folder)[2].selectExpr("event_date", "event_hour", "rows", "coalesce(files_before, 0) as files_before")
