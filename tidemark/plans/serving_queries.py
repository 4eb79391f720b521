"""Language, metadata and serving queries with their SQL.

The data has no repository metadata, so a small deterministic table is made for the 40 repositories with most events;
the SQL makes the same one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import activity as ac
from tidemark.operators import gold
from tidemark.operators import language as la
from tidemark.operators import serving as sv
from tidemark.plans.activity_queries import BUNDLE, END, EV, LATEST, MEASURES, REPOS, WINDOW, events, repos, rounded
from tidemark.plans.registry import Registry
from tidemark.session import materialize, scratch
from tidemark.sources import readers, snapshots

SERVING = Registry()


def metadata(ev):
    top = ev.groupBy("repo_id").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "repo_id").limit(40)
    r = F.row_number().over(W.orderBy(F.desc("_n"), "repo_id"))  # 40 rows
    m = top.withColumn("r", r)
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("r") % len(xs)).cast("int") + 1)
    primary = F.when(F.col("r") % 8 != 5, pick("Python", "Rust", "Go"))
    rows = m.select(
        "repo_id",
        F.when(F.col("r") % 10 == 7, "not_found").when(F.col("r") == 20, "identity_mismatch").otherwise("ok").alias("status"),
        primary.alias("primary_language"),
        F.when(F.col("r") % 8 == 5, F.create_map().cast("map<string,bigint>")).when(F.col("r") % 9 == 4, F.create_map(F.lit("C"), F.lit(0).cast("long"))).otherwise(F.create_map(primary, F.col("r").cast("long") * 1000, F.lit("Shell"), F.lit(100).cast("long"))).alias("language_bytes"),
        F.when(F.col("r") % 4 == 0, F.array(F.lit("Machine-Learning"))).when(F.col("r") % 4 == 1, F.array(F.lit("kubernetes"), F.lit("x"))).when(F.col("r") % 4 == 2, F.array(F.lit("android"))).alias("topics"),
        F.when(F.col("r") % 5 == 0, "A Data Pipeline for all").when(F.col("r") % 5 == 1, "Mobile app").when(F.col("r") % 5 == 2, "biosphere").alias("description"),
        F.timestamp_seconds(F.lit(1_768_780_800) - (F.col("r") - 3) * 43_200).alias("created_at"),
    )
    return materialize(rows, "metadata")


META = """, top40 as (select repo_id, row_number() over (order by count(*) desc, repo_id) as r from ev group by repo_id qualify r <= 40),
meta as (select repo_id, r, case when r % 10 = 7 then 'not_found' when r = 20 then 'identity_mismatch' else 'ok' end as status, case when r % 8 <> 5 then ['Python', 'Rust', 'Go'][r % 3 + 1] end as primary_language from top40),
labels as (select repo_id, case when status <> 'ok' then 'Metadata unavailable' else coalesce(primary_language, 'No primary language reported') end as primary_language, status as enrichment_status from meta),
shares as (select repo_id, 'Metadata unavailable' as language, 0 as language_bytes, 1.0::double as byte_share from meta where status <> 'ok'
  union all select repo_id, 'No language reported', 0, 1.0 from meta where status = 'ok' and (r % 8 = 5 or r % 9 = 4)
  union all select repo_id, primary_language, r * 1000, (r * 1000) / (r * 1000 + 100) from meta where status = 'ok' and r % 8 <> 5 and r % 9 <> 4
  union all select repo_id, 'Shell', 100, 100 / (r * 1000 + 100) from meta where status = 'ok' and r % 8 <> 5 and r % 9 <> 4),
cats as (select repo_id, case when status <> 'ok' then ['Metadata unavailable'] when len(c) = 0 then ['Unclassified'] else c end as c from (
  select repo_id, status, list_filter([case when r % 4 = 0 then 'AI' end, case when r % 4 = 1 then 'Cloud' end, case when r % 5 = 0 then 'Data engineering' end, case when r % 4 = 2 or r % 5 = 1 then 'Mobile' end], lambda x: x is not null) as c from meta)),
days as (select event_date, repo_id, count(*) as total_events, """ + ", ".join(f"count(*) filter ({MEASURES[m]}) as {m}" for m in la.WEIGHTED[1:]) + " from ev group by 1, 2)\n"  # fmt: skip


@SERVING.add("language_primary_daily", EV + META + f"select event_date, coalesce(l.primary_language, 'Not enriched') as primary_language, coalesce(l.enrichment_status, 'not_selected') as enrichment_status, count(distinct repo_id) as active_repositories, {BUNDLE} from ev left join labels l using (repo_id) group by 1, 2, 3")
def language_primary_daily(spark, folder):
    ev = events(spark, folder)
    return la.primary_daily(ev, metadata(ev))


@SERVING.add("language_shares", EV + META + "select repo_id, language, language_bytes::bigint as language_bytes, round(byte_share, 6) as byte_share from shares")
def language_shares(spark, folder):
    return rounded(la.language_shares(metadata(events(spark, folder))), "byte_share")


@SERVING.add("language_weighted_daily", EV + META + "select event_date, coalesce(language, 'Not enriched') as language, count(*) as associated_repositories, " + ", ".join(f"round(sum({m} * coalesce(byte_share, 1.0)), 6) as attributed_{m}" for m in la.WEIGHTED) + " from days left join shares using (repo_id) group by 1, 2")
def language_weighted_daily(spark, folder):
    ev = events(spark, folder)
    return rounded(la.weighted_daily(ev, metadata(ev)), *[f"attributed_{m}" for m in la.WEIGHTED])


@SERVING.add("technology_daily", EV + META + "select event_date, technology_category, count(*) as active_repositories, sum(total_events)::bigint as total_events, sum(star_events)::bigint as star_events, sum(fork_events)::bigint as fork_events, sum(push_events)::bigint as push_events from (select d.*, unnest(coalesce(c, ['Not enriched'])) as technology_category from days d left join cats using (repo_id)) group by 1, 2")
def technology_daily(spark, folder):
    ev = events(spark, folder)
    return la.technology_daily(ev, metadata(ev))


_META_AFTER_REPOS = REPOS.rstrip() + META


@SERVING.add("language_growth", _META_AFTER_REPOS + """select coalesce(l.primary_language, 'Not enriched') as primary_language, coalesce(l.enrichment_status, 'not_selected') as enrichment_status,
  sum(previous_attention)::bigint as previous_attention, sum(current_attention)::bigint as current_attention, sum(previous_events)::bigint as previous_events, sum(current_events)::bigint as current_events,
  (sum(current_attention) - sum(previous_attention))::bigint as attention_delta, round((sum(current_attention) + 1.0) / (sum(previous_attention) + 1.0), 6) as attention_growth_ratio, sum(previous_attention) = 0 as zero_attention_baseline
  from repos left join labels l using (repo_id) group by 1, 2""")  # fmt: skip
def language_growth(spark, folder):
    return rounded(la.language_growth(repos(spark, folder), metadata(events(spark, folder))), "attention_growth_ratio")


@SERVING.add("metadata_coverage", EV + META + f"select count(*) as total_events, count(*) filter (status = 'ok') as covered_events, count(*) filter (status = 'ok' and {MEASURES['star_events']}) as covered_stars, count(*) filter (status = 'ok' and event_type = 'ForkEvent') as covered_forks, round(count(*) filter (status = 'ok') / count(*), 6) as covered_share from ev left join meta using (repo_id)")
def metadata_coverage(spark, folder):
    ev = events(spark, folder)
    return rounded(la.coverage(ev, metadata(ev)), "covered_share")


@SERVING.add("metadata_age", EV + META + "select repo_id, case when (r - 3) >= 0 then round((r - 3) * 43200 / 86400.0, 6)::double end as repository_age_days from meta")
def metadata_age(spark, folder):
    return rounded(la.metadata_age(metadata(events(spark, folder)), 1_768_780_800_000_000), "repository_age_days")


@SERVING.add("language_options", EV + META + "select distinct primary_language as value from labels union select 'Not enriched' union select 'All'")
def language_options(spark, folder):
    labels = metadata(events(spark, folder)).select(la.primary_label().alias("primary_language"))
    return sv.options(labels, "primary_language", [sv.ALL, la.NOT_ENRICHED])


@SERVING.add("language_top", EV + META + "select primary_language, count(*) as total_events, round(count(*) / (select count(*) from ev), 6) as share from ev join labels using (repo_id) group by 1 order by total_events desc, primary_language limit 20")
def language_top(spark, folder):
    ev = events(spark, folder)
    labels = F.broadcast(metadata(ev).select("repo_id", la.primary_label().alias("primary_language")))  # 40 rows
    sums = ev.join(labels, "repo_id", "left").groupBy("primary_language").agg(F.count("*").alias("total_events"))
    total = sums.agg(F.sum("total_events").alias("_t")).withColumn("_one", F.lit(1))
    shared = sums.where("primary_language is not null").withColumn("_one", F.lit(1)).join(total, "_one")
    return shared.select("primary_language", "total_events", F.round(F.col("total_events") / F.col("_t"), 6).alias("share")).orderBy(F.desc("total_events"), "primary_language").limit(20)


@SERVING.add("named_language_coverage", EV + META + "select count(*) as total_events, count(*) filter (primary_language not in ('Metadata unavailable', 'No primary language reported')) as named_events from ev left join labels using (repo_id)")
def named_language_coverage(spark, folder):
    ev = events(spark, folder)
    labels = F.broadcast(metadata(ev).select("repo_id", la.primary_label().alias("primary_language")))  # 40 rows
    named = F.col("primary_language").isNotNull() & ~F.col("primary_language").isin(la.UNAVAILABLE, la.NO_PRIMARY)
    return ev.join(labels, "repo_id", "left").agg(F.count("*").alias("total_events"), F.count_if(named).alias("named_events"))


@SERVING.add("language_daily_range", EV + META + "select event_date, primary_language, count(*) as total_events from ev join labels using (repo_id) where event_date between date '2026-01-08' and date '2026-01-10' group by 1, 2")
def language_daily_range(spark, folder):
    ev = events(spark, folder)
    labels = F.broadcast(metadata(ev).select("repo_id", la.primary_label().alias("primary_language")))  # 40 rows
    return ev.where(F.col("event_date").between(date(2026, 1, 8), date(2026, 1, 10))).join(labels, "repo_id").groupBy("event_date", "primary_language").agg(F.count("*").alias("total_events"))


@SERVING.add("repositories_view", _META_AFTER_REPOS + "select repo_id, repo_name, total_events, coalesce(l.primary_language, 'Not enriched') as primary_language, coalesce(l.enrichment_status, 'not_selected') as enrichment_status from repos left join labels l using (repo_id)")
def repositories_view(spark, folder):
    return sv.with_labels(repos(spark, folder), metadata(events(spark, folder))).select("repo_id", "repo_name", "total_events", "primary_language", "enrichment_status")


_RANGE = "exists (select 1 from ev e where e.repo_id = repos.repo_id and e.event_date between date '2026-01-06' and date '2026-01-08')"


@SERVING.add("repo_rankings_filtered", REPOS + f"select repo_id, repo_name, total_events, active_accounts from repos where lower(repo_name) like '%or%' and total_events >= 20 and {_RANGE} order by active_accounts desc, repo_id limit 25")
def repo_rankings_filtered(spark, folder):
    out = sv.rankings(repos(spark, folder), "active_accounts", 25, search="OR", minimum=20, daily=events(spark, folder), first=date(2026, 1, 6), last=date(2026, 1, 8))
    return out.select("repo_id", "repo_name", "total_events", "active_accounts")


@SERVING.add("repo_rankings_language", _META_AFTER_REPOS + "select repo_id, round(round(trend_score, 9), 6) as trend_score, primary_language, enrichment_status from repos join labels using (repo_id) where primary_language = 'Rust' and growth_eligible order by round(trend_score, 9) desc, repo_id limit 10")
def repo_rankings_language(spark, folder):
    rows = repos(spark, folder).withColumn("trend_score", F.round("trend_score", 9))
    out = sv.rankings(rows, "trend_score", 10, language="Rust", metadata=metadata(events(spark, folder)))
    return rounded(out.select("repo_id", "trend_score", "primary_language", "enrichment_status"), "trend_score")


@SERVING.add("repo_rankings_growth", REPOS + "select repo_id, round(round(attention_growth_ratio, 9), 6) as attention_growth_ratio, attention_delta from repos where growth_eligible and attention_delta > 0 order by round(attention_growth_ratio, 9) desc, repo_id limit 20")
def repo_rankings_growth(spark, folder):
    rows = repos(spark, folder).withColumn("attention_growth_ratio", F.round("attention_growth_ratio", 9))
    return rounded(sv.rankings(rows, "attention_growth_ratio").select("repo_id", "attention_growth_ratio", "attention_delta"), "attention_growth_ratio")


@SERVING.add("repo_rankings_not_enriched", _META_AFTER_REPOS + "select repo_id, star_events, enrichment_status from (select r.*, coalesce(l.primary_language, 'Not enriched') as primary_language, coalesce(l.enrichment_status, 'not_selected') as enrichment_status from repos r left join labels l using (repo_id)) where primary_language = 'Not enriched' order by star_events desc, repo_id limit 20")
def repo_rankings_not_enriched(spark, folder):
    out = sv.rankings(repos(spark, folder), "star_events", language=la.NOT_ENRICHED, metadata=metadata(events(spark, folder)))
    return out.select("repo_id", "star_events", "enrichment_status")


@SERVING.add("search_literal", EV + "select distinct repo_id, repo_name from ev where contains(lower(repo_name), '_1')")
def search_literal(spark, folder):
    return events(spark, folder).where(sv.contains_literal("repo_name", "_1")).select("repo_id", "repo_name").distinct()


@SERVING.add("repos_observed_between", REPOS + f"select repo_id, total_events from repos where {_RANGE}")
def repos_observed_between(spark, folder):
    ev = events(spark, folder)
    return sv.observed_between(repos(spark, folder), ev, date(2026, 1, 6), date(2026, 1, 8)).select("repo_id", "total_events")


_TOP2 = "(select repo_id from ev group by 1 order by count(*) desc, repo_id limit 2)"


def _top_ids(ev, n):
    return [r["repo_id"] for r in ev.groupBy("repo_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo_id").limit(n).collect()]


@SERVING.add("repo_compare", REPOS + f"select repo_id, repo_name, total_events, star_events, current_attention from repos where repo_id in {_TOP2}")
def repo_compare(spark, folder):
    return sv.compare(repos(spark, folder), _top_ids(events(spark, folder), 2)).select("repo_id", "repo_name", "total_events", "star_events", "current_attention")


@SERVING.add("repo_history", EV + f"select event_date, event_hour, {BUNDLE} from ev where repo_id = (select repo_id from ev group by 1 order by count(*) desc, repo_id limit 1) group by 1, 2")
def repo_history(spark, folder):
    from tidemark.functions.measures import bundle

    ev = events(spark, folder)
    return sv.history(bundle(ev, ["event_date", "event_hour", "repo_id"]), "repo_id", _top_ids(ev, 1)[0]).drop("repo_id")


@SERVING.add("account_history", EV + f"select event_date, event_hour, count(*) as total_events, count(distinct repo_id) as active_repositories, count(*) filter ({MEASURES['push_events']}) as push_events, count(*) filter ({MEASURES['pull_requests_opened']}) as pull_requests_opened from ev where actor_id = (select actor_id from ev group by 1 order by count(*) desc, actor_id limit 1) group by 1, 2")
def account_history(spark, folder):
    ev = events(spark, folder)
    top = ev.groupBy("actor_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor_id").first()["actor_id"]
    return sv.history(ac.accounts(ev, ("actor_id", "event_date", "event_hour")), "actor_id", top).select("event_date", "event_hour", "total_events", "active_repositories", "push_events", "pull_requests_opened")


@SERVING.add("account_search", EV + "select actor_id, arg_max(actor_login, (event_time, raw_record_sha256)) as actor_login, count(*) as total_events from ev group by 1 having contains(lower(actor_login), 'zel') order by total_events desc, actor_id limit 30")
def account_search(spark, folder):
    return sv.search_accounts(ac.accounts(events(spark, folder)), "ZEL", 30).select("actor_id", "actor_login", "total_events")


@SERVING.add("edges_labelled", EV + f", e as (select repo_id, actor_id, count(*) as participation_events from ev group by 1, 2 order by 3 desc, 1, 2 limit 100), r as (select repo_id, {LATEST} from ev group by 1), a as (select actor_id, arg_max(actor_login, (event_time, raw_record_sha256)) as actor_login from ev group by 1) select repo_id, actor_id, participation_events, repo_name, actor_login from e join r using (repo_id) join a using (actor_id)")
def edges_labelled(spark, folder):
    from tidemark.functions.measures import latest

    ev = events(spark, folder)
    edges = ev.groupBy("repo_id", "actor_id").agg(F.count("*").alias("participation_events"))
    return sv.labelled_edges(edges, ev.groupBy("repo_id").agg(latest("repo_name").alias("repo_name")), ev.groupBy("actor_id").agg(latest("actor_login").alias("actor_login")))


@SERVING.add("date_bounds", EV + "select min(event_date) as first_date, max(event_date) as last_date from ev")
def date_bounds(spark, folder):
    return events(spark, folder).agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@SERVING.add("hour_labels", "select distinct event_date, event_hour, strftime(event_date + to_hours(event_hour), '%Y-%m-%d %H:00') as label from silver_events")
def hour_labels(spark, folder):
    from tidemark.sources.tables import table

    hours = table(spark, folder, "silver_events").select("event_date", "event_hour").distinct()
    return hours.withColumn("label", F.concat(F.date_format("event_date", "yyyy-MM-dd"), F.lit(" "), F.lpad(F.col("event_hour").cast("string"), 2, "0"), F.lit(":00")))


_RECENT = EV + ", t as (select *, epoch_us(max(event_time) over ()) - epoch_us(event_time) as age from ev)"


@SERVING.add("recent_repo_spikes", _RECENT + f""", w as (select repo_id, count(*) filter (age < 3600000000) as recent_events, count(*) filter (age < 3600000000 and {MEASURES['star_events']}) as recent_stars,
  count(*) filter (age < 3600000000 and event_type = 'ForkEvent') as recent_forks, count(*) filter (age >= 3600000000) as previous_events, arg_max(repo_name, (event_time, event_id)) as repo_name from t where age < 7200000000 group by 1)
select *, recent_events >= 10 and (recent_events + 1.0) / (previous_events + 1.0) >= 2 as activity_spike, round((recent_events + 1.0)::double / (previous_events + 1.0), 2)::double as activity_ratio from w order by recent_events desc, repo_id limit 20""")  # fmt: skip
def recent_repo_spikes(spark, folder):
    return sv.recent_repositories(events(spark, folder), minutes=60)


@SERVING.add("recent_accounts", _RECENT + "select actor_id, count(*) as recent_events, epoch_us(max(event_time)) as last_us, arg_max(actor_login, (event_time, event_id)) as actor_login from t where age < 3600000000 group by 1 order by 2 desc, 1 limit 20")
def recent_accounts(spark, folder):
    return sv.recent_accounts(events(spark, folder), minutes=60)


# ---------------------------------------------------------------- the Gold snapshot

_GOLD = {
    "repository_metrics": ("select repo_id from ev group by 1", True),
    "repository_daily": ("select event_date, repo_id from ev group by 1, 2", True),
    "repository_hourly": ("select event_date, event_hour, repo_id from ev group by 1, 2, 3", True),
    "account_metrics": ("select actor_id from ev group by 1", True),
    "account_daily": ("select actor_id, event_date from ev group by 1, 2", True),
    "account_hourly": ("select actor_id, event_date, event_hour from ev group by 1, 2, 3", True),
    "activity_calendar": ("select event_date from ev group by 1", True),
    "hourly_activity": ("select i from range(336) t(i)", False),
    "participation_edges_sample": ("select * from (select repo_id, actor_id, row_number() over (partition by repo_id order by count(*) desc, actor_id) as k from ev where repo_id in (select repo_id from ev group by 1 order by count(*) filter (" + MEASURES["star_events"] + ") desc, repo_id limit 20) group by 1, 2) where k <= 50", False),
    "repository_metadata": ("select repo_id from meta", False),
    "repository_language_shares": ("select * from shares", False),
    "language_primary_daily": ("select distinct event_date, coalesce(l.primary_language, ''), coalesce(l.enrichment_status, '') from ev left join labels l using (repo_id)", True),
    "language_weighted_daily": ("select distinct event_date, coalesce(language, '') from days left join shares using (repo_id)", False),
    "technology_daily": ("select distinct event_date, unnest(coalesce(c, [''])) from days left join cats using (repo_id)", False),
    "language_intraday_growth": ("select distinct coalesce(l.primary_language, ''), coalesce(l.enrichment_status, '') from ev left join labels l using (repo_id)", False),
}


@SERVING.add("gold_publish", EV + META + " union all ".join(f"select '{t}' as dataset, (select count(*) from ({q})) as rows, {'(select count(*) from ev)' if c else 'null'} as conserved_events" for t, (q, c) in _GOLD.items()))
def gold_publish(spark, folder):
    """All Gold tables published together; their rows, and the events of those that conserve them, from the manifest."""
    ev = events(spark, folder)
    place, _ = gold.publish(spark, ev, WINDOW, metadata(ev), scratch(spark, "gold"), {"silver": folder})
    m = snapshots.verify(spark, place)
    rows = [(t, n, m["facts"]["events"] if t in gold.CONSERVING else None) for t, n in m["rows"].items()]
    return spark.createDataFrame(rows, "dataset string, rows long, conserved_events long")


# ---------------------------------------------------------------- lists in the order a reader wants them


@SERVING.add("calendar_ordered", EV + "select event_date, row_number() over (order by event_date) as place, count(*) as total_events from ev group by 1")
def calendar_ordered(spark, folder):
    """The calendar in order of its dates; the place of each is part of the result."""
    return sv.placed(ac.calendar(events(spark, folder)), ["event_date"]).select("event_date", "place", "total_events")


@SERVING.add("language_growth_ordered", _META_AFTER_REPOS + "select primary_language, enrichment_status, current_attention, row_number() over (order by current_attention desc, primary_language, enrichment_status) as place from (select coalesce(l.primary_language, 'Not enriched') as primary_language, coalesce(l.enrichment_status, 'not_selected') as enrichment_status, sum(current_attention)::bigint as current_attention from repos left join labels l using (repo_id) group by 1, 2)")
def language_growth_ordered(spark, folder):
    """Languages by current attention, greatest first."""
    rows = la.language_growth(repos(spark, folder), metadata(events(spark, folder)))
    return sv.placed(rows, [F.desc("current_attention"), "primary_language", "enrichment_status"]).select("primary_language", "enrichment_status", "current_attention", "place")


@SERVING.add("stream_runs_latest", "select stream_id, status, place from (select *, row_number() over (order by case when status = 'complete' then 0 else 1 end, start_utc desc, stream_id) as place from stream_runs) where place <= 25")
def stream_runs_latest(spark, folder):
    """The latest runs, complete ones first."""
    from tidemark.sources.tables import table

    return sv.latest_runs(table(spark, folder, "stream_runs"), "start_utc", "stream_id", status_order=("complete",)).select("stream_id", "status", "place")


@SERVING.add("stream_batches_latest", "select stream_id, batch_id, messages, place from (select stream_id, batch_id, count(*) as messages, row_number() over (order by batch_id desc, stream_id) as place from stream_messages group by 1, 2) where place <= 25")
def stream_batches_latest(spark, folder):
    """The latest batches with their messages."""
    from tidemark.sources.tables import table

    batches = table(spark, folder, "stream_messages").groupBy("stream_id", "batch_id").agg(F.count("*").alias("messages"))
    return sv.latest_runs(batches, "batch_id", "stream_id").select("stream_id", "batch_id", "messages", "place")


@SERVING.add("src_cached_metadata", EV + META + "select repo_id, status, primary_language from meta")
def src_cached_metadata(spark, folder):
    """Metadata written as a cache of answers, with an older answer for each, and read back."""
    place, rows = scratch(spark, "cache"), metadata(events(spark, folder))
    new = rows.withColumn("fetched_at", F.lit("2026-01-20").cast("timestamp"))
    old = rows.withColumns({"status": F.lit("not_found"), "fetched_at": F.lit("2026-01-02").cast("timestamp")})
    new.unionByName(old).write.json(place)
    return readers.cached_metadata(spark, place).select("repo_id", "status", "primary_language")
