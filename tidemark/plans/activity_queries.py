"""Queries on clean activity events, with their SQL.  Doubles are rounded to 6 digits on both sides."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.measures import bundle, predicates
from tidemark.operators import activity as ac
from tidemark.plans.registry import Registry
from tidemark.session import scratch
from tidemark.sources import storage
from tidemark.sources.tables import table

ACTIVITY = Registry()
WINDOW = ac.Window(datetime(2026, 1, 5), 336)
SPLIT, END = "timestamptz '2026-01-12 00:00:00+00'", "timestamptz '2026-01-19 00:00:00+00'"
START = "timestamptz '2026-01-05 00:00:00+00'"

EV = """with ev as (select * from (select *, row_number() over (partition by event_id order by source_archive_start nulls last, source_filename, raw_record_sha256) as rn
  from silver_events) where rn = 1)
"""
MEASURES = {
    "push_events": "event_type = 'PushEvent'",
    "star_events": "event_type = 'WatchEvent' and payload_action = 'started'",
    "fork_events": "event_type = 'ForkEvent'",
    "pull_request_events": "event_type = 'PullRequestEvent'",
    "pull_requests_opened": "event_type = 'PullRequestEvent' and payload_action = 'opened'",
    "issues_opened": "event_type = 'IssuesEvent' and payload_action = 'opened'",
    "issue_comment_events": "event_type = 'IssueCommentEvent'",
    "review_events": "event_type in ('PullRequestReviewEvent', 'PullRequestReviewCommentEvent')",
}
CODE = "(event_type = 'PushEvent' or event_type = 'PullRequestEvent' and payload_action = 'opened' or event_type = 'PullRequestReviewEvent')"
BUNDLE = "count(*) as total_events, count(distinct actor_id) as active_accounts, count(distinct actor_id) filter (" + CODE + ") as code_participating_accounts, " + ", ".join(f"count(*) filter ({p}) as {n}" for n, p in MEASURES.items())
LATEST = "arg_max(repo_name, (event_time, raw_record_sha256)) as repo_name"


GOLD_COLUMNS = ("event_id", "event_type", "actor_id", "actor_login", "repo_id", "repo_name", "event_time", "event_date", "event_hour", "payload_action", "source_archive_start", "source_filename", "raw_record_sha256")
_published: dict[tuple[str, str], tuple[str, StructType]] = {}


def events(spark, folder):
    """The clean events, published once a session: Gold reads them and no result moves all events by event_id again.

    Not bucketed: a bucket would hold all rows of a hot repository or account.
    """
    at = (spark.sparkContext.applicationId, folder)
    if at not in _published or not storage.exists(spark, _published[at][0]):
        place = scratch(spark, "clean-events")
        once = ac.clean(table(spark, folder, "silver_events").select(*GOLD_COLUMNS))
        once.write.parquet(place)
        _published[at] = place, once.schema
    place, schema = _published[at]
    return spark.read.schema(schema).parquet(place)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def repos(spark, folder):
    return ac.repositories(events(spark, folder), WINDOW)


def _half(h: str) -> str:
    t = {"previous": f"event_time >= {START} and event_time < {SPLIT}", "current": f"event_time >= {SPLIT} and event_time < {END}"}[h]
    m = {"events": "true", "stars": MEASURES["star_events"], "forks": MEASURES["fork_events"], "prs_opened": MEASURES["pull_requests_opened"]}
    return ", ".join(f"count(*) filter ({t} and {p}) as {h}_{n}" for n, p in m.items()) + f", count(distinct actor_id) filter ({t}) as {h}_active_accounts"


REPOS = (
    EV
    + f""", base as (select repo_id, {LATEST}, {BUNDLE}, {_half('previous')}, {_half('current')}, min(event_time) as first_event_time, max(event_time) as last_event_time from ev group by repo_id),
att as (select *, previous_stars + previous_forks as previous_attention, current_stars + current_forks as current_attention from base),
grown as (select *, current_attention - previous_attention as attention_delta, (current_attention + 1.0) / (previous_attention + 1.0) as attention_growth_ratio,
  (current_stars + 1.0) / (previous_stars + 1.0) as star_growth_ratio,
  case when previous_attention > 0 then 100.0 * (current_attention - previous_attention) / previous_attention end as attention_change_percent,
  previous_attention = 0 as zero_attention_baseline, current_attention >= 5 and current_active_accounts >= 2 as growth_eligible,
  current_attention >= 5 and current_active_accounts >= 2 and previous_attention <= 2 as emerging_attention_candidate, active_accounts / total_events as participation_ratio from att),
mx as (select max(current_stars) as ms, max(current_forks) as mf, max(current_active_accounts) as ma, max(current_prs_opened) as mp from grown),
scored as (select g.*, 0.4 * case when ms > 0 then ln(1 + current_stars) / ln(1 + ms) else 0 end + 0.3 * case when mf > 0 then ln(1 + current_forks) / ln(1 + mf) else 0 end
  + 0.2 * case when ma > 0 then ln(1 + current_active_accounts) / ln(1 + ma) else 0 end + 0.1 * case when mp > 0 then ln(1 + current_prs_opened) / ln(1 + mp) else 0 end as activity_score from grown g, mx),
repos as (select *, 0.7 * activity_score + 0.3 * ln(least(greatest(attention_growth_ratio, 1.0), 10.0)) / ln(10) as trend_score from scored)
"""
)

# ---------------------------------------------------------------- measures and groupings


@ACTIVITY.add("bench_repo_counts", EV + f"select repo_id, count(*) as total_events, count(*) filter ({MEASURES['star_events']}) as star_events, count(*) filter ({MEASURES['fork_events']}) as fork_events, count(distinct actor_id) as active_accounts from ev group by repo_id")
def bench_repo_counts(spark, folder):
    p = predicates()
    by_actor = events(spark, folder).groupBy("repo_id", "actor_id").agg(F.count("*").alias("n"), F.count_if(p["star_events"]).alias("s"), F.count_if(p["fork_events"]).alias("f"))
    return by_actor.groupBy("repo_id").agg(F.sum("n").alias("total_events"), F.sum("s").alias("star_events"), F.sum("f").alias("fork_events"), F.count("actor_id").alias("active_accounts")).orderBy(F.desc("total_events"), "repo_id")


@ACTIVITY.add("bench_hour_filter", "select event_type, count(*) as n from silver_events where event_hour = 12 group by event_type")
def bench_hour_filter(spark, folder):
    return table(spark, folder, "silver_events").where("event_hour = 12").groupBy("event_type").agg(F.count("*").alias("n"))


@ACTIVITY.add("event_type_counts", EV + "select event_type, count(*) as n from ev group by 1")
def event_type_counts(spark, folder):
    return events(spark, folder).groupBy("event_type").agg(F.count("*").alias("n"))


@ACTIVITY.add("activity_bundle", EV + f"select {BUNDLE} from ev")
def activity_bundle(spark, folder):
    return bundle(events(spark, folder).withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


@ACTIVITY.add("repository_metrics", EV + f"select repo_id, {LATEST}, {BUNDLE}, epoch_us(min(event_time)) as first_us, epoch_us(max(event_time)) as last_us from ev group by repo_id")
def repository_metrics(spark, folder):
    out = bundle(events(spark, folder), ["repo_id"], "repo_name", [F.min("event_time").alias("first_event_time"), F.max("event_time").alias("last_event_time")])
    return out.withColumns({"first_us": F.unix_micros("first_event_time"), "last_us": F.unix_micros("last_event_time")}).drop("first_event_time", "last_event_time")


@ACTIVITY.add("repository_daily", EV + f"select event_date, repo_id, {LATEST}, {BUNDLE} from ev group by 1, 2")
def repository_daily(spark, folder):
    return bundle(events(spark, folder), ["event_date", "repo_id"], "repo_name")


@ACTIVITY.add("repository_hourly", EV + f"select event_date, event_hour, repo_id, {BUNDLE} from ev group by 1, 2, 3")
def repository_hourly(spark, folder):
    return bundle(events(spark, folder), ["event_date", "event_hour", "repo_id"])


def _accounts_sql(keys: str) -> str:
    counted = ", ".join(f"count(*) filter ({p}) as {n}" for n, p in MEASURES.items() if n not in ("star_events", "fork_events", "pull_request_events"))
    return EV + f"select {keys}, arg_max(actor_login, (event_time, raw_record_sha256)) as actor_login, count(*) as total_events, count(distinct repo_id) as active_repositories, count(distinct event_date) as active_days, {counted}, count(*) filter (dayofweek(event_date) in (0, 6)) as weekend_events from ev group by {keys}"


@ACTIVITY.add("account_metrics", _accounts_sql("actor_id"))
def account_metrics(spark, folder):
    return ac.accounts(events(spark, folder))


@ACTIVITY.add("account_daily", _accounts_sql("actor_id, event_date"))
def account_daily(spark, folder):
    return ac.accounts(events(spark, folder), ("actor_id", "event_date"))


@ACTIVITY.add("account_hourly", _accounts_sql("actor_id, event_date, event_hour"))
def account_hourly(spark, folder):
    return ac.accounts(events(spark, folder), ("actor_id", "event_date", "event_hour"))


@ACTIVITY.add("activity_calendar", EV + "select event_date, count(*) as total_events, count(distinct actor_id) as active_accounts, count(distinct repo_id) as active_repositories, dayname(event_date) as weekday_utc, dayofweek(event_date) in (0, 6) as is_weekend_utc, date_trunc('week', event_date)::date as week_start_utc from ev group by event_date")
def activity_calendar(spark, folder):
    return ac.calendar(events(spark, folder))


@ACTIVITY.add(
    "hourly_activity_dense",
    EV + """, grid as (select (timestamp '2026-01-05' + to_hours(i))::date as event_date, hour(timestamp '2026-01-05' + to_hours(i))::int as event_hour from range(336) t(i)),
  o as (select event_date, event_hour, count(*) as n, count(distinct actor_id) as a, count(distinct repo_id) as r from ev group by 1, 2)
select event_date, event_hour, coalesce(n, 0) as total_events, coalesce(a, 0) as active_accounts, coalesce(r, 0) as active_repositories from grid left join o using (event_date, event_hour)""",
)
def hourly_activity_dense(spark, folder):
    return ac.hourly_dense(events(spark, folder), WINDOW)


# ---------------------------------------------------------------- windows, growth, scores, rankings


@ACTIVITY.add("window_events", EV + f"select event_id from ev where event_time >= {SPLIT} and event_time < {END}")
def window_events(spark, folder):
    return events(spark, folder).where(WINDOW.inside("current")).select("event_id")


_WINDOW_COLUMNS = ["repo_id", *[f"{h}_{n}" for h in ("previous", "current") for n in ("events", "stars", "forks", "prs_opened", "active_accounts")]]


@ACTIVITY.add("repository_windows", REPOS + f"select {', '.join(_WINDOW_COLUMNS)} from repos")
def repository_windows(spark, folder):
    return repos(spark, folder).select(*_WINDOW_COLUMNS)


@ACTIVITY.add(
    "repository_growth",
    REPOS + """select repo_id, previous_attention, current_attention, attention_delta, round(attention_growth_ratio, 6) as attention_growth_ratio, round(star_growth_ratio, 6) as star_growth_ratio,
  round(attention_change_percent, 6) as attention_change_percent, zero_attention_baseline, growth_eligible, emerging_attention_candidate, round(participation_ratio, 6) as participation_ratio from repos""",
)
def repository_growth(spark, folder):
    out = repos(spark, folder).select("repo_id", "previous_attention", "current_attention", "attention_delta", "attention_growth_ratio", "star_growth_ratio", "attention_change_percent", "zero_attention_baseline", "growth_eligible", "emerging_attention_candidate", "participation_ratio")
    return rounded(out, "attention_growth_ratio", "star_growth_ratio", "attention_change_percent", "participation_ratio")


@ACTIVITY.add("repository_scores", REPOS + "select repo_id, round(activity_score, 6) as activity_score, round(trend_score, 6) as trend_score from repos")
def repository_scores(spark, folder):
    return rounded(repos(spark, folder).select("repo_id", "activity_score", "trend_score"), "activity_score", "trend_score")


def _ranking(name: str) -> None:
    test, order = ac.RANKINGS[name]
    columns = ["repo_id", "repo_name", *order]
    shown = ", ".join(f"round(round({c}, 9), 6) as {c}" if c in ("trend_score", "attention_growth_ratio") else c for c in columns)
    sql = REPOS + f"select {shown} from (select * from repos where {test or 'true'} order by {', '.join(f'round({c}, 9) desc' for c in order)}, repo_id limit 50)"

    @ACTIVITY.add(f"top_{name}", sql)
    def query(spark, folder):
        rows = repos(spark, folder).withColumns({c: F.round(c, 9) for c in order})
        top = ac.ranking(rows, name).select(*columns)
        return rounded(top, *[c for c in order if c in ("trend_score", "attention_growth_ratio")])


for _name in ac.RANKINGS:
    _ranking(_name)


@ACTIVITY.add("top_accounts", EV + "select actor_id, count(*) as total_events from ev group by 1 order by total_events desc, actor_id limit 50")
def top_accounts(spark, folder):
    return events(spark, folder).groupBy("actor_id").agg(F.count("*").alias("total_events")).orderBy(F.desc("total_events"), "actor_id").limit(50)


_EDGES = EV + f""", sel as (select repo_id from ev group by 1 order by count(*) filter ({MEASURES['star_events']}) desc, repo_id limit 20),
edges as (select repo_id, actor_id, count(*) as participation_events from ev join sel using (repo_id) group by 1, 2),
ranked as (select *, row_number() over (partition by repo_id order by participation_events desc, actor_id nulls first) as account_rank from edges)
"""


@ACTIVITY.add("participation_edges", _EDGES + "select repo_id, actor_id, participation_events, account_rank from ranked where account_rank <= 50")
def participation_edges(spark, folder):
    ev = events(spark, folder)
    return ac.participation(ev, ev.groupBy("repo_id").agg(F.count_if(predicates()["star_events"]).alias("star_events")))


@ACTIVITY.add(
    "enrichment_candidates",
    REPOS + """, a as (select repo_id, repo_name, 0 as p, row_number() over (order by star_events desc, repo_id) as r, 'star_activity' as reason from repos qualify r <= 10),
b as (select repo_id, repo_name, 1 as p, row_number() over (order by round(trend_score, 9) desc, repo_id) as r, 'intraday_trend' as reason from repos where growth_eligible qualify r <= 6),
c as (select repo_id, repo_name, 2 as p, row_number() over (order by total_events desc, repo_id) as r, 'overall_activity' as reason from repos qualify r <= 4),
d as (select repo_id, repo_name, 3 as p, row_number() over (order by star_events desc, repo_id) as r, 'star_activity_fill' as reason from repos qualify r <= 20),
u as (select * from a union all select * from b union all select * from c union all select * from d),
g as (select repo_id, any_value(repo_name) as repo_name, min((p, r)) as f, coalesce(string_agg(reason, ',' order by p) filter (p < 3), 'star_activity_fill') as reasons from u group by repo_id)
select repo_id, repo_name, reasons from g order by f limit 20""",
)
def enrichment_candidates(spark, folder):
    rows = repos(spark, folder).withColumn("trend_score", F.round("trend_score", 9))
    return ac.candidates(rows).select("repo_id", "repo_name", F.array_join("selection_reasons", ",").alias("reasons"))


_PART = lambda c, m: f"case when {m} > 0 then ln(1 + {c}) / ln(1 + {m}) else 0 end"
_WEIGHED = ", ".join(
    f"0.7 * ({' + '.join(f'{w} * ' + _PART(c, m) for w, c, m in zip(ws, ('current_stars', 'current_forks', 'current_active_accounts', 'current_prs_opened'), ('ms', 'mf', 'ma', 'mp'), strict=True))}) + 0.3 * ln(least(greatest(attention_growth_ratio, 1.0), 10.0)) / ln(10) as {label}"
    for label, ws in {"standard": ac.DEFAULT_WEIGHTS.values(), **ac.WEIGHTINGS}.items()
)
_TOP = lambda c: f"(select repo_id from weighed where growth_eligible order by round({c}, 9) desc, repo_id limit 20)"


@ACTIVITY.add(
    "score_sensitivity",
    REPOS + f", weighed as (select repo_id, growth_eligible, {_WEIGHED} from grown, mx) "
    + " union all ".join(f"select '{x}' as label, (select count(*) from {_TOP('standard')} a join {_TOP(x)} b using (repo_id)) as overlap, round((select count(*) from {_TOP('standard')} a join {_TOP(x)} b using (repo_id)) / (select count(*) from (select * from {_TOP('standard')} union select * from {_TOP(x)})), 6) as jaccard" for x in ac.WEIGHTINGS),
)
def score_sensitivity(spark, folder):
    return rounded(ac.score_sensitivity(repos(spark, folder)), "jaccard")


# ---------------------------------------------------------------- set operations and checks


@ACTIVITY.add("participation_parity", EV + "select (select count(*) from (select distinct repo_id, actor_id from ev)) as pairs, (select sum(n)::bigint from (select count(distinct actor_id) as n from ev group by repo_id)) as account_sum, (select sum(n)::bigint from (select count(distinct repo_id) as n from ev group by actor_id)) as repository_sum")
def participation_parity(spark, folder):
    pairs = events(spark, folder).select("repo_id", "actor_id").distinct()
    sums = [pairs.groupBy(k).agg(F.count("*").alias("n")).agg(F.sum("n").alias(name)) for k, name in (("repo_id", "account_sum"), ("actor_id", "repository_sum"))]
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(pairs.agg(F.count("*").alias("pairs"))).join(one(sums[0]), "_one").join(one(sums[1]), "_one").drop("_one")


_DAILY = "select event_date, repo_id, repo_name, count(*) as total_events, count(distinct actor_id) as active_accounts from {} group by 1, 2, 3"


@ACTIVITY.add(
    "daily_parity_diff",
    """with p as (select event_date, repo_id, total_events, active_accounts, push_events, star_events, fork_events from repository_daily),
f as (select event_date, repo_id, count(distinct event_id) as total_events, count(distinct actor_id) as active_accounts, count(distinct event_id) filter (event_type = 'PushEvent') as push_events,
  count(distinct event_id) filter (event_type = 'WatchEvent' and payload_action = 'started') as star_events, count(distinct event_id) filter (event_type = 'ForkEvent') as fork_events from silver_events group by 1, 2)
select 'published' as side, * from (select * from p except all select * from f) union all select 'recomputed', * from (select * from f except all select * from p)""",
)
def daily_parity_diff(spark, folder):
    columns = ["event_date", "repo_id", "total_events", "active_accounts", "push_events", "star_events", "fork_events"]
    fresh = bundle(events(spark, folder), ["event_date", "repo_id"]).select(*columns)
    published = table(spark, folder, "repository_daily").select(*columns)
    return published.exceptAll(fresh).select(F.lit("published").alias("side"), "*").unionByName(fresh.exceptAll(published).select(F.lit("recomputed").alias("side"), "*"))


@ACTIVITY.add("gold_conservation", EV + f"select (select count(*) from ev) as events, (select sum(n)::bigint from (select count(*) as n from ev group by repo_id)) as by_repository, (select sum(n)::bigint from (select count(*) as n from ev group by actor_id)) as by_account, (select count(*) from ev where event_time >= {START} and event_time < {END}) as in_window")
def gold_conservation(spark, folder):
    ev = events(spark, folder)
    one = lambda df, k: df.groupBy(k).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))
    parts = {"events": ev.agg(F.count("*").alias("n")), "by_repository": one(ev, "repo_id"), "by_account": one(ev, "actor_id"), "in_window": ac.hourly_dense(ev, WINDOW).agg(F.sum("total_events").alias("n"))}
    rows = None
    for name, df in parts.items():
        named = df.select(F.lit(name).alias("part"), "n")
        rows = named if rows is None else rows.unionByName(named)
    return rows.agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(p) for p in parts])


@ACTIVITY.add("score_bounds", REPOS + "select count(*) as repositories, count(*) filter (activity_score is null or trend_score is null or activity_score < 0 or activity_score > 1.00000001 or trend_score < 0 or trend_score > 1.00000001) as out_of_bounds from repos")
def score_bounds(spark, folder):
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1.00000001)
    return repos(spark, folder).agg(F.count("*").alias("repositories"), F.count_if(bad("activity_score") | bad("trend_score")).alias("out_of_bounds"))
