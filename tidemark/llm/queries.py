"""Queries p3 and p8 to p10 and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import distinct_sketch as ds
from tidemark.llm import mixing, packing, truncation
from tidemark.llm.tokens import token_count
from tidemark.plans.registry import Registry
from tidemark.session import materialize
from tidemark.sources.tables import table

LLM = Registry()

# ---------------------------------------------------------------- p3: distinct counts


@LLM.add(
    "p3_found",
    """
with repo as (select repo_id, event_date, count(distinct actor_id) as n from silver_events group by 1, 2),
account as (
  select m.actor_id, m.window_start, count(distinct e.repo_id) as n from account_metrics m
  join silver_events e on e.actor_id = m.actor_id and e.event_date >= m.window_start and e.event_date < m.window_end group by 1, 2)
select 'active_accounts' as metric, d.repo_id as entity_id, strftime(d.event_date, '%Y-%m-%d') as day_utc
from repository_daily d left join repo r on r.repo_id = d.repo_id and r.event_date = d.event_date
where d.total_events >= 10 and abs(d.active_accounts - coalesce(r.n, 0)) > 0.2 * coalesce(r.n, 0)
union all
select 'active_repositories', m.actor_id, strftime(m.window_start, '%Y-%m-%d')
from account_metrics m left join account a on a.actor_id = m.actor_id and a.window_start = m.window_start
where m.total_events >= 10 and abs(m.active_repositories - coalesce(a.n, 0)) > 0.2 * coalesce(a.n, 0)""",
)
def p3_found(spark, folder):
    events = table(spark, folder, "silver_events")
    daily, accounts = (table(spark, folder, t).where("total_events >= 10") for t in ("repository_daily", "account_metrics"))
    repos = ds.wrong_counts(events, daily, ["repo_id", "event_date"], "actor_id", "active_accounts", 0.2)
    windows = ds.in_windows(events.select("actor_id", "event_date", "repo_id"), accounts)
    actors = ds.wrong_counts(windows, accounts, ["actor_id", "window_start", "window_end"], "repo_id", "active_repositories", 0.2)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day_utc")
    return repos.select(F.lit("active_accounts").alias("metric"), F.col("repo_id").alias("entity_id"), day("event_date")).unionByName(
        actors.select(F.lit("active_repositories").alias("metric"), F.col("actor_id").alias("entity_id"), day("window_start"))
    )


@LLM.add("p3_active_accounts")
def p3_active_accounts(spark, folder):
    """Distinct accounts per day, repository, event type and every combination, with the standard error of each."""
    return ds.cube_estimates(table(spark, folder, "silver_events"), ["event_date", "repo_id", "event_type"], "actor_id")


@LLM.add("p3_active_repositories")
def p3_active_repositories(spark, folder):
    return ds.estimate(ds.sketch(table(spark, folder, "silver_events"), ["actor_id"], "repo_id"), ["actor_id"])


@LLM.add("p3_type_overlap")
def p3_type_overlap(spark, folder):
    """Union, intersection and Jaccard index of the accounts of every two event types, per day."""
    return ds.compare(ds.sketch(table(spark, folder, "silver_events"), ["event_date", "event_type"], "actor_id"), ["event_date"], "event_type")


# ---------------------------------------------------------------- p8 to p10

_TOKENS = r"""length(regexp_replace(text, '[^\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}!-/:-@\[-`{-~]', '', 'g'))
  + length(regexp_replace(regexp_replace(text, '[^\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}!-/:-@\[-`{-~\s\pZ]+', chr(1), 'g'), '[^\x{01}]', '', 'g'))"""
_SIZED = f"with sized as (select doc_id, source, coalesce({_TOKENS}, 0) as tokens from documents)"


def _packed(spark, folder):
    targets = [(r[0], r[1]) for r in table(spark, folder, "pack_targets").select("container_kind", "capacity_tokens").collect()]  # a fixed control table
    return packing.pack_all(table(spark, folder, "documents").select("doc_id", "text"), targets, token_count(F.col("text")))


@LLM.add("p8_found", _SIZED + " select container_kind, doc_id from sized join pack_targets on tokens > capacity_tokens")
def p8_found(spark, folder):
    """The texts the packing had to cut: those with a second piece laid into a container."""
    return _packed(spark, folder).where("piece > 0 and container is not null").select("container_kind", "doc_id").distinct()


@LLM.add("p8_containers")
def p8_containers(spark, folder):
    return _packed(spark, folder)


@LLM.add("p8_report")
def p8_report(spark, folder):
    return packing.report(_packed(spark, folder))


def _sized(spark, folder):
    return materialize(table(spark, folder, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "document-sizes")


_MIX = (
    _SIZED
    + """, t as (select source, sum(tokens) as tokens from sized group by source),
  m as (select mix_id, source, max_repeats, target_weight / sum(target_weight) over (partition by mix_id) as share from mix_targets)
select mix_id, source from m left join t using (source) where coalesce(t.tokens, 0) * max_repeats < share * (select sum(tokens) from sized)"""
)


@LLM.add("p9_found", _MIX)
def p9_found(spark, folder):
    """Sources clamped in the first round of the water-filling: their cap lies below their own share."""
    plan, _ = mixing.mix_plan(_sized(spark, folder), table(spark, folder, "mix_targets"), F.col("tokens"))
    return plan.where("clamped_round = 0").select("mix_id", "source")


@LLM.add("p9_shares")
def p9_shares(spark, folder):
    return mixing.reached_shares(_sized(spark, folder), table(spark, folder, "mix_targets"), F.col("tokens"))


@LLM.add("p9_records")
def p9_records(spark, folder):
    documents = _sized(spark, folder)
    plan, _ = mixing.mix_plan(documents, table(spark, folder, "mix_targets"), F.col("tokens"))
    return mixing.mixed_records(documents, plan)


@LLM.add("p10_found")
def p10_found(spark, folder):
    return truncation.judged_documents(table(spark, folder, "documents")).where("cut").select("doc_id")


@LLM.add("p10_rates")
def p10_rates(spark, folder):
    return truncation.truncation_rates(table(spark, folder, "documents"))


@LLM.add("p10_limits")
def p10_limits(spark, folder):
    """Lengths at which a source's cut texts pile up: its field limits."""
    return truncation.field_limits(table(spark, folder, "documents"))
