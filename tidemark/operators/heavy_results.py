"""Per-key results although few keys hold most rows: eager aggregation.

Rows are reduced by key before anything is joined or rolled up, so a hot key reaches a shuffle as one row per task.
Exact distinct counts go through (key, member) states: the member spreads a hot key over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import is_action, is_star, is_type
from tidemark.operators.feature_table import unique_events
from tidemark.operators.skew import eager_join
from tidemark.session import materialize

EVENT_COLUMNS = ("event_id", "event_type", "payload_action", "repo_id", "actor_id", "event_time", "event_date")


def key_states(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(key_field, key_value, n): the rows per value of several key columns.  Null keys are kept.

    Every column is reduced on its own, from a scan that reads nothing else, so no row is doubled.
    """
    parts = [events.groupBy(F.col(f).cast("long").alias("key_value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("key_field"), "key_value", "n") for f in fields]
    return reduce(DataFrame.unionByName, parts)


def dominant_keys(events: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """(key_field, key_value): keys that hold at least ``share`` of all rows, null keys left out but counted.

    The share of a key is asked of the join of all rows with all rows of the same field: a key with n of N rows has n * N
    of its N * N rows.  The join is never formed: both inputs are the compact states, reduced by field, and the counts are
    multiplied.
    """
    states = materialize(key_states(events, fields), "key-states")
    joined = eager_join(states, states, ["key_field"], ["key_value"], left_rows="n", right_rows="n", small_right=len(fields))
    part = Fraction(str(share))  # whole numbers on both sides, so a key that holds exactly the share is never lost
    whole = F.col("right_rows").cast("decimal(18,0)") * F.col("right_rows").cast("decimal(18,0)")
    held = F.col("rows") * F.lit(part.denominator).cast("decimal(10,0)") >= whole * F.lit(part.numerator).cast("decimal(10,0)")
    return joined.where(held & F.col("key_value").isNotNull()).select("key_field", "key_value")


def pair_states(events: DataFrame) -> DataFrame:
    """Compact states per (repo_id, actor_id, event_date): counts that add up to every per-key result."""
    return unique_events(events, EVENT_COLUMNS).groupBy("repo_id", "actor_id", "event_date").agg(
        F.count("*").alias("total"), F.count_if(is_type("PushEvent")).alias("pushes"), F.count_if(is_star()).alias("stars"), F.count_if(is_type("ForkEvent")).alias("forks"),
        F.count_if(is_action("PullRequestEvent", "opened")).alias("opened"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"),
    )


def repository_results(events: DataFrame) -> DataFrame:
    """repository results: totals and exact distinct accounts per repo_id, each event_id once."""
    by_pair = pair_states(events).groupBy("repo_id", "actor_id").agg(*[F.sum(c).alias(c) for c in ("total", "pushes", "stars", "forks", "opened")], F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    return by_pair.groupBy("repo_id").agg(
        F.sum("total").alias("total_events"), F.count("actor_id").alias("active_accounts"), F.sum("pushes").alias("push_events"), F.sum("stars").alias("star_events"), F.sum("forks").alias("fork_events"),
        F.sum("opened").alias("pull_requests_opened"), F.min("first_time").alias("first_event_time"), F.max("last_time").alias("last_event_time"),
    )


def account_results(events: DataFrame) -> DataFrame:
    """Account results: totals, exact distinct repositories and active days per actor_id."""
    states = materialize(pair_states(events), "pair-states").withColumn("weekend", F.when(F.dayofweek("event_date").isin(1, 7), F.col("total")).otherwise(0))
    sums = ("total", "pushes", "opened", "weekend")
    by_repo = states.groupBy("actor_id", "repo_id").agg(*[F.sum(c).alias(c) for c in sums])
    by_day = states.select("actor_id", "event_date").distinct().groupBy("actor_id").agg(F.count("event_date").alias("active_days"))
    totals = by_repo.groupBy("actor_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("repo_id").alias("active_repositories"))
    joined = totals.join(by_day, totals["actor_id"].eqNullSafe(by_day["actor_id"])).drop(by_day["actor_id"])
    return joined.select("actor_id", F.col("total").alias("total_events"), "active_repositories", "active_days", F.col("pushes").alias("push_events"), F.col("opened").alias("pull_requests_opened"), F.col("weekend").alias("weekend_events"))


def stored_bytes_by_repository(events: DataFrame, files: DataFrame) -> DataFrame:
    """Per repo_id: rows of the join of events with the file listing, and the listed bytes over those rows.

    The join is many to many (files are listed twice): both inputs are reduced by file_id first, then the counts are
    multiplied and rolled up.  The result equals the aggregate over the full join.
    """
    joined = eager_join(events.select("file_id", "repo_id"), files.select("file_id", "n_bytes"), ["file_id"], ["repo_id"], right_sums=["n_bytes"])
    return joined.groupBy("repo_id").agg(F.sum("rows").cast("long").alias("joined_rows"), F.sum("right_n_bytes").alias("joined_bytes"))
