"""One row per entity and as-of time from events: counts, recency and totals per event type and action.

The events are first reduced to a compact long table (entity, as-of, type, action, account), map-side, and only that is
pivoted, with an explicit list of columns: no pass to discover values, and a new event type falls into ``other``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import ACTIONS, EVENT_TYPES
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize

NARROW = ("event_id", "repo_id", "actor_id", "event_type", "payload_action", "event_time")
DAY = 86_400


def unique_events(events: DataFrame, columns: Sequence[str] = NARROW) -> DataFrame:
    """Each event_id once, by its copy from the earliest archive (nulls last; equal ones are decided by a hash of the
    columns).  Rows without event_id cannot be told apart and are left out.  Spark keeps one row per id and task before
    the shuffle, so a much repeated id is no hot key."""
    best = W.partitionBy("event_id").orderBy(F.col("source_archive_start").asc_nulls_last(), "_h")
    named = events.where(F.col("event_id").isNotNull()).select(*columns, "source_archive_start", F.xxhash64(*columns).alias("_h"))
    return named.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*columns)


def as_of_points(events: DataFrame, points: DataFrame, days: int = 7, column: str = "as_of_utc") -> DataFrame:
    """Each event with every as-of time whose window [as_of - days, as_of) holds it.

    The as-of times are binned by window length and the event looked up in its own and the next bin: an equi-join on
    the bin, whatever times the points have.  Repeated points count once; null points and times match nothing.
    """
    width = days * DAY * 1_000_000
    bin_of = lambda c: F.floor(F.unix_micros(c) / F.lit(width))
    table = points.select(F.col(column).alias("as_of_utc")).where(F.col("as_of_utc").isNotNull()).distinct().withColumn("_bin", bin_of(F.col("as_of_utc")))
    binned = events.withColumn("_bin", F.explode(F.array(bin_of(F.col("event_time")), bin_of(F.col("event_time")) + 1)))
    joined = lookup_join(binned, materialize(table, "as-of"), ["_bin"], ["event_id"]).drop("_bin")
    back = F.unix_micros("as_of_utc") - F.unix_micros("event_time")
    return joined.where((back > 0) & (back <= width))


def within_reach(events: DataFrame, points: DataFrame, days: int, column: str = "as_of_utc") -> DataFrame:
    """The events between the first window's start and the last as-of time, as a filter the scan can use.  Copies of an
    event agree in their time."""
    span = points.agg(F.min(F.unix_micros(column)).alias("first"), F.max(F.unix_micros(column)).alias("last")).first()
    if span["last"] is None:
        return events.limit(0)
    bound = lambda us: F.expr(f"timestamp_micros({us})")
    return events.where((F.col("event_time") >= bound(span["first"] - days * DAY * 1_000_000)) & (F.col("event_time") < bound(span["last"])))


WHOLE = "#entity"


def long_table(events: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(entity, event_type, payload_action, n, last_time, accounts), and per entity a row of type '#entity' with all its
    events and its distinct accounts.

    Both come from one reduction by entity, account, type and action, which is shuffled once: the account spreads hot
    entities over tasks, and both results use all of its columns, so Spark reuses the exchange.
    """
    by_account = events.groupBy(*entity, "actor_id", "event_type", "payload_action").agg(F.count("*").alias("n"), F.max("event_time").alias("last_time"))
    types = by_account.groupBy(*entity, "event_type", "payload_action").agg(F.sum("n").alias("n"), F.max("last_time").alias("last_time"), F.lit(None).cast("long").alias("accounts"))
    whole = by_account.groupBy(*entity, "actor_id").agg(F.sum("n").alias("n"), F.max("last_time").alias("last_time")).groupBy(*entity).agg(F.sum("n").alias("n"), F.max("last_time").alias("last_time"), F.count("actor_id").alias("accounts"))
    return types.unionByName(whole.select(*entity, F.lit(WHOLE).alias("event_type"), F.lit(None).cast("string").alias("payload_action"), "n", "last_time", "accounts"))


def snake(name: str) -> str:
    out = "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")
    return out.removesuffix("_event")


def pivot_features(long: DataFrame, entity: Sequence[str], as_of: str | None = "as_of_utc", types: Sequence[str] = EVENT_TYPES, actions: Sequence[str] = ACTIONS) -> DataFrame:
    """The wide table: n_<type>, n_<type>_<action>, n_action_<action>, seconds since the last event of each type.

    Types and actions outside the lists count in n_other and in total_events, so counts always add up.  Without an
    as-of column the last times themselves come out.
    """
    n, known = F.col("n"), F.col("event_type").isin(*types)
    whole = F.col("event_type").eqNullSafe(F.lit(WHOLE))
    real = ~whole
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    since = lambda last: F.when(last.isNotNull(), F.unix_seconds(F.col(as_of)) - F.unix_seconds(last)) if as_of else last
    columns: list[Column] = [total(whole).alias("total_events"), F.coalesce(F.max("accounts"), F.lit(0)).alias("active_accounts"), since(F.max(F.when(whole, F.col("last_time")))).alias("recency_any")]
    for t in types:
        mine = F.col("event_type") == t
        columns += [total(mine).alias(f"n_{snake(t)}"), since(F.max(F.when(mine, F.col("last_time")))).alias(f"recency_{snake(t)}")]
        columns += [total(mine & (F.col("payload_action") == a)).alias(f"n_{snake(t)}_{a}") for a in actions]
    columns += [total(real & ~F.coalesce(known, F.lit(False))).alias("n_other")]
    columns += [total(real & (F.col("payload_action") == a)).alias(f"n_action_{a}") for a in actions]
    return long.groupBy(*entity).agg(*columns)


def entity_features(events: DataFrame, points: DataFrame, entity: str = "repo_id", days: int = 7, types: Sequence[str] = EVENT_TYPES, actions: Sequence[str] = ACTIONS) -> DataFrame:
    """One row per entity and as-of time with at least one event in the window.

    Every event_id counts once and its archive time is ignored.  Events without entity are left out.  An empty table
    gives no rows.
    """
    near = within_reach(events, points, days).where(F.col(entity).isNotNull())
    inside = as_of_points(unique_events(near), points, days)
    return pivot_features(long_table(inside, [entity, "as_of_utc"]), [entity, "as_of_utc"], types=types, actions=actions)


def stale_features(events: DataFrame, published: DataFrame, days: int = 7) -> DataFrame:
    """Published (repo_id, as_of_utc) rows whose stars, pushes or accounts differ from the events; null is a difference."""
    fresh = entity_features(events, published, days=days, types=["PushEvent", "WatchEvent"], actions=["started"])
    pairs = {"recent_stars": "n_watch_started", "recent_pushes": "n_push", "active_accounts": "active_accounts"}
    truth = fresh.select("repo_id", "as_of_utc", *[F.col(v).alias(f"_{k}") for k, v in pairs.items()])
    both = published.select("repo_id", "as_of_utc", *pairs).join(truth, ["repo_id", "as_of_utc"], "left").fillna(0, [f"_{k}" for k in pairs])
    wrong = F.lit(False)
    for k in pairs:
        wrong = wrong | ~F.col(k).eqNullSafe(F.col(f"_{k}"))
    return both.where(wrong).select("repo_id", "as_of_utc")
