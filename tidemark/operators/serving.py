"""Parameterized serving queries: rankings, search, comparison, history.  Arguments are checked before Spark sees them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.model import is_star, is_type
from tidemark.operators.language import NOT_ENRICHED, NOT_SELECTED, primary_label

# The columns a ranking may be sorted by, the filters a sort implies, and the longest search text.
SORTS = ("total_events", "star_events", "trend_score", "attention_growth_ratio", "active_accounts")
IMPLIED = {"trend_score": ("growth_eligible",), "attention_growth_ratio": ("growth_eligible", "attention_delta > 0")}
LONGEST_SEARCH = 150
ALL = "All"


def checked_limit(limit: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 200:
        raise ValueError("limit must be a whole number from 1 to 200")
    return limit


def contains_literal(column: str, text: str) -> Column:
    """Case-insensitive contains; the text is literal (no wildcards).  More than 150 characters are refused."""
    if len(text) > LONGEST_SEARCH:
        raise ValueError(f"a search text has at most {LONGEST_SEARCH} characters")
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def checked_range(first: date | None, last: date | None) -> None:
    if (first is None) != (last is None) or (first is not None and first > last):
        raise ValueError("give both dates, the first not after the last")


def rankings(repos: DataFrame, sort: str = "total_events", limit: int = 20, search: str = "", minimum: int = 0, language: str = ALL, metadata: DataFrame | None = None, daily: DataFrame | None = None, first: date | None = None, last: date | None = None) -> DataFrame:
    """A filtered ranking with language labels.  A sort by score or growth implies eligible (and growing) repositories.

    A date range keeps repositories seen in it, but their whole-window measures.
    """
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    if not isinstance(minimum, int) or isinstance(minimum, bool) or minimum < 0:
        raise ValueError("the minimum must be a whole number from 0 on")
    if language != ALL and metadata is None:
        raise ValueError("a language filter needs metadata")
    checked_range(first, last)
    tests = [contains_literal("repo_name", search), F.col("total_events") >= minimum, *[F.expr(t) for t in IMPLIED.get(sort, ())]]
    out = repos.where(reduce(Column.__and__, tests))
    if metadata is not None:
        out = with_labels(out, metadata)
    if language != ALL:
        out = out.where(F.col("primary_language") == language)
    if first is not None:
        out = observed_between(out, daily, first, last)
    return out.orderBy(F.col(sort).desc(), "repo_id").limit(checked_limit(limit))


def observed_between(repos: DataFrame, daily: DataFrame, first: date, last: date) -> DataFrame:
    return repos.join(daily.where(F.col("event_date").between(first, last)).select("repo_id"), "repo_id", "left_semi")


def with_labels(repos: DataFrame, metadata: DataFrame) -> DataFrame:
    labels = metadata.select("repo_id", primary_label().alias("primary_language"), F.col("status").alias("enrichment_status"))
    return repos.join(labels, "repo_id", "left").fillna({"primary_language": NOT_ENRICHED, "enrichment_status": NOT_SELECTED})


def compare(repos: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Two to four distinct repositories side by side; fails if one is missing."""
    if not 2 <= len(ids) <= 4 or len(set(ids)) != len(ids):
        raise ValueError("compare two to four distinct repositories")
    found = repos.where(F.col("repo_id").isin(*ids))
    if found.select("repo_id").distinct().count() != len(ids):
        raise LookupError("a repository is not in the table")
    return found.orderBy("repo_id")


def history(daily: DataFrame, key: str, value: int) -> DataFrame:
    hours = [c for c in ("event_date", "event_hour") if c in daily.columns]
    return daily.where(F.col(key) == value).orderBy(*hours)


def search_accounts(accounts: DataFrame, text: str, limit: int = 50) -> DataFrame:
    return accounts.where(contains_literal("actor_login", text)).orderBy(F.desc("total_events"), "actor_id").limit(checked_limit(limit))


def labelled_edges(edges: DataFrame, repos: DataFrame, accounts: DataFrame, limit: int = 100) -> DataFrame:
    """The strongest edges with names: the top list is taken before the names are joined."""
    top = edges.orderBy(F.desc("participation_events"), "repo_id", "actor_id").limit(checked_limit(limit))
    return top.join(repos.select("repo_id", "repo_name"), "repo_id").join(accounts.select("actor_id", "actor_login"), "actor_id").orderBy(F.desc("participation_events"), "repo_id", "actor_id")


def options(table: DataFrame, column: str, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct values of a column and fixed extra ones, each once."""
    values = table.select(F.col(column).alias("value")).where(F.col(column).isNotNull())
    more = table.sparkSession.createDataFrame([(x,) for x in extra], "value string")
    return values.union(more).distinct()


def recent_repositories(events: DataFrame, minutes: int = 10, limit: int = 20) -> DataFrame:
    """Recent against previous counts, anchored at the newest event: (max - w, max] and (max - 2w, max - w].

    A spike has at least 10 recent events and twice the previous ones, each plus one; it is judged before rounding.
    """
    span = minutes * 60_000_000
    top = events.agg(F.max(F.unix_micros("event_time")).alias("_top")).withColumn("_one", F.lit(1))
    timed = events.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").withColumn("_age", F.col("_top") - F.unix_micros("event_time")).where(F.col("_age") < 2 * span)
    recent = F.col("_age") < span
    counts = timed.groupBy("repo_id").agg(
        F.count_if(recent).alias("recent_events"), F.count_if(recent & is_star()).alias("recent_stars"), F.count_if(recent & is_type("ForkEvent")).alias("recent_forks"),
        F.count_if(~recent).alias("previous_events"), F.max_by("repo_name", F.struct("event_time", "event_id")).alias("repo_name"),
    )
    ratio = (F.col("recent_events") + 1.0) / (F.col("previous_events") + 1.0)
    out = counts.withColumns({"activity_spike": (F.col("recent_events") >= 10) & (ratio >= 2), "activity_ratio": F.round(ratio, 2)})
    return out.orderBy(F.desc("recent_events"), "repo_id").limit(limit)


def recent_accounts(events: DataFrame, minutes: int = 10, limit: int = 20) -> DataFrame:
    span = minutes * 60_000_000
    top = events.agg(F.max(F.unix_micros("event_time")).alias("_top")).withColumn("_one", F.lit(1))
    timed = events.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").where(F.col("_top") - F.unix_micros("event_time") < span)
    out = timed.groupBy("actor_id").agg(F.count("*").alias("recent_events"), F.max(F.unix_micros("event_time")).alias("last_us"), F.max_by("actor_login", F.struct("event_time", "event_id")).alias("actor_login"))
    return out.orderBy(F.desc("recent_events"), "actor_id").limit(limit)


def placed(rows: DataFrame, order: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """Rows in order with their place from 1.  For results that are small by nature or limited: the rows kept are numbered
    in one task."""
    some = rows.orderBy(*order) if limit is None else rows.orderBy(*order).limit(checked_limit(limit))
    return some.withColumn("place", F.row_number().over(W.orderBy(*order)))


def latest_runs(runs: DataFrame, time: str, name: str, limit: int = 25, status_order: Sequence[str] = ()) -> DataFrame:
    """The newest runs or batches; those of the statuses in ``status_order`` first, in that order."""
    first = [F.coalesce(*[F.when(F.col("status") == x, i) for i, x in enumerate(status_order)], F.lit(len(status_order)))] if status_order else []
    return placed(runs, [*first, F.col(time).desc(), name], limit)
