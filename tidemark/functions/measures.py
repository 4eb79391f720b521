"""One registry of event measures: used by every grouping, so a measure means the same at every grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import is_action, is_star, is_type


def predicates() -> dict[str, Column]:
    """Counted events by measure name."""
    return {
        "push_events": is_type("PushEvent"),
        "star_events": is_star(),
        "fork_events": is_type("ForkEvent"),
        "pull_request_events": is_type("PullRequestEvent"),
        "pull_requests_opened": is_action("PullRequestEvent", "opened"),
        "issues_opened": is_action("IssuesEvent", "opened"),
        "issue_comment_events": is_type("IssueCommentEvent"),
        "review_events": is_type("PullRequestReviewEvent", "PullRequestReviewCommentEvent"),
    }


def takes_part_in_code(reviews: bool = True) -> Column:
    """Pushing, opening a pull request and, in the published tables but not in the model features, reviewing."""
    part = is_type("PushEvent") | is_action("PullRequestEvent", "opened")
    return part | is_type("PullRequestReviewEvent") if reviews else part


def latest(label: str) -> Column:
    """The label of the newest event; equal times are decided by the record hash."""
    return F.max_by(label, F.struct("event_time", "raw_record_sha256"))


def bundle(events: DataFrame, keys: Sequence[str], label: str | None = None, extra: Sequence[Column] = (), sums: dict[str, Column] | None = None, accounts: dict[str, Column] | None = None) -> DataFrame:
    """The eleven shared measures per key: total, exact accounts, code accounts and the counted events.

    Two levels instead of several distinct counts: the first reduces to (keys, actor), which combines map-side and
    spreads a hot key by actor; the second adds up.  A null actor counts as events, not as an account.  ``extra``:
    first-level aggregates named like columns, combined by max (or min when the name starts with 'first').
    ``sums``: further events to count; ``accounts``: further conditions of which the accounts are counted.
    The latest label has its own first-level state, since a maximum of strings would slow the counts.
    """
    keys, counted, accounts = list(keys), {**predicates(), **(sums or {})}, accounts or {}
    first = [F.count("*").alias("total_events"), F.max(takes_part_in_code().cast("int")).alias("_code"), *[F.count_if(p).alias(n) for n, p in counted.items()], *[F.max(p.cast("int")).alias(f"_a_{n}") for n, p in accounts.items()], *extra]
    by_actor = events.groupBy(*keys, "actor_id").agg(*first)
    extras = [c for c in by_actor.columns if c not in {*keys, "actor_id", "total_events", "_code", *counted, *[f"_a_{n}" for n in accounts]}]
    out = by_actor.groupBy(*keys).agg(
        F.sum("total_events").alias("total_events"),
        F.count("actor_id").alias("active_accounts"),
        F.count_if((F.col("_code") == 1) & F.col("actor_id").isNotNull()).alias("code_participating_accounts"),
        *[F.sum(n).alias(n) for n in counted],
        *[F.count_if((F.col(f"_a_{n}") == 1) & F.col("actor_id").isNotNull()).alias(n) for n in accounts],
        *[(F.min(c) if c.startswith("first") else F.max(c)).alias(c) for c in extras],
    )
    if label is None:
        return out
    names = events.groupBy(*keys).agg(latest(label).alias(label))
    match = F.lit(True)
    renamed = names.withColumnsRenamed({k: f"_n_{k}" for k in keys})
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return out.join(renamed, match).drop(*[f"_n_{k}" for k in keys])
