"""Clean events and repository metadata to the Gold snapshot: fifteen tables, published together after their totals agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.measures import bundle
from tidemark.operators import activity, language
from tidemark.session import materialize
from tidemark.sources import snapshots
from tidemark.sources.snapshots import ContractBroken, Table

# Tables whose total_events add up to all clean events.
CONSERVING = ("repository_metrics", "repository_daily", "repository_hourly", "account_metrics", "account_daily", "account_hourly", "activity_calendar", "language_primary_daily")
FILES = 8


def repository_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata with its labels, one row per repository."""
    return metadata.select("repo_id", F.col("status").alias("enrichment_status"), language.primary_label().alias("primary_language"), "topics", language.categories().alias("technology_categories"), "description", "created_at")


def tables(events: DataFrame, window: activity.Window, metadata: DataFrame) -> dict[str, Table]:
    """How each Gold table is made.  The repository table is made once and read by those that need it."""
    made: dict[str, DataFrame] = {}

    def repos() -> DataFrame:
        if "repos" not in made:
            made["repos"] = materialize(activity.repositories(events, window), "repositories")
        return made["repos"]

    date, actor = ["event_date"], ["actor_id"]
    account = lambda *more: lambda: activity.accounts(events, ("actor_id", *more))
    table = lambda rows, key, by=(): Table(rows, key, by, files=None if by else FILES)
    return {
        "repository_metrics": table(repos, ["repo_id"]),
        "repository_daily": table(lambda: bundle(events, ["event_date", "repo_id"], "repo_name"), ["event_date", "repo_id"], date),
        "repository_hourly": table(lambda: bundle(events, ["event_date", "event_hour", "repo_id"]), ["event_date", "event_hour", "repo_id"], date),
        "account_metrics": table(account(), actor),
        "account_daily": table(account("event_date"), [*actor, "event_date"], date),
        "account_hourly": table(account("event_date", "event_hour"), [*actor, "event_date", "event_hour"], date),
        "activity_calendar": table(lambda: activity.calendar(events), date),
        "hourly_activity": table(lambda: activity.hourly_dense(events, window), ["event_date", "event_hour"]),
        "participation_edges_sample": table(lambda: activity.participation(events, repos()), ["repo_id", "actor_id"]),
        "repository_metadata": table(lambda: repository_metadata(metadata), ["repo_id"]),
        "repository_language_shares": table(lambda: language.language_shares(metadata), ["repo_id", "language"]),
        "language_primary_daily": table(lambda: language.primary_daily(events, metadata), ["event_date", "primary_language", "enrichment_status"]),
        "language_weighted_daily": table(lambda: language.weighted_daily(events, metadata), ["event_date", "language"]),
        "technology_daily": table(lambda: language.technology_daily(events, metadata), ["event_date", "technology_category"]),
        "language_intraday_growth": table(lambda: language.language_growth(repos(), metadata), ["primary_language", "enrichment_status"]),
    }


def publish(spark: SparkSession, events: DataFrame, window: activity.Window, metadata: DataFrame, root: str, recipe: dict, quota_bytes: int | None = None) -> tuple[str, bool]:
    """(folder, reused).  Published only if totals agree with the events: every table that must conserve them does, the
    hours of the window are all there and hold what both halves hold, attributed events add up, and the coverage is told."""

    def check(back: dict[str, DataFrame]) -> dict:
        n = events.count()
        total = lambda t, c="total_events": back[t].agg(F.sum(c)).first()[0] or 0
        off = [t for t in CONSERVING if total(t) != n]
        if off:
            raise ContractBroken(f"events are not conserved in {', '.join(off)}")
        if abs(total("language_weighted_daily", "attributed_total_events") - n) > max(0.01, 1e-9 * n):
            raise ContractBroken("attributed events do not add up to the events")
        hours, in_window = back["hourly_activity"].count(), total("hourly_activity")
        halves = back["repository_metrics"].agg(F.sum(F.col("previous_events") + F.col("current_events"))).first()[0] or 0
        if hours != window.hours or in_window != halves:
            raise ContractBroken("the hours of the window do not hold what its halves hold")
        c = language.coverage(events, metadata).first().asDict()
        return {"events": n, "in_window": in_window, "outside_window": n - in_window, "coverage": c}

    full = {**recipe, "window": [window.start.isoformat(), window.hours], "weights": activity.DEFAULT_WEIGHTS}
    return snapshots.publish(spark, root, full, tables(events, window, metadata), check, quota_bytes)
