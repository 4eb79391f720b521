"""Vocabulary of the activity model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known event types.
EVENT_TYPES = [
    "CommitCommentEvent",
    "CreateEvent",
    "DeleteEvent",
    "DiscussionEvent",
    "ForkEvent",
    "GollumEvent",
    "IssueCommentEvent",
    "IssuesEvent",
    "MemberEvent",
    "PublicEvent",
    "PullRequestEvent",
    "PullRequestReviewCommentEvent",
    "PullRequestReviewEvent",
    "PushEvent",
    "ReleaseEvent",
    "WatchEvent",
]
# The payload actions that get a column of their own in the feature table.
ACTIONS = ["closed", "created", "edited", "opened", "published", "reopened", "started", "stopped", "submitted"]


def is_type(*names: str) -> Column:
    return F.col("event_type").isin(*names) if len(names) > 1 else F.col("event_type") == names[0]


def is_star() -> Column:
    return is_type("WatchEvent") & (F.col("payload_action") == "started")


def is_action(event_type: str, action: str) -> Column:
    return is_type(event_type) & (F.col("payload_action") == action)
