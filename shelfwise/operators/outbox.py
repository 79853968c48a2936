"""Outbox and inbox tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import short_type_name
from .keyed import earliest


def outbox_pending(log: DataFrame, transaction_id: str | None = None) -> DataFrame:
    """Unpublished events, oldest first, of one transaction or of all."""
    pending = log.filter(F.col("state") == "NotPublished")
    if transaction_id is not None:
        pending = pending.filter(F.col("transaction_id") == transaction_id)
    return pending.withColumn("short_type", short_type_name("event_type_name")).orderBy(
        "creation_time", "event_id"
    )


def outbox_state(transitions: DataFrame) -> DataFrame:
    """Last state per event and how often it was sent."""
    return transitions.groupBy("event_id").agg(
        F.max_by("state", F.struct("changed_at", "seq")).alias("state"),
        F.count(F.when(F.col("state") == "InProgress", 1)).alias("times_sent"),
    )


def inbox_dedup(events: DataFrame, arrival: list[str]) -> DataFrame:
    """First delivery per event id."""
    return earliest(events, ["event_id"], arrival)
