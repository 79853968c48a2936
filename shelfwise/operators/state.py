"""Exactly-once facts and current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_location, order_event_key
from ..model import KEY
from .keyed import earliest, latest, running

# One chunk of a log partition holds at most this many records, because offsets are unique.
OFFSET_CHUNK = 65536


def dedup_movements(movements: DataFrame, arrival: Sequence[str] = ("partition", "offset")) -> DataFrame:
    """First arrival per movement id."""
    return earliest(movements, ["movement_id"], arrival)


def dedup_business_key(movements: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """First arrival per (source event, sku, location, type)."""
    keys = ["source_event_id", "sku_id", "location_code", "movement_type"]
    return earliest(movements, keys, arrival)


def current_balance(
    changes: DataFrame, position: str = "offset", snapshot: Column | None = None, chunk: Column | None = None
) -> DataFrame:
    """Reset-aware current balance per key.

    In log order a higher version replaces a lower one; a snapshot replaces whatever is stored.
    Only the changes from the last snapshot on can win, and among those the highest version,
    earliest first. `position` must be unique per key. A key's changes are first settled in chunks of
    the log, each from its own last snapshot on, then its chunks: a hot key is spread over its chunks.
    """
    snapshot = F.col("operation") == "SNAPSHOT" if snapshot is None else snapshot
    chunk = F.floor(F.col(position) / OFFSET_CHUNK) if chunk is None else chunk
    best = ["version", -F.col(position)]
    in_chunk, of_key = Window.partitionBy(*KEY, "_chunk"), Window.partitionBy(*KEY)
    reset = F.max(F.when(F.col("_snapshot"), F.col(position)))
    alive = (
        changes.withColumn("_snapshot", snapshot).withColumn("_chunk", chunk)
        .withColumn("_reset", reset.over(in_chunk))
        .filter(F.col("_reset").isNull() | (F.col(position) >= F.col("_reset")))
    )
    settled = latest(alive, [*KEY, "_chunk"], best).withColumn("_last", F.max("_reset").over(of_key))
    after = F.col("_last").isNull() | (F.col("_reset") == F.col("_last")) | (F.col(position) > F.col("_last"))
    return latest(settled.filter(after), KEY, best).select(*changes.columns)


def flag_stale_balances(
    changes: DataFrame, position: str = "offset", chunk: Column | None = None
) -> DataFrame:
    """Marks every change ACCEPTED, STALE or RESET."""
    chunk = F.floor(F.col(position) / OFFSET_CHUNK) if chunk is None else chunk
    is_reset = F.col("operation") == "SNAPSHOT"
    # The newest snapshot at or before a row, and with it the best version since then: comparing
    # (segment, version) pairs makes one running maximum do both.
    segmented = running(
        changes, KEY, [position], chunk,
        maxes={"_segment": F.when(is_reset, F.col(position))},
    ).withColumn("_segment", F.coalesce("_segment", F.lit(-1)))
    ranked = running(
        segmented, KEY, [position], chunk,
        maxes={"_best": F.struct(F.col("_segment").alias("s"), F.col("version").alias("v"))},
        exclusive=True,
    )
    same_segment = F.col("_best.s") == F.col("_segment")
    best = F.when(same_segment, F.col("_best.v"))
    outcome = (
        F.when(is_reset, "RESET")
        .when(best.isNull() | (F.col("version") > best), "ACCEPTED")
        .otherwise("STALE")
    )
    return ranked.withColumn("outcome", outcome).drop("_segment", "_best")


def latest_by(
    df: DataFrame, keys: Sequence[str], version: str, tiebreak: str
) -> DataFrame:
    """Replacing-merge read: highest version per key, the last inserted wins ties."""
    return latest(df, keys, [version, tiebreak])


def latest_per_minute(features: DataFrame, tiebreak: str) -> DataFrame:
    """Newest feature row per key and minute of its evaluation time."""
    with_minute = features.withColumn("minute", F.date_trunc("minute", "computed_at"))
    return latest(with_minute, [*KEY, "minute"], ["computed_at", tiebreak])


def movement_exists(movements: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids that are already stored."""
    return ids.join(movements.select("movement_id"), "movement_id", "left_semi")


def dedup_events(events: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """First event per own id or, without one, per derived key."""
    keyed = events.withColumn(
        "event_key",
        order_event_key("event_id", "order_id", "sku_id", "location_code", "quantity_depleted"),
    )
    return earliest(keyed, ["event_key"], arrival)


def validate_stock_events(events: DataFrame) -> DataFrame:
    """Adds `outcome` (POISON, SKIPPED, ACCEPTED), its reason and the data status."""
    reason = (
        F.when(F.col("order_id") <= 0, "order_id must be positive")
        .when(F.col("sku_id") <= 0, "sku_id must be positive")
        .when(normalize_location("location_code") == "", "location_code is required")
        .when(F.col("quantity_depleted") <= 0, "quantity_depleted must be positive")
    )
    missing = F.col("balance").isNull()
    return (
        events.withColumn("reason", reason)
        .withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), "POISON").when(missing, "SKIPPED").otherwise("ACCEPTED"),
        )
        .withColumn(
            "data_status",
            F.when(
                F.col("outcome") == "ACCEPTED",
                F.when(F.coalesce("balance.authoritative", F.lit(False)), "FINAL").otherwise("UNRECONCILED"),
            ),
        )
    )


def open_replenishments(replenishments: DataFrame, tiebreak: str = "updated_at") -> DataFrame:
    """Newest state of every operation that is still OPEN."""
    newest = latest(replenishments, ["operation_id"], ["updated_at", tiebreak])
    return newest.filter(F.col("status") == "OPEN")


def recovery_state(balances: DataFrame, models: DataFrame, replenishments: DataFrame) -> DataFrame:
    """Per key: newest balance, newest model and the oldest open replenishment.

    `balances` needs version, `models` needs updated_at and model, each plus a `seq` tie-break.
    """
    balance = latest_by(balances, KEY, "version", "seq").drop("seq")
    model = latest_by(models, KEY, "updated_at", "seq").select(*KEY, "model")
    incoming = incoming_supply(replenishments)
    return balance.join(model, KEY, "full").join(incoming, KEY, "full")


def incoming_supply(replenishments: DataFrame) -> DataFrame:
    """Open quantity per key; a key has one open replenishment, the first one placed."""
    placed = open_replenishments(replenishments)
    return earliest(placed, KEY, ["created_at", "operation_id"]).select(
        *KEY, F.col("quantity").alias("incoming")
    )
