"""Schemas, value domains and policy defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Topics, schema versions and enumerations carried on the rows.
MOVEMENT_TOPIC = "inventory.inventory_movements"
BALANCE_TOPIC = "inventory.inventory_balances"
MOVEMENT_TABLE = "inventory_movements"
BALANCE_TABLE = "inventory_balances"
RAW_EVENT_SCHEMA_VERSION = "raw-kafka-event-v1"
SILVER_EVENT_SCHEMA_VERSION = "silver-inventory-event-v1"
GOLD_DAILY_DEMAND_SCHEMA_VERSION = "gold-daily-demand-v1"
MOVEMENT_TYPES = ("Reserve", "Release", "Sale", "Restock", "Return", "Adjustment")
OPERATIONS = {"c": "CREATE", "u": "UPDATE", "d": "DELETE", "r": "SNAPSHOT"}
LOCATIONS = ("NCR", "BLR", "BOM", "HYD")
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
ORDER_STATUSES = ("Submitted", "AwaitingValidation", "StockConfirmed", "Paid", "Shipped", "Cancelled")
# End of fixed values.


@dataclass(frozen=True)
class ReplenishmentPolicy:
    lead_time_days: float = 2.0
    review_period_days: float = 1.0
    service_factor: float = 1.65
    medium_risk_hours: float = 96.0
    high_risk_hours: float = 48.0
    critical_risk_hours: float = 24.0
    model_version: str = "adaptive-ewma-seasonal-v1"
    mode: str = "OBSERVE"


@dataclass(frozen=True)
class GovernancePolicy:
    policy_version: str = "replenishment-governance-v1"
    allow_medium: bool = False
    allow_high: bool = False
    allow_critical: bool = False


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CHANGE_LOG = _struct(
    "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"
).add("headers", T.ArrayType(_struct("key string, value binary")))
BRONZE = _struct(
    "topic string, partition int, offset bigint, event_timestamp timestamp, key_base64 string, "
    "value_base64 string, value_is_null boolean, headers_json string, ingestion_timestamp timestamp, "
    "schema_version string, date date, hour int"
)
MOVEMENT = _struct(
    "movement_id string, source_event_id string, sku_id int, location_code string, order_id int, "
    "movement_type string, quantity int, occurred_at timestamp, recorded_at timestamp, "
    "resulting_balance_version bigint, reason string"
)
BALANCE = _struct(
    "sku_id int, location_code string, on_hand int, reserved int, available int, safety_stock int, "
    "reorder_point int, max_stock int, version bigint, updated_at timestamp"
)
SILVER = _struct(
    "event_id string, source_topic string, source_partition int, source_offset bigint, "
    "cdc_operation string, event_type string, sku_id int, location_code string, movement_type string, "
    "quantity int, occurred_at timestamp, balance_version bigint, on_hand int, reserved int, "
    "available int, schema_version string"
)
SILVER_REQUIRED = (
    "event_id", "source_topic", "source_partition", "source_offset", "cdc_operation",
    "event_type", "schema_version",
)
DEAD_LETTER = _struct(
    "topic string, partition int, offset bigint, error string, payload string, recorded_at timestamp"
)
KEY = ["sku_id", "location_code"]
