"""Change log -> bronze, silver, gold, dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import demand as d
from shelfwise.operators.decode import balances_of, decode_changes, movements_of
from shelfwise.operators.state import movement_exists
from shelfwise.sources import lake

from .registry import query
from .views import INGESTED_AT

STAMP = "%Y-%m-%d %H:%M:%S.%f"
INGESTED = f"TIMESTAMP '{INGESTED_AT}'"


def ingested():
    return F.lit(INGESTED_AT).cast("timestamp")


BRONZE_SQL = f"""SELECT topic, "partition", "offset", strftime(event_timestamp, '{STAMP}') AS event_timestamp,
   base64(encode(key_text)) AS key_base64, base64(encode(value_text)) AS value_base64, value_text IS NULL AS value_is_null,
   CASE WHEN event_id % 5 = 0 THEN '[{{"key":"origin","value_base64":"Y2Rj"}}]' ELSE '[]' END AS headers_json,
   strftime({INGESTED}, '{STAMP}') AS ingestion_timestamp, 'raw-kafka-event-v1' AS schema_version,
   strftime(coalesce(event_timestamp, {INGESTED}), '%Y-%m-%d') AS date,
   CAST(hour(coalesce(event_timestamp, {INGESTED})) AS INTEGER) AS hour FROM v_envelope"""


@query("bronze_records", BRONZE_SQL, "v_envelope")
def bronze_records(v):
    return lake.to_bronze(v.change_log, ingested())


@query(
    "bronze_idempotent_append",
    """SELECT topic, "partition", "offset", topic || ':' || "partition" || ':' || "offset" AS stable_id
       FROM v_envelope WHERE "offset" % 3 <> 1""",
    "v_envelope",
)
def bronze_idempotent_append(v):
    bronze = lake.to_bronze(v.change_log, ingested())
    stored = bronze.filter(F.col("offset") % 3 == 1)
    redelivered = bronze.unionByName(bronze.filter(F.col("offset") % 4 == 0))
    fresh = lake.new_records(redelivered, stored)
    return fresh.select(*lake.IDENTITY, lake.stable_id().alias("stable_id"))


@query(
    "decoded_changes",
    """SELECT topic, "partition", "offset", event_kind, operation, decode_error,
       CASE WHEN decode_error IS NULL AND kind <> 0 THEN event_id END AS source_lsn,
       CASE WHEN event_kind = 'movement_delete' THEN uid END AS deleted_movement_id FROM v_decoded""",
    "v_decoded",
)
def decoded_changes(v):
    return decode_changes(v.change_log).select(
        *lake.IDENTITY, "event_kind", "operation", "decode_error", "source_lsn", "deleted_movement_id"
    )


@query(
    "decode_error_counts",
    """SELECT topic, coalesce(decode_error, 'none') AS decode_error, count(*) AS rows FROM v_decoded GROUP BY ALL""",
    "v_decoded",
)
def decode_error_counts(v):
    return (
        decode_changes(v.change_log)
        .groupBy("topic", F.coalesce("decode_error", F.lit("none")).alias("decode_error"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "decoded_movements",
    f"""SELECT uid AS movement_id, uid AS source_event_id, CAST(sku AS INTEGER) AS sku_id, place AS location_code,
       CASE WHEN kind <> 20 THEN CAST(event_id + 1 AS INTEGER) END AS order_id, mtype AS movement_type,
       CAST(qty AS INTEGER) AS quantity, strftime(ts, '{STAMP}') AS occurred_at, strftime(ts, '{STAMP}') AS recorded_at,
       event_id + 1 AS resulting_balance_version, CAST(NULL AS VARCHAR) AS reason, topic, "partition", "offset",
       event_id AS source_lsn FROM v_decoded WHERE event_kind = 'movement'""",
    "v_decoded",
)
def decoded_movements(v):
    return movements_of(decode_changes(v.change_log))


@query(
    "decoded_balances",
    f"""SELECT CAST(sku AS INTEGER) AS sku_id, place AS location_code, CAST(20 + event_id % 80 AS INTEGER) AS on_hand,
       CAST(event_id % 15 AS INTEGER) AS reserved, CAST(20 + event_id % 80 - event_id % 15 AS INTEGER) AS available,
       10 AS safety_stock, 30 AS reorder_point, 150 AS max_stock, event_id + 1 AS version,
       strftime(ts, '{STAMP}') AS updated_at, operation, topic, "partition", "offset", event_id AS source_lsn
       FROM v_decoded WHERE event_kind = 'balance'""",
    "v_decoded",
)
def decoded_balances(v):
    return balances_of(decode_changes(v.change_log))


@query(
    "silver_events",
    f"SELECT * REPLACE (strftime(occurred_at, '{STAMP}') AS occurred_at) FROM v_silver",
    "v_silver",
)
def silver_events(v):
    return lake.to_silver(decode_changes(v.change_log))


@query(
    "silver_event_partitions",
    f"""SELECT strftime(coalesce(occurred_at, {INGESTED}), '%Y-%m-%d') AS date,
       CAST(hour(coalesce(occurred_at, {INGESTED})) AS INTEGER) AS hour, event_type, count(*) AS rows
       FROM v_silver GROUP BY ALL""",
    "v_silver",
)
def silver_event_partitions(v):
    silver = lake.silver_partitions(lake.to_silver(decode_changes(v.change_log)), ingested())
    return silver.groupBy("date", "hour", "event_type").agg(F.count("*").alias("rows"))


@query(
    "silver_required_columns",
    """SELECT event_type, count(*) AS rows, count(occurred_at) AS timed FROM v_silver GROUP BY ALL""",
    "v_silver",
)
def silver_required_columns(v):
    checked = lake.required_not_null(
        lake.to_silver(decode_changes(v.change_log)), lake.SILVER_REQUIRED
    )
    return checked.groupBy("event_type").agg(
        F.count("event_id").alias("rows"), F.count("occurred_at").alias("timed")
    )


@query(
    "dead_letters",
    f"""SELECT topic, "partition", "offset", decode_error AS error, coalesce(value_text, '') AS payload,
       strftime({INGESTED}, '{STAMP}') AS recorded_at
       FROM v_envelope JOIN (SELECT "offset", decode_error FROM v_decoded WHERE decode_error IS NOT NULL) USING ("offset")""",
    "v_envelope v_decoded",
)
def dead_letters(v):
    return lake.dead_letters(decode_changes(v.change_log), ingested())


@query(
    "gold_from_change_log",
    """SELECT sku_id, location_code, strftime(occurred_at, '%Y-%m-%d') AS date, upper(strftime(occurred_at, '%a')) AS weekday,
       CAST(sum(quantity) AS BIGINT) AS sale_units, count(*) AS movement_count
       FROM v_silver WHERE movement_type = 'Sale' GROUP BY ALL""",
    "v_silver",
)
def gold_from_change_log(v):
    return d.daily_demand(lake.to_silver(decode_changes(v.change_log)))


@query(
    "movement_exists",
    """SELECT movement_id FROM v_event_movement WHERE arrival % 50 NOT IN (0, 1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 21, 22, 23, 24)""",
    "v_event_movement",
)
def movement_exists_query(v):
    return movement_exists(movements_of(decode_changes(v.change_log)), v.event_movements.select("movement_id"))
