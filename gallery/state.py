"""Deduplication, current state, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.model import KEY
from shelfwise.operators import state as s
from shelfwise.operators.demand import rolling_units, with_velocities
from shelfwise.operators.lookups import evaluated_movements

from .registry import query
from .views import AS_OF, loc, sql_loc

STAMP = "%Y-%m-%d %H:%M:%S.%f"


@query(
    "deduplicated_movements",
    f"""SELECT movement_id, sku_id, location_code, order_id, movement_type, quantity,
       strftime(occurred_at, '{STAMP}') AS occurred_at, arrival FROM v_event_movement""",
    "v_event_movement",
)
def deduplicated_movements(v):
    again = v.event_movements.filter(F.col("arrival") % 3 == 0).withColumn(
        "arrival", F.col("arrival") + 1_000_000_000
    ).withColumn("quantity", F.col("quantity") + 100)
    return s.dedup_movements(v.event_movements.unionByName(again), ["arrival"])


@query(
    "business_key_dedup",
    f"""SELECT source_event_id, sku_id, location_code, movement_type, movement_id, quantity FROM (
       SELECT *, row_number() OVER (PARTITION BY source_event_id, sku_id, location_code, movement_type
         ORDER BY occurred_at, movement_id) AS i
       FROM (SELECT * REPLACE ('evt-' || order_id % 100 AS source_event_id, sku_id % 20 AS sku_id) FROM v_movement)) WHERE i = 1""",
    "v_movement",
)
def business_key_dedup(v):
    source = v.movements.withColumn(
        "source_event_id", F.concat(F.lit("evt-"), F.col("order_id") % 100)
    ).withColumn("sku_id", F.col("sku_id") % 20)
    return s.dedup_business_key(source, ["occurred_at", "movement_id"]).select(
        "source_event_id", *KEY, "movement_type", "movement_id", "quantity"
    )


SEGMENTED = """seg AS (SELECT *, sum(CASE WHEN operation = 'SNAPSHOT' THEN 1 ELSE 0 END)
    OVER (PARTITION BY sku_id, location_code ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS segment FROM v_balance_change)"""


@query(
    "current_balance",
    f"""WITH {SEGMENTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sku_id, location_code
         ORDER BY segment DESC, version DESC, "offset" ASC) AS i FROM seg)
       SELECT sku_id, location_code, on_hand, reserved, available, version, operation, "offset" FROM ranked WHERE i = 1""",
    "v_balance_change",
)
def current_balance(v):
    return s.current_balance(v.balance_changes).select(
        *KEY, "on_hand", "reserved", "available", "version", "operation", "offset"
    )


FLAGGED = f"""{SEGMENTED}, best AS (SELECT *, max(version) OVER (PARTITION BY sku_id, location_code, segment ORDER BY "offset"
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM seg),
       flagged AS (SELECT *, CASE WHEN operation = 'SNAPSHOT' THEN 'RESET' WHEN best IS NULL OR version > best THEN 'ACCEPTED'
         ELSE 'STALE' END AS outcome FROM best)"""


@query(
    "stale_balance_flags",
    f"""WITH {FLAGGED} SELECT sku_id, location_code, "offset", version, operation, outcome FROM flagged""",
    "v_balance_change",
)
def stale_balance_flags(v):
    return s.flag_stale_balances(v.balance_changes).select(
        *KEY, "offset", "version", "operation", "outcome"
    )


@query(
    "stale_balance_counts",
    f"WITH {FLAGGED} SELECT outcome, count(*) AS rows FROM flagged GROUP BY ALL",
    "v_balance_change",
)
def stale_balance_counts(v):
    return s.flag_stale_balances(v.balance_changes).groupBy("outcome").agg(F.count("*").alias("rows"))


@query(
    "highest_version_balance",
    """SELECT sku_id, location_code, on_hand, version, "offset" FROM (SELECT *, row_number() OVER (
         PARTITION BY sku_id, location_code ORDER BY version DESC, "offset" DESC) AS i FROM v_balance_change) WHERE i = 1""",
    "v_balance_change",
)
def highest_version_balance(v):
    return s.latest_by(v.balance_changes, KEY, "version", "offset").select(*KEY, "on_hand", "version", "offset")


@query(
    "newest_features_per_minute",
    f"""SELECT sku_id, location_code, strftime(minute, '{STAMP}') AS minute, strftime(computed_at, '{STAMP}') AS computed_at,
         sale_velocity_1h FROM (
         SELECT *, row_number() OVER (PARTITION BY sku_id, location_code, minute ORDER BY computed_at DESC) AS i FROM (
           SELECT DISTINCT 1 AS sku_id, location_code, occurred_at AS computed_at, date_trunc('minute', occurred_at) AS minute,
             24.0::DOUBLE * coalesce(sum(CASE WHEN movement_type = 'Sale' THEN quantity END) OVER (PARTITION BY location_code
               ORDER BY occurred_at RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW), 0) AS sale_velocity_1h
           FROM v_event_movement WHERE movement_type IN ('Sale', 'Reserve'))) WHERE i = 1""",
    "v_event_movement",
)
def newest_features_per_minute(v):
    rolled = rolling_units(
        evaluated_movements(v.area_movements),
        {"sale_units_5m": ("Sale", 5), "sale_units_15m": ("Sale", 15), "sale_units_1h": ("Sale", 60)},
    )
    features = with_velocities(rolled).withColumnRenamed("occurred_at", "computed_at")
    return s.latest_per_minute(features.withColumn("seq", F.lit(0)), "seq").select(
        *KEY, "minute", "computed_at", "sale_velocity_1h"
    )


def stock_events(v):
    """Order events whose own id is sometimes missing, some of them invalid."""
    n = F.col("event_id")
    balance = F.struct(
        (20 + n % 80).cast("int").alias("on_hand"), (n % 15).cast("int").alias("reserved"),
        (n % 2 == 0).alias("authoritative"),
    )
    return v.table("events").select(
        F.when(n % 3 == 0, F.concat(F.lit("e-"), (n - n % 6).cast("string"))).alias("event_id"),
        (n % 200 - 1).cast("int").alias("order_id"),
        (F.col("user_id") % 25).cast("int").alias("sku_id"),
        F.when(n % 41 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower(loc(n)))).alias("location_code"),
        (F.floor("value") % 10).cast("int").alias("quantity_depleted"),
        F.col("ts").alias("occurred_at"),
        F.when(n % 7 != 0, balance).alias("balance"),
        n.alias("arrival"),
    )


STOCK_EVENT_SQL = f"""stock_event AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'e-' || (event_id - event_id % 6) END AS event_id,
    CAST(event_id % 200 - 1 AS INTEGER) AS order_id, CAST(user_id % 25 AS INTEGER) AS sku_id,
    CASE WHEN event_id % 41 = 0 THEN ' ' ELSE ' ' || lower({sql_loc('event_id')}) END AS location_code,
    CAST(CAST(floor(value) AS BIGINT) % 10 AS INTEGER) AS quantity_depleted, event_id % 7 <> 0 AS has_balance,
    event_id % 2 = 0 AS authoritative, event_id AS arrival FROM events)"""


@query(
    "stock_event_dedup",
    f"""WITH {STOCK_EVENT_SQL} SELECT event_key, arrival FROM (
       SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY arrival) AS i FROM (
         SELECT *, coalesce(event_id, 'order-stock-confirmed:' || order_id || ':' || sku_id || ':' || upper(trim(location_code))
           || ':' || quantity_depleted) AS event_key FROM stock_event)) WHERE i = 1""",
)
def stock_event_dedup(v):
    return s.dedup_events(stock_events(v), ["arrival"]).select("event_key", "arrival")


@query(
    "stock_event_validation",
    f"""WITH {STOCK_EVENT_SQL} SELECT arrival, CASE WHEN reason IS NOT NULL THEN 'POISON' WHEN NOT has_balance THEN 'SKIPPED'
         ELSE 'ACCEPTED' END AS outcome, reason,
         CASE WHEN reason IS NULL AND has_balance THEN CASE WHEN authoritative THEN 'FINAL' ELSE 'UNRECONCILED' END END AS data_status
       FROM (SELECT *, CASE WHEN order_id <= 0 THEN 'order_id must be positive' WHEN sku_id <= 0 THEN 'sku_id must be positive'
         WHEN trim(location_code) = '' THEN 'location_code is required'
         WHEN quantity_depleted <= 0 THEN 'quantity_depleted must be positive' END AS reason FROM stock_event)""",
)
def stock_event_validation(v):
    return s.validate_stock_events(stock_events(v)).select("arrival", "outcome", "reason", "data_status")


def replenishments(v):
    """Operations that were opened once and partly closed later."""
    n = F.col("event_id")
    base = v.table("events").select(
        F.concat(F.lit("op-"), (n - n % 2).cast("string")).alias("operation_id"),
        ((n - n % 2) % 2000 + 1).cast("int").alias("sku_id"),
        loc(n - n % 2).alias("location_code"),
        (5 + (n - n % 2) % 40).cast("int").alias("quantity"),
        F.when((n % 2 == 1) & (n % 5 == 0), "COMPLETED").otherwise("OPEN").alias("status"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (n - n % 2).cast("int"))).alias("created_at"),
        (F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))).alias("updated_at"),
    )
    return base


REPLENISHMENT_SQL = f"""replenishment AS (
  SELECT 'op-' || (event_id - event_id % 2) AS operation_id, CAST((event_id - event_id % 2) % 2000 + 1 AS INTEGER) AS sku_id,
    {sql_loc('(event_id - event_id % 2)')} AS location_code, CAST(5 + (event_id - event_id % 2) % 40 AS INTEGER) AS quantity,
    CASE WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 'COMPLETED' ELSE 'OPEN' END AS status,
    TIMESTAMP '{AS_OF}' - to_minutes(event_id - event_id % 2) AS created_at,
    TIMESTAMP '{AS_OF}' + to_minutes(event_id) AS updated_at FROM events),
open_replenishment AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY updated_at DESC) AS i
  FROM replenishment) WHERE i = 1 AND status = 'OPEN'),
incoming_supply AS (SELECT sku_id, location_code, arg_min(quantity, (created_at, operation_id)) AS incoming FROM open_replenishment GROUP BY ALL)"""


@query("open_replenishments", f"WITH {REPLENISHMENT_SQL} SELECT operation_id, sku_id, location_code, quantity, status FROM open_replenishment")
def open_replenishments(v):
    return s.open_replenishments(replenishments(v)).select("operation_id", *KEY, "quantity", "status")


@query("incoming_supply", f"WITH {REPLENISHMENT_SQL} SELECT sku_id, location_code, incoming FROM incoming_supply")
def incoming_supply(v):
    return s.incoming_supply(replenishments(v))


@query(
    "recovery_state",
    f"""WITH {REPLENISHMENT_SQL},
       b AS (SELECT sku_id, location_code, on_hand, version FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, location_code
         ORDER BY version DESC, "offset" DESC) AS i FROM v_balance_change) WHERE i = 1),
       m AS (SELECT sku_id, location_code, 'model-' || arrival AS model FROM (SELECT *, row_number() OVER (
         PARTITION BY sku_id, location_code ORDER BY occurred_at DESC, arrival DESC) AS i FROM v_event_movement) WHERE i = 1)
       SELECT sku_id, location_code, on_hand, version, model, incoming FROM b
       FULL JOIN m USING (sku_id, location_code) FULL JOIN incoming_supply USING (sku_id, location_code)""",
    "v_balance_change v_event_movement",
)
def recovery_state(v):
    models = v.event_movements.select(
        *KEY, F.col("occurred_at").alias("updated_at"), F.concat(F.lit("model-"), F.col("arrival")).alias("model"),
        F.col("arrival").alias("seq"),
    )
    balances = v.balance_changes.withColumn("seq", F.col("offset"))
    return s.recovery_state(balances, models, replenishments(v)).select(
        *KEY, "on_hand", "version", "model", "incoming"
    )
