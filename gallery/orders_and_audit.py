"""Ledger, reservations, orders, outbox, quality and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.model import KEY
from shelfwise.operators import ledger as lg
from shelfwise.operators import orders as o
from shelfwise.operators import outbox as ob
from shelfwise.operators import quality as q
from shelfwise.operators.keyed import keyed_join, running

from .registry import query
from .views import AS_OF, loc, recurring, sql_loc, sql_recurring

T = f"TIMESTAMP '{AS_OF}'"
STAMP = "%Y-%m-%d %H:%M:%S.%f"


def ledger_movements(v):
    """Live movements numbered per key in time order."""
    return running(
        v.live, KEY, ["occurred_at", "movement_id"], F.to_date("occurred_at"),
        sums={"resulting_balance_version": F.lit(1)},
    ).withColumn("resulting_balance_version", F.col("resulting_balance_version") + 1)


LEDGER = """numbered AS (SELECT *, 1 + row_number() OVER (PARTITION BY sku_id, location_code ORDER BY occurred_at, movement_id) AS v FROM v_live),
moves AS (SELECT *, CASE movement_type WHEN 'Sale' THEN -quantity WHEN 'Restock' THEN quantity WHEN 'Return' THEN quantity ELSE 0 END AS d_hand,
    CASE movement_type WHEN 'Reserve' THEN quantity WHEN 'Release' THEN -quantity WHEN 'Sale' THEN -quantity ELSE 0 END AS d_res
  FROM numbered WHERE $kept),
led AS (SELECT m.*, b.max_stock, CAST(b.on_hand + sum(d_hand) OVER k AS BIGINT) AS on_hand, CAST(b.reserved + sum(d_res) OVER k AS BIGINT) AS reserved,
    CAST(1 + row_number() OVER k AS BIGINT) AS version
  FROM moves m JOIN v_balance b ON b.sku_id = m.sku_id AND b.location_code = m.location_code
  WINDOW k AS (PARTITION BY m.sku_id, m.location_code ORDER BY v ROWS UNBOUNDED PRECEDING))"""


def opening(v):
    return v.balances.withColumn("version", F.lit(1).cast("long"))


@query(
    "ledger_balances",
    f"""WITH {LEDGER.replace('$kept', 'true')} SELECT movement_id, sku_id, location_code, movement_type, v AS resulting_balance_version, on_hand AS ledger_on_hand,
       reserved AS ledger_reserved, on_hand - reserved AS ledger_available, version AS ledger_version FROM led""",
    "v_live v_balance",
)
def ledger_balances(v):
    return lg.ledger_balance(opening(v), ledger_movements(v)).select(
        "movement_id", *KEY, "movement_type", "resulting_balance_version", "ledger_on_hand", "ledger_reserved",
        "ledger_available", "ledger_version",
    )


@query(
    "ledger_violations",
    f"""WITH {LEDGER.replace('$kept', 'order_id % 97 <> 0')} SELECT movement_id, violations FROM (SELECT movement_id, concat_ws('|',
         CASE WHEN movement_type = 'Reserve' AND quantity > (on_hand - d_hand) - (reserved - d_res) THEN 'reserve_above_available' END,
         CASE WHEN movement_type IN ('Sale', 'Release') AND quantity > reserved - d_res THEN 'taken_above_reserved' END,
         CASE WHEN on_hand > max_stock THEN 'on_hand_above_max' END, CASE WHEN v <> version THEN 'version_gap' END) AS violations FROM led)
       WHERE violations <> ''""",
    "v_live v_balance",
)
def ledger_violations(v):
    """Movements that are missing from the log leave gaps in the versions: the feature under test."""
    lossy = ledger_movements(v).filter(F.col("order_id") % 97 != 0)
    return lg.ledger_violations(opening(v), lossy).select("movement_id", "violations")


@query(
    "restock_accepted",
    """SELECT movement_id, quantity, CAST(greatest(least(quantity, max_stock - on_hand - m.sku_id % 60), 0) AS INTEGER) AS accepted,
       max_stock - on_hand - m.sku_id % 60 <= 0 AS no_capacity
       FROM v_movement m JOIN v_balance b ON b.sku_id = m.sku_id AND b.location_code = m.location_code WHERE movement_type = 'Restock'""",
    "v_movement v_balance",
)
def restock_accepted(v):
    stock = v.balances.select(*KEY, (F.col("on_hand") + F.col("sku_id") % 60).alias("on_hand"), "max_stock")
    accepted = lg.restock_accepted(F.col("quantity"), F.col("on_hand"), F.col("max_stock"))
    return (
        keyed_join(v.movements.filter(F.col("movement_type") == "Restock"), stock, KEY)
        .select("movement_id", "quantity", accepted.alias("accepted"), (accepted == 0).alias("no_capacity"))
    )


def reserve_requests(v):
    """Requests repeated under new ids: some equal to the first one, some with other quantities."""
    base = v.table("lineitem").select(
        (F.col("l_orderkey") + 1).cast("int").alias("order_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("NCR", "BLR", "BOM", "HYD")]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("location_code"),
        (F.col("l_partkey") % 50).cast("int").alias("sku_id"), F.floor("l_quantity").cast("int").alias("quantity"),
    )
    copies = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return base.withColumn("copy", copies).select(
        F.concat_ws("-", "order_id", "copy").alias("request_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("copy"))).alias("requested_at"),
        "order_id", "location_code", "sku_id",
        F.when((F.col("copy") == 2) & (F.col("sku_id") % 5 == 0), F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"),
    ).filter(~((F.col("request_id").endswith("-1")) & (F.col("order_id") % 3 == 0) & (F.col("sku_id") > 40)))


REQUESTS = f"""req AS (SELECT order_id || '-' || copy AS request_id, copy, order_id, location_code, sku_id,
    CASE WHEN copy = 2 AND sku_id % 5 = 0 THEN quantity + 1 ELSE quantity END AS quantity
  FROM (SELECT CAST(l_orderkey + 1 AS INTEGER) AS order_id, {sql_loc('l_orderkey')} AS location_code,
      CAST(l_partkey % 50 AS INTEGER) AS sku_id, CAST(floor(l_quantity) AS INTEGER) AS quantity FROM lineitem), (VALUES (0), (1), (2)) c(copy)
  WHERE NOT (copy = 1 AND order_id % 3 = 0 AND sku_id > 40)),
merged AS (SELECT request_id, copy, order_id, location_code, sku_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM req GROUP BY ALL)"""


@query("merged_request_lines", f"WITH {REQUESTS} SELECT request_id, sku_id, quantity FROM merged")
def merged_request_lines(v):
    return lg.merge_request_lines(reserve_requests(v), ["request_id"])


@query(
    "redelivery_outcomes",
    f"""WITH {REQUESTS}, sets AS (SELECT request_id, copy, order_id, location_code, string_agg(sku_id || ':' || quantity, ',' ORDER BY sku_id) AS lines
         FROM merged GROUP BY ALL),
       firsts AS (SELECT order_id, location_code, arg_min(lines, copy) AS first_lines, min(copy) AS first_copy FROM sets GROUP BY ALL)
       SELECT request_id, order_id, location_code, CASE WHEN copy = first_copy THEN 'Succeeded' WHEN lines = first_lines THEN 'AlreadyProcessed'
         ELSE 'Conflict' END AS outcome FROM sets JOIN firsts USING (order_id, location_code)""",
)
def redelivery_outcomes(v):
    return lg.redelivery_outcome(reserve_requests(v))


@query(
    "reservation_states",
    f"""SELECT order_id, sku_id, location_code, reserved_quantity, CASE terminal WHEN 'Sale' THEN 'Committed' WHEN 'Release' THEN 'Released' ELSE 'Reserved' END AS status
       FROM (SELECT order_id, sku_id, location_code, CAST(sum(quantity) FILTER (movement_type = 'Reserve') AS BIGINT) AS reserved_quantity,
           arg_min(movement_type, (occurred_at, movement_id)) FILTER (movement_type IN ('Sale', 'Release')) AS terminal
         FROM (SELECT * REPLACE ({sql_recurring('order_id', 3000, 5)} AS order_id, sku_id % 5 AS sku_id) FROM v_movement) GROUP BY ALL) WHERE reserved_quantity IS NOT NULL""",
    "v_movement",
)
def reservation_states(v):
    folded = v.movements.withColumn("order_id", recurring(F.col("order_id"), 3000, 5)).withColumn("sku_id", F.col("sku_id") % 5)
    return lg.reservation_state(folded)


@query(
    "reservations_of_an_order",
    """SELECT order_id, sku_id, location_code, CAST(sum(quantity) AS BIGINT) AS reserved_quantity FROM v_movement
       WHERE movement_type = 'Reserve' AND order_id = 6 GROUP BY ALL""",
    "v_movement",
)
def reservations_of_an_order(v):
    return lg.reservations_of(v.movements, 6)


@query(
    "orders_of_users",
    f"""SELECT buyer_id, buyer_name, order_id, strftime(order_date, '{STAMP}') AS order_date, status, round(coalesce(total, 0), 2) AS total
       FROM v_order JOIN v_buyer USING (buyer_id) LEFT JOIN (SELECT order_id, sum(units * unit_price) AS total FROM v_order_item GROUP BY ALL) USING (order_id)""",
    "v_order v_buyer v_order_item",
)
def orders_of_users(v):
    return o.orders_of_users(v.orders, v.order_items, v.buyers).withColumn("total", F.round("total", 2))


@query(
    "order_totals",
    "SELECT order_id, round(sum(units * unit_price), 2) AS total FROM v_order_item GROUP BY ALL",
    "v_order_item",
)
def order_totals(v):
    return o.order_totals(v.order_items).withColumn("total", F.round("total", 2))


MERGED_LINES = """merged_lines AS (SELECT order_id, product_id, arg_min(product_name, (line_number, line_id)) AS product_name,
   arg_min(unit_price, (line_number, line_id)) AS unit_price, CAST(sum(units) AS BIGINT) AS units, max(discount) AS discount FROM v_order_item GROUP BY ALL)"""


@query(
    "merged_order_lines",
    f"WITH {MERGED_LINES} SELECT order_id, product_id, product_name, unit_price, units, round(discount, 6) AS discount FROM merged_lines",
    "v_order_item",
)
def merged_order_lines(v):
    return o.merge_order_lines(v.order_items)


@query(
    "order_details",
    f"""WITH {MERGED_LINES} SELECT order_id, buyer_id, strftime(order_date, '{STAMP}') AS order_date, status,
       string_agg(product_id || 'x' || units, ',' ORDER BY product_id) AS items, round(sum(units * unit_price), 2) AS total
       FROM v_order JOIN merged_lines USING (order_id) GROUP BY ALL""",
    "v_order v_order_item",
)
def order_details(v):
    detail = o.order_details(v.orders, v.order_items)
    text = F.array_join(
        F.transform("items", lambda i: F.concat(i["product_id"].cast("string"), F.lit("x"), i["units"].cast("string"))), ","
    )
    return detail.withColumn("items", text).withColumn("total", F.round("total", 2))


@query(
    "order_line_errors",
    """SELECT order_id, product_id, line_id, line_number, concat_ws('|', CASE WHEN units - 3 <= 0 THEN 'units_not_positive' END,
         CASE WHEN (units - 3) * unit_price < discount * 900 THEN 'total_below_discount' END) AS errors FROM v_order_item""",
    "v_order_item",
)
def order_line_errors(v):
    odd = v.order_items.withColumn("units", F.col("units") - 3).withColumn("discount", F.col("discount") * 900)
    return o.validate_order_lines(odd).select("order_id", "product_id", "line_id", "line_number", "errors")


@query(
    "order_errors",
    """SELECT CAST(o_orderkey + 1 AS INTEGER) AS order_id, concat_ws('|',
         CASE WHEN 10 + o_orderkey % 12 NOT BETWEEN 12 AND 19 THEN 'card_number_length' END, CASE WHEN 2 + o_orderkey % 3 <> 3 THEN 'card_code_length' END,
         CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'card_expired' END, CASE WHEN o_custkey % 7 = 0 THEN 'location_unknown' END,
         CASE WHEN o_orderkey % 8 = 0 THEN 'no_items' END) AS errors FROM orders""",
)
def order_errors(v):
    n = F.col("o_orderkey")
    given = v.table("orders").select(
        (n + 1).cast("int").alias("order_id"), F.repeat(F.lit("4"), (10 + n % 12).cast("int")).alias("card_number"),
        F.repeat(F.lit("1"), (2 + n % 3).cast("int")).alias("card_security_code"), F.col("o_orderdate").alias("card_expiration"),
        F.when(F.col("o_custkey") % 7 == 0, "MAA").otherwise(F.concat(F.lit(" "), F.lower(loc(n)))).alias("location_code"),
        (n % 8).alias("item_count"),
    )
    return o.validate_orders(given, "1996-01-01 00:00:00").select("order_id", "errors")


STEPS = ["await_validation", "confirm_stock", "pay", "ship", "cancel", "reject_stock"]


def lifecycle_events(v):
    """Orders drive through their steps mostly in order, with odd steps strewn in."""
    n = F.col("event_id")
    place = F.floor(n / 800) % 4
    step = F.when(n % 11 == 3, 4).when(n % 13 == 5, 5).otherwise(place).cast("int")
    return v.table("events").select(
        recurring(n, 800, 12).alias("order_id"), F.element_at(F.array(*[F.lit(s) for s in STEPS]), step + 1).alias("step"), n.alias("seq")
    )


@query(
    "order_status_replay",
    f"""WITH RECURSIVE ev AS (SELECT {sql_recurring('event_id', 800, 12)} AS order_id, CASE WHEN event_id % 11 = 3 THEN 4 WHEN event_id % 13 = 5 THEN 5
           ELSE (event_id // 800) % 4 END AS step, row_number() OVER (PARTITION BY {sql_recurring('event_id', 800, 12)} ORDER BY event_id) AS i FROM events),
       run AS (SELECT DISTINCT order_id, 0::BIGINT AS i, 0 AS status, 0::BIGINT AS illegal_moves FROM ev
         UNION ALL
         SELECT r.order_id, e.i, CASE WHEN e.step = 0 AND r.status = 0 THEN 1 WHEN e.step = 1 AND r.status = 1 THEN 2 WHEN e.step = 2 AND r.status = 2 THEN 3
             WHEN e.step = 3 AND r.status = 3 THEN 4 WHEN e.step = 4 AND r.status NOT IN (3, 4) THEN 5 WHEN e.step = 5 AND r.status = 1 THEN 5 ELSE r.status END,
           r.illegal_moves + CASE WHEN e.step = 3 AND r.status <> 3 THEN 1 WHEN e.step = 4 AND r.status IN (3, 4) THEN 1 ELSE 0 END
         FROM run r JOIN ev e ON e.order_id = r.order_id AND e.i = r.i + 1)
       SELECT order_id, (['Submitted', 'AwaitingValidation', 'StockConfirmed', 'Paid', 'Shipped', 'Cancelled'])[arg_max(status, i) + 1] AS status,
       max(illegal_moves) AS illegal_moves FROM run GROUP BY order_id""",
)
def order_status_replay(v):
    return o.chain_lifecycle(o.lifecycle_maps(lifecycle_events(v), chunk=F.floor(F.col("seq") / 2048)))


@query(
    "rejected_items_text",
    """SELECT order_id, 'The product items don''t have stock: (' || string_agg(product_name, ', ' ORDER BY line_number, line_id, product_name) || ').' AS description
       FROM v_order_item WHERE product_id % 4 = order_id % 4 GROUP BY ALL""",
    "v_order_item",
)
def rejected_items_text(v):
    rejected = v.order_items.filter(F.col("product_id") % 4 == F.col("order_id") % 4).select("order_id", "product_id")
    return o.rejected_items_text(v.order_items, rejected)


@query(
    "grace_period_due",
    f"""SELECT order_id, buyer_id, strftime(order_date, '{STAMP}') AS order_date, status FROM v_order
       WHERE status = 'Submitted' AND TIMESTAMP '1998-09-02' - order_date >= INTERVAL 525600 MINUTE""",
    "v_order",
)
def grace_period_due(v):
    return o.grace_period_due(v.orders, 525600, "1998-09-02 00:00:00")


@query(
    "latest_baskets",
    f"""SELECT buyer_id, seq, lines, strftime(written_at, '{STAMP}') AS written_at FROM (SELECT user_id AS buyer_id, event_id AS seq, ts AS written_at,
         1 + event_id % 6 AS lines, event_type = 'purchase' AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
       WHERE i = 1 AND NOT deleted""",
)
def latest_baskets(v):
    writes = v.table("events").select(
        F.col("user_id").alias("buyer_id"), F.col("event_id").alias("seq"), F.col("ts").alias("written_at"),
        (1 + F.col("event_id") % 6).alias("lines"), (F.col("event_type") == "purchase").alias("deleted"),
    )
    return o.latest_basket(writes).drop("deleted")


@query(
    "payment_methods",
    """WITH ver AS (SELECT 'v-' || event_id AS verification_id, CAST(user_id AS INTEGER) AS buyer_id, CAST(event_id % 3 AS INTEGER) AS card_type_id,
         '40000000000' || (1000 + event_id % 4) AS card_number, '20' || (25 + event_id % 2) || '-12' AS expiration, event_id AS seq FROM events),
       f AS (SELECT *, first_value(verification_id) OVER (PARTITION BY buyer_id, card_type_id, card_number, expiration ORDER BY seq) AS method_id FROM ver)
       SELECT verification_id, buyer_id, card_type_id, '****' || right(card_number, 4) AS card, expiration, method_id,
       CASE WHEN method_id = verification_id THEN 'ADDED' ELSE 'REUSED' END AS outcome FROM f""",
)
def payment_methods(v):
    n = F.col("event_id")
    ver = v.table("events").select(
        F.concat(F.lit("v-"), n).alias("verification_id"), F.col("user_id").cast("int").alias("buyer_id"),
        (n % 3).cast("int").alias("card_type_id"), F.concat(F.lit("40000000000"), 1000 + n % 4).alias("card_number"),
        F.concat(F.lit("20"), 25 + n % 2, F.lit("-12")).alias("expiration"), n.alias("seq"),
    )
    return o.payment_method_upsert(ver)


@query(
    "idempotent_requests",
    f"""SELECT request_id, seq, duplicates FROM (SELECT {sql_recurring('event_id', 4000, 3)} AS request_id, event_id AS seq,
         count(*) OVER (PARTITION BY {sql_recurring('event_id', 4000, 3)}) - 1 AS duplicates, row_number() OVER (PARTITION BY {sql_recurring('event_id', 4000, 3)} ORDER BY ts, event_id) AS i FROM events) WHERE i = 1""",
)
def idempotent_requests(v):
    commands = v.table("events").select(
        recurring(F.col("event_id"), 4000, 3).alias("request_id"), F.col("ts").alias("received_at"), F.col("event_id").alias("seq")
    )
    return o.idempotent_requests(commands).select("request_id", "seq", "duplicates")


OUTBOX_STATES = ["NotPublished", "InProgress", "Published", "PublishedFailed"]
LOG_SQL = """log AS (SELECT event_id, ts AS creation_time, 'Shop.Events.' || event_type AS event_type_name, 'tx-' || event_id % 100 AS transaction_id,
   (['NotPublished', 'InProgress', 'Published', 'PublishedFailed'])[CAST(event_id % 4 AS INTEGER) + 1] AS state FROM events)"""


def outbox_log(v):
    n = F.col("event_id")
    return v.table("events").select(
        "event_id", F.col("ts").alias("creation_time"), F.concat(F.lit("Shop.Events."), "event_type").alias("event_type_name"),
        F.concat(F.lit("tx-"), n % 100).alias("transaction_id"),
        F.element_at(F.array(*[F.lit(s) for s in OUTBOX_STATES]), (n % 4 + 1).cast("int")).alias("state"),
    )


@query(
    "outbox_pending",
    f"""WITH {LOG_SQL} SELECT event_id, strftime(creation_time, '{STAMP}') AS creation_time, event_type_name, transaction_id, state,
       split_part(event_type_name, '.', 3) AS short_type FROM log WHERE state = 'NotPublished'""",
)
def outbox_pending(v):
    return ob.outbox_pending(outbox_log(v))


@query(
    "outbox_state_counts",
    f"WITH {LOG_SQL} SELECT state, count(*) AS rows FROM log GROUP BY ALL",
)
def outbox_state_counts(v):
    from shelfwise.operators.stats import status_counts

    return status_counts(outbox_log(v), ["state"])


@query(
    "outbox_states",
    f"""SELECT {sql_recurring('event_id', 2500, 4)} AS event_id, arg_max((['NotPublished', 'InProgress', 'Published', 'PublishedFailed'])[CAST(event_id % 4 AS INTEGER) + 1], (ts, event_id)) AS state,
       count(*) FILTER (event_id % 4 = 1) AS times_sent FROM events GROUP BY 1""",
)
def outbox_states(v):
    changes = outbox_log(v).select(
        recurring(F.col("event_id"), 2500, 4).alias("event_id"), "state", F.col("creation_time").alias("changed_at"), F.col("event_id").alias("seq")
    )
    return ob.outbox_state(changes)


@query(
    "inbox_first_deliveries",
    f"SELECT {sql_recurring('event_id', 5000, 2)} AS event_id, min(event_id) AS seq FROM events GROUP BY 1",
)
def inbox_first_deliveries(v):
    deliveries = v.table("events").select(recurring(F.col("event_id"), 5000, 2).alias("event_id"), F.col("event_id").alias("seq"))
    return ob.inbox_dedup(deliveries, ["seq"])


ODD_BALANCE = """odd AS (SELECT sku_id, location_code, on_hand - 55 AS on_hand, reserved - 1 AS reserved, available - 55 + CASE WHEN sku_id % 50 = 0 THEN 3 ELSE 1 END AS available,
   safety_stock - 11 AS safety_stock, reorder_point - CASE WHEN sku_id % 20 = 0 THEN 40 ELSE 0 END AS reorder_point, max_stock - sku_id % 130 AS max_stock FROM v_balance),
flagged AS (SELECT sku_id, location_code, [CASE WHEN reserved < 0 THEN 'reserved_negative' END, CASE WHEN reserved > on_hand THEN 'reserved_above_on_hand' END,
   CASE WHEN on_hand > max_stock THEN 'on_hand_above_max' END, CASE WHEN safety_stock < 0 THEN 'safety_negative' END,
   CASE WHEN safety_stock > reorder_point THEN 'safety_above_reorder' END, CASE WHEN reorder_point > max_stock THEN 'reorder_above_max' END,
   CASE WHEN available <> on_hand - reserved THEN 'available_mismatch' END] AS f FROM odd)"""


def odd_balances(v):
    sku = F.col("sku_id")
    return v.balances.select(
        *KEY, (F.col("on_hand") - 55).alias("on_hand"), (F.col("reserved") - 1).alias("reserved"),
        (F.col("available") - 55 + F.when(sku % 50 == 0, 3).otherwise(1)).alias("available"),
        (F.col("safety_stock") - 11).alias("safety_stock"),
        (F.col("reorder_point") - F.when(sku % 20 == 0, 40).otherwise(0)).alias("reorder_point"),
        (F.col("max_stock") - sku % 130).alias("max_stock"),
    )


@query(
    "balance_violations",
    f"WITH {ODD_BALANCE} SELECT sku_id, location_code, array_to_string(f, '|') AS violations FROM flagged WHERE array_to_string(f, '|') <> ''",
    "v_balance",
)
def balance_violations(v):
    return q.balance_violations(odd_balances(v)).select(*KEY, "violations")


@query(
    "balance_violation_counts",
    f"WITH {ODD_BALANCE} SELECT x AS violation, count(*) AS rows FROM (SELECT unnest(f) AS x FROM flagged) WHERE x IS NOT NULL GROUP BY ALL",
    "v_balance",
)
def balance_violation_counts(v):
    return q.count_violations(q.balance_violations(odd_balances(v)))


@query(
    "movement_rule_violations",
    """SELECT movement_id, concat_ws('|', CASE WHEN sku_id - 3 <= 0 THEN 'sku_not_positive' END, CASE WHEN order_id % 50 - 1 <= 0 THEN 'order_not_positive' END,
         CASE WHEN quantity % 7 = 0 THEN 'type_unknown' END, CASE WHEN quantity % 7 = 1 AND quantity - 8 = 0 THEN 'adjustment_zero' END,
         CASE WHEN quantity % 7 <> 1 AND quantity - 8 <= 0 THEN 'quantity_not_positive' END,
         CASE WHEN order_id % 40 = 0 THEN 'location_blank' END, CASE WHEN order_id % 40 = 1 THEN 'location_too_long' END,
         CASE WHEN order_id % 45 = 2 THEN 'reason_too_long' END) AS violations FROM v_movement""",
    "v_movement",
)
def movement_rule_violations(v):
    n, units = F.col("order_id"), F.col("quantity")
    odd = v.movements.select(
        "movement_id", "source_event_id", (F.col("sku_id") - 3).alias("sku_id"), (n % 50 - 1).alias("order_id"),
        F.when(units % 7 == 0, "Gift").when(units % 7 == 1, "Adjustment").otherwise(F.col("movement_type")).alias("movement_type"),
        (units - 8).alias("quantity"), "resulting_balance_version",
        F.when(n % 40 == 0, "  ").when(n % 40 == 1, "A-VERY-LONG-LOCATION").otherwise(F.col("location_code")).alias("location_code"),
        F.when(n % 45 == 2, F.repeat(F.lit("r"), F.lit(201))).alias("reason"),
    )
    return q.movement_violations(odd).select("movement_id", "violations")


@query(
    "source_sink_parity",
    """SELECT (SELECT count(*) FROM v_event_movement) AS source_rows, (SELECT count(*) FROM v_event_movement WHERE arrival % 10 <> 4) AS sink_rows,
       (SELECT count(*) FROM v_event_movement) AS source_ids, (SELECT count(*) FROM v_event_movement WHERE arrival % 10 <> 4) AS sink_ids,
       (SELECT count(*) FROM v_event_movement WHERE arrival % 10 = 4) AS missing_in_sink, 0::BIGINT AS only_in_sink,
       (SELECT CAST(sum(quantity) AS BIGINT) FROM v_event_movement WHERE arrival % 10 <> 4 AND movement_type = 'Reserve') AS sink_reserve_units,
       (SELECT CAST(sum(quantity) AS BIGINT) FROM v_event_movement WHERE arrival % 10 <> 4 AND movement_type = 'Sale') AS sink_sale_units""",
    "v_event_movement",
)
def source_sink_parity(v):
    return q.source_sink_parity(v.event_movements, v.event_movements.filter(F.col("arrival") % 10 != 4))


@query(
    "audit_chain_breaks",
    """SELECT 'simulation_without_decision' AS rule, 's-' || event_id AS row_id FROM events WHERE event_id % 10 = 3
       UNION ALL SELECT 'proposal_without_decision', 'p-' || event_id FROM events WHERE event_id % 10 = 3
       UNION ALL SELECT 'policy_without_proposal', 'g-' || event_id FROM events WHERE event_id % 20 = 5
       UNION ALL SELECT 'attempt_without_proposal', 'a-' || event_id FROM events WHERE event_id % 20 = 5
       UNION ALL SELECT 'negative_recommendation', 'd-' || event_id FROM events WHERE event_id % 10 <> 3 AND event_id % 30 = 7
       UNION ALL SELECT 'negative_selection', 's-' || event_id FROM events WHERE event_id % 40 = 1
       UNION ALL SELECT 'negative_proposal', 'p-' || event_id FROM events WHERE event_id % 20 <> 5 AND event_id % 60 = 2""",
)
def audit_chain_breaks(v):
    n = F.col("event_id")
    e = v.table("events")
    named = lambda prefix, column: F.concat(F.lit(prefix), n).alias(column)
    decisions = e.filter(n % 10 != 3).select(
        named("d-", "decision_id"), F.when(n % 30 == 7, -1).otherwise(5).alias("recommended_quantity")
    )
    simulations = e.select(
        named("s-", "simulation_id"), named("d-", "decision_id"), F.when(n % 40 == 1, -1).otherwise(5).alias("selected_quantity")
    )
    proposals = e.filter(n % 20 != 5).select(
        named("p-", "proposal_id"), named("d-", "decision_id"), F.when(n % 60 == 2, -1).otherwise(5).alias("quantity")
    )
    policies = e.select(named("g-", "policy_decision_id"), named("p-", "proposal_id"))
    attempts = e.select(named("a-", "attempt_id"), named("p-", "proposal_id"))
    return q.audit_chain_breaks(decisions, simulations, proposals, policies, attempts)


@query(
    "audit_insert_if_absent",
    f"""SELECT 'd-' || {sql_recurring('event_id', 6000, 2)} AS decision_id, CASE WHEN {sql_recurring('event_id', 6000, 2)} % 2 = 0 THEN -1 ELSE min(event_id) END AS payload FROM events GROUP BY {sql_recurring('event_id', 6000, 2)}""",
)
def audit_insert_if_absent(v):
    incoming = v.table("events").select(
        F.concat(F.lit("d-"), recurring(F.col("event_id"), 6000, 2)).alias("decision_id"), F.col("event_id").alias("payload")
    )
    stored = incoming.select("decision_id").distinct().filter(
        F.substring_index("decision_id", "-", -1).cast("long") % 2 == 0
    ).select("decision_id", F.lit(-1).cast("long").alias("payload"))
    return q.insert_if_absent(stored, incoming, "decision_id", ["payload"])


@query(
    "audit_proposal_upsert",
    f"""SELECT 'p-' || {sql_recurring('event_id', 4000, 3)} AS proposal_id, min(event_id) AS quantity, 'n' || max(event_id) AS reasoning,
       CASE WHEN max(event_id) % 2 = 0 THEN 'APPROVED' ELSE 'FAILED' END AS status, max(event_id) AS updated_at FROM events GROUP BY {sql_recurring('event_id', 4000, 3)}""",
)
def audit_proposal_upsert(v):
    n = F.col("event_id")
    rows = v.table("events").select(
        F.concat(F.lit("p-"), recurring(n, 4000, 3)).alias("proposal_id"), n.alias("quantity"), F.concat(F.lit("n"), n).alias("reasoning"),
        F.when(n % 2 == 0, "APPROVED").otherwise("FAILED").alias("status"), n.alias("updated_at"),
    )
    early = F.col("updated_at") % 12_000 < 3000  # the first rows of three quarters of each stretch's proposals
    return q.upsert_proposals(rows.filter(early), rows.filter(~early))
