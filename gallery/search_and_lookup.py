"""Calendar and signal lookups, enrichment joins, catalog search."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.model import KEY
from shelfwise.operators import catalog as c
from shelfwise.operators import lookups as l
from shelfwise.operators.state import current_balance
from shelfwise.operators.vector_search import batch_top_k
from shelfwise.session import scratch_path
from shelfwise.sources import lake

from .registry import query
from .views import AS_OF, recurring, sql_recurring

T = f"TIMESTAMP '{AS_OF}'"
STAMP = "%Y-%m-%d %H:%M:%S.%f"


def keys(v):
    return v.balances.select(*KEY)


@query(
    "event_calendar",
    f"""SELECT b.sku_id, b.location_code, c.event_id, c.event_name, strftime(c.start_date, '%Y-%m-%d') AS start_date,
       strftime(c.end_date, '%Y-%m-%d') AS end_date, c.expected_demand_impact
       FROM v_balance b JOIN v_calendar c ON c.location_code = b.location_code OR c.location_code = 'ALL'
       WHERE c.start_date <= CAST({T} AS DATE) + 60 AND c.end_date >= CAST({T} AS DATE)""",
    "v_balance v_calendar",
)
def event_calendar(v):
    return l.event_calendar(keys(v), v.calendar, 60, AS_OF)


@query(
    "event_calendar_by_location",
    f"""SELECT b.location_code, c.event_id, c.event_name, strftime(c.start_date, '%Y-%m-%d') AS start_date,
       strftime(c.end_date, '%Y-%m-%d') AS end_date, c.expected_demand_impact
       FROM (SELECT DISTINCT location_code FROM v_balance) b JOIN v_calendar c ON c.location_code = b.location_code OR c.location_code = 'ALL'
       WHERE c.start_date <= CAST({T} AS DATE) + 60 AND c.end_date >= CAST({T} AS DATE)""",
    "v_balance v_calendar",
)
def event_calendar_by_location(v):
    return l.calendar_of_locations(keys(v), v.calendar, 60, AS_OF)


SIGNAL_SQL = f"""SELECT b.sku_id, b.location_code, s.signal_id, s.signal_type, s.sku_id AS signal_sku,
   strftime(s.reported_at, '{STAMP}') AS reported_at, strftime(s.resolved_at, '{STAMP}') AS resolved_at
   FROM {{keys}} b JOIN v_signal s ON (s.location_code = b.location_code OR s.location_code = 'ALL') {{sku}}
   WHERE s.resolved_at IS NULL OR s.resolved_at >= {T} - INTERVAL 7 DAY"""


@query(
    "supplier_signals",
    SIGNAL_SQL.format(keys="v_balance", sku="AND (s.sku_id = b.sku_id OR s.sku_id IS NULL)"),
    "v_balance v_signal",
)
def supplier_signals(v):
    return l.supplier_signals(keys(v), v.signals, AS_OF)


@query(
    "supplier_signals_by_location",
    SIGNAL_SQL.format(keys="(SELECT DISTINCT 0 AS sku_id, location_code FROM v_balance)", sku=""),
    "v_balance v_signal",
)
def supplier_signals_by_location(v):
    places = keys(v).select(F.lit(0).alias("sku_id"), "location_code").distinct()
    return l.supplier_signals(places, v.signals, AS_OF, by_sku=False)


@query(
    "movements_with_current_balance",
    """SELECT movement_id, m.sku_id, m.location_code, movement_type, quantity, on_hand, reserved, available, version
       FROM v_movement m JOIN v_balance b ON b.sku_id = m.sku_id AND b.location_code = m.location_code
       WHERE movement_type IN ('Sale', 'Reserve')""",
    "v_movement v_balance",
)
def movements_with_current_balance(v):
    return l.with_current_balance(v.movements, v.balances).select(
        "movement_id", *KEY, "movement_type", "quantity", "on_hand", "reserved", "available", "version"
    )


@query(
    "balance_as_of_movement",
    """WITH state AS (SELECT sku_id, location_code, arrival + 1 AS version, 20 + arrival % 80 AS on_hand FROM v_event_movement WHERE arrival % 5 = 2)
       SELECT movement_id, m.sku_id, m.location_code, m.arrival, CAST(s.on_hand AS INTEGER) AS balance_on_hand, s.version AS balance_version
       FROM v_event_movement m ASOF LEFT JOIN state s ON s.sku_id = m.sku_id AND s.location_code = m.location_code
         AND m.arrival >= s.version WHERE m.movement_type IN ('Sale', 'Reserve')""",
    "v_event_movement",
)
def balance_as_of_movement(v):
    facts = v.event_movements.withColumn("resulting_balance_version", F.col("arrival"))
    states = v.event_movements.filter(F.col("arrival") % 5 == 2).select(
        *KEY, (20 + F.col("arrival") % 80).cast("int").alias("on_hand"), F.lit(0).alias("reserved"),
        F.lit(0).alias("available"), (F.col("arrival") + 1).alias("version"),
    )
    return l.balance_as_of_movement(facts, states, F.floor(F.col("_version") / 512)).select(
        "movement_id", *KEY, "arrival", "balance_on_hand", "balance_version"
    )


def basket(v):
    """Basket lines per buyer out of order items; some products are not in the catalog."""
    n = F.col("l_partkey")
    return v.table("lineitem").select(
        (recurring(F.col("l_orderkey"), 500, 12) + 1).cast("int").alias("buyer_id"),
        F.when(n % 97 == 0, n + 10_000_000).otherwise(n + 1).cast("int").alias("product_id"),
        F.floor("l_quantity").cast("int").alias("quantity"),
    )


BASKET_SQL = f"""basket AS (SELECT CAST({sql_recurring('l_orderkey', 500, 12)} + 1 AS INTEGER) AS buyer_id,
   CAST(CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 10000000 ELSE l_partkey + 1 END AS INTEGER) AS product_id,
   CAST(floor(l_quantity) AS INTEGER) AS quantity FROM lineitem)"""


@query(
    "basket_lines",
    f"WITH {BASKET_SQL} SELECT buyer_id, product_id, quantity, name, price FROM basket JOIN v_catalog ON id = product_id",
    "v_catalog",
)
def basket_lines(v):
    return l.basket_lines(basket(v), v.catalog)


@query(
    "unknown_basket_products",
    f"WITH {BASKET_SQL} SELECT product_id, buyer_id, quantity FROM basket WHERE product_id NOT IN (SELECT id FROM v_catalog)",
    "v_catalog",
)
def unknown_basket_products(v):
    return l.unknown_basket_products(basket(v), v.catalog)


@query(
    "basket_totals",
    f"""WITH {BASKET_SQL} SELECT buyer_id, CAST(sum(quantity) AS BIGINT) AS units, round(sum(quantity * price), 3) AS total
       FROM basket JOIN v_catalog ON id = product_id GROUP BY ALL""",
    "v_catalog",
)
def basket_totals(v):
    from shelfwise.operators.orders import basket_total

    totals = basket_total(l.basket_lines(basket(v), v.catalog))
    return totals.withColumn("total", F.round("total", 3))


@query(
    "subscription_deliveries",
    """SELECT e.event_id, e.event_type, 'sub-' || n_nationkey AS subscription_id, n_nationkey AS user_id,
         'https://hooks.example/' || n_nationkey AS dest_url
       FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OrderPaid' WHEN 1 THEN 'OrderShipped' ELSE 'ProductPriceChanged' END AS event_type FROM events) e
       JOIN nation ON CASE n_nationkey % 3 WHEN 0 THEN 'OrderPaid' WHEN 1 THEN 'OrderShipped' ELSE 'ProductPriceChanged' END = e.event_type
       WHERE e.event_type <> 'ProductPriceChanged'""",
)
def subscription_deliveries(v):
    def kind(n):
        return F.when(n % 3 == 0, "OrderPaid").when(n % 3 == 1, "OrderShipped").otherwise("ProductPriceChanged")

    events = v.table("events").select("event_id", kind(F.col("event_id")).alias("event_type"))
    user = F.col("n_nationkey")
    subscriptions = v.table("nation").select(
        kind(user).alias("type"), F.concat(F.lit("sub-"), user).alias("subscription_id"),
        user.alias("user_id"), F.concat(F.lit("https://hooks.example/"), user).alias("dest_url"),
    )
    return l.subscription_deliveries(events, subscriptions)


@query(
    "subscriptions_of_a_user",
    """SELECT 'sub-' || c_custkey AS subscription_id, CASE c_custkey % 3 WHEN 0 THEN 'OrderPaid' WHEN 1 THEN 'OrderShipped' ELSE 'ProductPriceChanged' END AS type,
         'https://hooks.example/' || c_custkey AS dest_url, c_nationkey AS user_id FROM customer WHERE c_nationkey = 7""",
)
def subscriptions_of_a_user(v):
    n = F.col("c_custkey")
    subscriptions = v.table("customer").select(
        F.concat(F.lit("sub-"), n).alias("subscription_id"),
        F.when(n % 3 == 0, "OrderPaid").when(n % 3 == 1, "OrderShipped").otherwise("ProductPriceChanged").alias("type"),
        F.concat(F.lit("https://hooks.example/"), n).alias("dest_url"), F.col("c_nationkey").alias("user_id"),
    )
    return l.subscriptions_of_user(subscriptions, 7)


def order_lines(v):
    return v.table("lineitem").select(
        (F.col("l_orderkey") + 1).cast("int").alias("order_id"),
        (F.col("l_partkey") + F.when(F.col("l_partkey") % 211 == 5, 5_000_000).otherwise(1)).cast("int").alias("sku_id"),
        F.element_at(F.array(F.lit("NCR"), F.lit("BLR"), F.lit("BOM"), F.lit("HYD")), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("location_code"),
        (F.floor("l_quantity") * 2).cast("int").alias("units"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("line_number"),
    )


LINES_SQL = """line AS (SELECT CAST(l_orderkey + 1 AS INTEGER) AS order_id,
   CAST(l_partkey + CASE WHEN l_partkey % 211 = 5 THEN 5000000 ELSE 1 END AS INTEGER) AS sku_id,
   (['NCR','BLR','BOM','HYD'])[CAST(l_orderkey % 4 AS INTEGER) + 1] AS location_code, CAST(floor(l_quantity) * 2 AS INTEGER) AS units,
   l_linenumber * 1000000 + l_suppkey AS line_number FROM lineitem),
checked AS (SELECT line.*, coalesce(b.available >= line.units, false) AS has_stock FROM line
   LEFT JOIN v_balance b ON b.sku_id = line.sku_id AND b.location_code = line.location_code)"""


@query("stock_check_lines", f"WITH {LINES_SQL} SELECT order_id, sku_id, location_code, units, line_number, has_stock FROM checked", "v_balance")
def stock_check_lines(v):
    return l.stock_check_lines(order_lines(v), v.balances)


@query(
    "stock_availability",
    f"""WITH {LINES_SQL} SELECT order_id, bool_and(has_stock) AS confirmed, count(*) AS lines,
       coalesce(string_agg(CASE WHEN NOT has_stock THEN CAST(sku_id AS VARCHAR) END, '|' ORDER BY line_number, sku_id), '') AS rejected_skus FROM checked GROUP BY ALL""",
    "v_balance",
)
def stock_availability(v):
    return l.stock_availability(order_lines(v), v.balances)


@query(
    "shadow_agreement",
    f"""WITH checks AS (SELECT event_id, {sql_recurring('event_id', 3000, 3)} AS order_id, ts AS evaluated_at, event_id % 3 <> 0 AS inventory_confirmed FROM events),
       newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY evaluated_at DESC, event_id DESC) AS i FROM checks) WHERE i = 1),
       seen AS (SELECT o_orderkey AS order_id, o_orderstatus <> 'F' AS catalog_confirmed FROM orders)
       SELECT event_id, n.order_id, strftime(evaluated_at, '{STAMP}') AS evaluated_at, inventory_confirmed, catalog_confirmed,
       inventory_confirmed = catalog_confirmed AS agreement FROM newest n LEFT JOIN seen s ON s.order_id = n.order_id""",
)
def shadow_agreement(v):
    n = F.col("event_id")
    checks = v.table("events").select(
        n.alias("event_id"), recurring(n, 3000, 3).alias("order_id"), F.col("ts").alias("evaluated_at"),
        (n % 3 != 0).alias("inventory_confirmed"),
    )
    observed = v.table("orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") != "F").alias("catalog_confirmed"),
        F.col("o_orderdate").alias("observed_at"),
    )
    return l.shadow_agreement(checks, observed).drop("observed_at")


@query(
    "shadow_agreement_counts",
    f"""WITH checks AS (SELECT {sql_recurring('event_id', 3000, 3)} AS order_id, arg_max(event_id % 3 <> 0, (ts, event_id)) AS inventory_confirmed FROM events GROUP BY 1),
       seen AS (SELECT o_orderkey AS order_id, o_orderstatus <> 'F' AS catalog_confirmed FROM orders)
       SELECT inventory_confirmed = catalog_confirmed AS agreement, count(*) AS rows FROM checks c LEFT JOIN seen s ON s.order_id = c.order_id GROUP BY ALL""",
)
def shadow_agreement_counts(v):
    from shelfwise.operators.stats import status_counts

    return status_counts(shadow_agreement(v), ["agreement"])


@query(
    "one_balance_lookup",
    "SELECT sku_id, location_code, on_hand, reserved, available FROM v_balance WHERE sku_id = 42 AND location_code = 'BLR'",
    "v_balance",
)
def one_balance_lookup(v):
    return v.balances.filter((F.col("sku_id") == 42) & (F.col("location_code") == "BLR")).select(
        *KEY, "on_hand", "reserved", "available"
    )


@query(
    "current_stock_snapshot",
    """WITH seg AS (SELECT *, sum(CASE WHEN operation = 'SNAPSHOT' THEN 1 ELSE 0 END) OVER (PARTITION BY sku_id, location_code
         ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS segment FROM v_balance_change)
       SELECT sku_id || ':' || location_code AS stream_key, on_hand, available FROM (SELECT *, row_number() OVER (
         PARTITION BY sku_id, location_code ORDER BY segment DESC, version DESC, "offset") AS i FROM seg) WHERE i = 1""",
    "v_balance_change",
)
def current_stock_snapshot(v):
    from shelfwise.functions import sku_location_key

    return current_balance(v.balance_changes).select(
        sku_location_key().alias("stream_key"), "on_hand", "available"
    ).orderBy("stream_key")


@query(
    "catalog_page",
    """WITH hit AS (SELECT * FROM v_catalog WHERE name LIKE 's%' AND type_id IN (1, 2, 3) AND brand_id IN (2, 5, 7, 17, 20, 21))
       SELECT id, name, brand_id, type_id, price, (SELECT count(*) FROM hit) AS total_items FROM hit ORDER BY name, id LIMIT 10 OFFSET 20""",
    "v_catalog",
)
def catalog_page(v):
    hit = c.catalog_filter(v.catalog, "s", [1, 2, 3], [2, 5, 7, 17, 20, 21])
    return c.catalog_page(hit, 2, 10)


@query(
    "catalog_page_thousand",
    "SELECT id, name, brand_id, type_id, price, (SELECT count(*) FROM v_catalog) AS total_items FROM v_catalog ORDER BY name, id LIMIT 10 OFFSET 10000",
    "v_catalog",
)
def catalog_page_thousand(v):
    """Far along; on a small catalog past its end, which gives no rows."""
    return c.catalog_page(v.catalog, 1000, 10)


@query(
    "catalog_most_expensive",
    "SELECT id, name, brand_id, type_id, price, (SELECT count(*) FROM v_catalog) AS total_items FROM v_catalog ORDER BY price DESC, id LIMIT 25",
    "v_catalog",
)
def catalog_most_expensive(v):
    return c.catalog_page(v.catalog, 0, 25, "price_desc")


@query(
    "catalog_cheapest",
    "SELECT id, name, brand_id, type_id, price, (SELECT count(*) FROM v_catalog) AS total_items FROM v_catalog ORDER BY price, id LIMIT 25",
    "v_catalog",
)
def catalog_cheapest(v):
    return c.catalog_page(v.catalog, 0, 25, "price")


@query(
    "catalog_last_names",
    "SELECT id, name, brand_id, type_id, price, (SELECT count(*) FROM v_catalog) AS total_items FROM v_catalog ORDER BY name DESC, id LIMIT 25",
    "v_catalog",
)
def catalog_last_names(v):
    return c.catalog_page(v.catalog, 0, 25, "name_desc")


@query(
    "catalog_items_by_ids",
    "SELECT id, name, price FROM v_catalog WHERE id IN (1, 5, 99, 100000000)",
    "v_catalog",
)
def catalog_items_by_ids(v):
    return c.catalog_filter(v.catalog, ids=[1, 5, 99, 100000000]).select("id", "name", "price")


@query(
    "catalog_facets",
    """SELECT 'brand' AS facet, brand_id AS value_id, count(*) AS items FROM v_catalog WHERE type_id IN (1, 2) GROUP BY ALL
       UNION ALL SELECT 'type', type_id, count(*) FROM v_catalog WHERE brand_id IN (3, 4, 5) GROUP BY ALL
       UNION ALL SELECT 'brand_total', NULL, count(*) FROM v_catalog WHERE type_id IN (1, 2)
       UNION ALL SELECT 'type_total', NULL, count(*) FROM v_catalog WHERE brand_id IN (3, 4, 5)""",
    "v_catalog",
)
def catalog_facets(v):
    return c.catalog_facets(v.catalog, [1, 2], [3, 4, 5])


@query(
    "catalog_facets_without_match",
    """SELECT 'brand_total' AS facet, CAST(NULL AS INTEGER) AS value_id, count(*) AS items FROM v_catalog WHERE type_id = -1
       UNION ALL SELECT 'type', type_id, count(*) FROM v_catalog WHERE brand_id IN (3) GROUP BY ALL
       UNION ALL SELECT 'type_total', NULL, count(*) FROM v_catalog WHERE brand_id IN (3)""",
    "v_catalog",
)
def catalog_facets_without_match(v):
    return c.catalog_facets(v.catalog, [-1], [3])


@query(
    "semantic_top_k",
    """SELECT vec_id, label, round(distance, 6) AS distance, total_items FROM (SELECT vec_id, label,
         1.0::DOUBLE - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS distance,
         (SELECT count(*) FROM embeddings) AS total_items
       FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings))
       ORDER BY distance, vec_id LIMIT 15 OFFSET 15""",
)
def semantic_top_k(v):
    vectors = v.table("embeddings")
    wanted = vectors.filter(F.col("vec_id") == 7).select(F.col("embedding").cast("array<double>")).scalar()
    return c.semantic_top_k(vectors, wanted, "embedding", "vec_id", 15, 1).select(
        "vec_id", "label", "distance", "total_items"
    )


@query(
    "semantic_top_k_batch",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
       near AS (SELECT q.vec_id AS query_id, x.vec_id,
         1.0::DOUBLE - list_dot_product(x.e, q.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(q.e, q.e))) AS distance
         FROM v q CROSS JOIN v x WHERE q.vec_id % 100 = 0)
       SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, round(distance, 6) AS distance, (SELECT count(*) FROM embeddings) AS total_items
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM near) WHERE place <= 10""",
)
def semantic_top_k_batch(v):
    """Every hundredth vector asks for its ten nearest among all."""
    vectors = v.table("embeddings")
    near = batch_top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), "embedding", "vec_id", k=10)
    return near.drop("opened", "blocks")


@query(
    "facts_filed_by_month",
    """SELECT strftime(occurred_at, '%Y%m') AS month, movement_type, count(*) AS facts, CAST(sum(quantity) AS BIGINT) AS units
       FROM v_event_movement GROUP BY ALL""",
    "v_event_movement",
)
def facts_filed_by_month(v):
    """All movements are filed by month and read back."""
    path = scratch_path(v.spark, "facts")
    lake.write_facts(v.event_movements, path)
    filed = lake.read_facts(v.spark, path, v.event_movements.schema)
    return filed.groupBy("month", "movement_type").agg(F.count("*").alias("facts"), F.sum("quantity").alias("units"))


@query("type_list", "SELECT DISTINCT type FROM v_source_item WHERE type IS NOT NULL", "v_source_item")
def type_list(v):
    return c.dimension_list(v.source_items.filter(F.col("type").isNotNull()), "type")


@query("brand_list", "SELECT DISTINCT brand FROM v_source_item WHERE brand IS NOT NULL", "v_source_item")
def brand_list(v):
    return c.dimension_list(v.source_items.filter(F.col("brand").isNotNull()), "brand")


DIMS_SQL = """usable AS (SELECT * FROM v_source_item WHERE name IS NOT NULL AND brand IS NOT NULL AND type IS NOT NULL),
dimmed AS (SELECT *, CAST(dense_rank() OVER (ORDER BY brand) AS INTEGER) AS brand_id, CAST(dense_rank() OVER (ORDER BY type) AS INTEGER) AS type_id FROM usable)"""


@query(
    "catalog_dimensions",
    f"WITH {DIMS_SQL} SELECT id, name, brand, type, brand_id, type_id FROM dimmed",
    "v_source_item",
)
def catalog_dimensions(v):
    items, _, _ = c.build_dims(v.source_items)
    return items.select("id", "name", "brand", "type", "brand_id", "type_id")


@query(
    "items_with_brand",
    f"WITH {DIMS_SQL} SELECT v.id, v.brand_id, b.brand FROM v_catalog v LEFT JOIN (SELECT DISTINCT brand, brand_id FROM dimmed) b USING (brand_id)",
    "v_source_item v_catalog",
)
def items_with_brand(v):
    _, brands, _ = c.build_dims(v.source_items)
    return c.with_brand(v.catalog, brands).select("id", "brand_id", "brand")


@query(
    "newest_movements_per_key",
    f"""SELECT movement_id, sku_id, location_code, strftime(occurred_at, '{STAMP}') AS occurred_at FROM (SELECT *, row_number() OVER (
         PARTITION BY sku_id, location_code ORDER BY occurred_at DESC, movement_id) AS i FROM v_event_movement) WHERE i <= 3""",
    "v_event_movement",
)
def newest_movements_per_key(v):
    newest = c.newest_n(v.event_movements, KEY, [F.desc("occurred_at"), F.asc("movement_id")], 3)
    return newest.select("movement_id", *KEY, "occurred_at")


@query(
    "newest_movements",
    f"SELECT movement_id, strftime(occurred_at, '{STAMP}') AS occurred_at FROM v_event_movement ORDER BY v_event_movement.occurred_at DESC, movement_id LIMIT 20",
    "v_event_movement",
)
def newest_movements(v):
    newest = c.newest_n(v.event_movements, [], [F.desc("occurred_at"), F.asc("movement_id")], 20)
    return newest.select("movement_id", "occurred_at")


@query(
    "price_changes",
    """SELECT product_id, version, new_price, old_price FROM (SELECT l_partkey % 300 AS product_id, version, price AS new_price,
         lag(price) OVER (PARTITION BY l_partkey % 300 ORDER BY version) AS old_price
       FROM (SELECT l_partkey, l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS version, floor(l_quantity / 10) * 10 AS price FROM lineitem))
       WHERE old_price IS NOT NULL AND new_price <> old_price""",
)
def price_changes(v):
    versions = v.table("lineitem").select(
        (F.col("l_partkey") % 300).alias("product_id"),
        (
            F.col("l_orderkey") * 100000000000 + F.col("l_linenumber") * 10000000000
            + F.col("l_partkey") * 10000 + F.col("l_suppkey")
        ).alias("version"),
        (F.floor(F.col("l_quantity") / 10) * 10).cast("double").alias("price"),
    )
    return c.price_changes(versions, F.floor(F.col("version") / 10**14))


@query(
    "seed_balances",
    """SELECT sku_id, location_code, on_hand, 0 AS reserved, on_hand AS available, safety_stock, reorder_point, max_stock, 1::BIGINT AS version
       FROM v_balance b WHERE NOT EXISTS (SELECT 1 FROM v_movement m WHERE m.sku_id = b.sku_id AND m.location_code = b.location_code AND m.movement_type = 'Restock')""",
    "v_balance v_movement",
)
def seed_balances(v):
    return c.seed_balances(v.skus, v.movements.filter(F.col("movement_type") == "Restock"))
