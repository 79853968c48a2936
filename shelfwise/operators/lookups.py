"""Dimension lookups with wildcards, enrichment joins and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY
from .demand import at
from .keyed import keyed_join, latest, lookup_join, running

# The wildcard location and the subscription types that deliver.
ANY_LOCATION = "ALL"
DELIVERED_TYPES = ("OrderPaid", "OrderShipped")
# End of fixed values.


def _at_every_location(dimension: DataFrame, keys: DataFrame) -> DataFrame:
    """Wildcard rows repeated for each location in use, so that lookups are equi joins.

    The distinct locations, a short dimension, reach the few wildcard rows as one scalar list.
    """
    in_use = keys.agg(F.collect_set("location_code").alias("codes")).select("codes").scalar()
    wild = dimension.filter(F.col("location_code") == ANY_LOCATION).withColumn("_codes", in_use)
    everywhere = wild.withColumn("location_code", F.explode("_codes")).drop("_codes")
    return dimension.filter(F.col("location_code") != ANY_LOCATION).unionByName(everywhere)


def calendar_of_locations(keys: DataFrame, calendar: DataFrame, days_ahead: int, as_of) -> DataFrame:
    """Calendar entries that touch the next days, once for each location in use."""
    today = F.to_date(at(as_of))
    current = calendar.filter(
        (F.col("start_date") <= F.date_add(today, days_ahead)) & (F.col("end_date") >= today)
    )
    spread = _at_every_location(current, keys)
    return spread.join(keys.select("location_code").distinct(), "location_code", "left_semi")


def event_calendar(keys: DataFrame, calendar: DataFrame, days_ahead: int, as_of) -> DataFrame:
    """Calendar entries of each key's location, or of all locations, that touch the next days."""
    spread = calendar_of_locations(keys, calendar, days_ahead, as_of)
    return lookup_join(keys, spread, ["location_code"]).orderBy(*KEY, "start_date", "event_id")


def supplier_signals(keys: DataFrame, signals: DataFrame, as_of, by_sku: bool = True,
                     resolved_days: int = 7) -> DataFrame:
    """Unresolved or recently resolved signals of each key, newest first.

    A null sku on a signal stands for every sku. Without `by_sku` the location alone decides.
    """
    recent = signals.filter(
        F.col("resolved_at").isNull()
        | (F.col("resolved_at") >= at(as_of) - F.expr(f"interval {int(resolved_days)} days"))
    ).withColumnRenamed("sku_id", "signal_sku")
    spread = _at_every_location(recent, keys)
    if not by_sku:
        found = lookup_join(keys, spread, ["location_code"])
    else:
        general = lookup_join(keys, spread.filter(F.col("signal_sku").isNull()), ["location_code"])
        own = spread.filter(F.col("signal_sku").isNotNull()).withColumn("sku_id", F.col("signal_sku"))
        found = general.unionByName(keys.join(own, KEY).select(*general.columns))
    return found.orderBy(F.desc("reported_at"), *KEY, "signal_id")


def evaluated_movements(movements: DataFrame) -> DataFrame:
    """Only sales and reserves trigger an evaluation."""
    return movements.filter(F.col("movement_type").isin("Sale", "Reserve"))


def with_current_balance(movements: DataFrame, balances: DataFrame) -> DataFrame:
    """Current balance attached to each evaluated movement; a hot key's movements are split by adaptive execution."""
    stock = balances.select(*KEY, "on_hand", "reserved", "available", "version")
    return keyed_join(evaluated_movements(movements), stock, KEY)


def balance_as_of_movement(
    movements: DataFrame, balances: DataFrame, chunk: Column | None = None
) -> DataFrame:
    """As-of join: the newest balance whose version is at most the movement's version.

    Both sides become one ordered log per key; the last balance seen is carried forward. `chunk`
    runs on `_version`.
    """
    chunk = F.floor(F.col("_version") / 65536) if chunk is None else chunk
    carried = ["on_hand", "reserved", "available", "version"]
    facts = evaluated_movements(movements).select(
        *KEY, F.col("resulting_balance_version").alias("_version"), F.lit(1).alias("_side"),
        "movement_id", F.struct(*[c for c in movements.columns if c not in (*KEY, "movement_id")]).alias("_fact"),
    )
    states = balances.select(
        *KEY, F.col("version").alias("_version"), F.lit(0).alias("_side"),
        F.struct(*carried).alias("_balance"),
    )
    log = facts.unionByName(states, allowMissingColumns=True)
    filled = running(
        log, KEY, ["_version", "_side", "movement_id"], chunk, lasts={"_seen": F.col("_balance")}
    )
    return filled.filter(F.col("_side") == 1).select(
        *KEY, "movement_id", "_fact.*", *[F.col(f"_seen.{c}").alias(f"balance_{c}") for c in carried]
    )


def basket_lines(baskets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Basket lines with product name and price."""
    products = catalog.select(F.col("id").alias("product_id"), "name", "price")
    return lookup_join(baskets, products, ["product_id"])


def unknown_basket_products(baskets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Basket lines whose product is not in the catalog: an error for the caller."""
    return baskets.join(catalog.select(F.col("id").alias("product_id")), "product_id", "left_anti")


def subscription_deliveries(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One delivery row per event and subscriber of its type."""
    wanted = events.filter(F.col("event_type").isin(*DELIVERED_TYPES))
    targets = subscriptions.select(
        F.col("type").alias("event_type"), "subscription_id", "user_id", "dest_url"
    ).filter(F.col("event_type").isin(*DELIVERED_TYPES))
    return lookup_join(wanted, targets, ["event_type"])


def subscriptions_of_user(subscriptions: DataFrame, user_id, subscription_id=None) -> DataFrame:
    """All subscriptions of one user, or the one with that id if it is theirs; another user's gives no row."""
    own = subscriptions.filter(F.col("user_id") == F.lit(user_id))
    return own if subscription_id is None else own.filter(F.col("subscription_id") == F.lit(subscription_id))


def stock_check_lines(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Each order line against the current available stock; lines are not merged."""
    stock = balances.select(*KEY, F.col("available").alias("_available"))
    checked = keyed_join(lines, stock, KEY, how="left")
    enough = F.coalesce(F.col("_available") >= F.col("units"), F.lit(False))
    return checked.withColumn("has_stock", enough).drop("_available")


def stock_availability(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Per order: confirmed or not, and the rejected skus in line order."""
    checked = stock_check_lines(lines, balances)
    rejected = F.collect_list(
        F.when(~F.col("has_stock"), F.struct("line_number", "sku_id"))
    )
    return (
        checked.groupBy("order_id")
        .agg(
            F.bool_and("has_stock").alias("confirmed"),
            F.count("*").alias("lines"),
            F.array_sort(rejected).alias("_rejected"),
        )
        .select(
            "order_id", "confirmed", "lines", F.col("_rejected.sku_id").alias("rejected_skus")
        )
    )


def shadow_agreement(checks: DataFrame, observed: DataFrame) -> DataFrame:
    """Newest check per order against the observed result; agreement is null until observed."""
    newest = latest(checks, ["order_id"], ["evaluated_at", "event_id"])
    seen = latest(
        observed.select("order_id", "catalog_confirmed", "observed_at"), ["order_id"], ["observed_at"]
    )
    return newest.join(seen, "order_id", "left").withColumn(
        "agreement", F.col("inventory_confirmed") == F.col("catalog_confirmed")
    )
