"""Orders, baskets, buyers, the order lifecycle and idempotent commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LOCATIONS, ORDER_STATUSES
from .demand import at
from .keyed import earliest, latest, lookup_join

# Lifecycle steps as {step: {status it applies to: next status}}. Steps in any other
# status are ignored, except ship and cancel, whose wrong use is an error.
STEPS = {
    "await_validation": {"Submitted": "AwaitingValidation"},
    "confirm_stock": {"AwaitingValidation": "StockConfirmed"},
    "reject_stock": {"AwaitingValidation": "Cancelled"},
    "pay": {"StockConfirmed": "Paid"},
    "ship": {"Paid": "Shipped"},
    "cancel": {
        "Submitted": "Cancelled", "AwaitingValidation": "Cancelled", "StockConfirmed": "Cancelled",
        "Cancelled": "Cancelled",
    },
}
FAILING_STEPS = ("ship", "cancel")
# End of fixed values.

# Log positions are unique, so one chunk of an order's history holds at most this many steps.
STEP_CHUNK = 65536


def order_totals(items: DataFrame) -> DataFrame:
    """Sum of units times price per order; discounts do not count."""
    return items.groupBy("order_id").agg(F.sum(F.col("units") * F.col("unit_price")).alias("total"))


def orders_of_users(orders: DataFrame, items: DataFrame, buyers: DataFrame) -> DataFrame:
    """Order number, date, status and total per buyer. Items are summed before the join."""
    return (
        orders.join(order_totals(items), "order_id", "left")
        .join(buyers, "buyer_id")
        .select(
            "buyer_id", "buyer_name", "order_id", "order_date", "status",
            F.coalesce("total", F.lit(0.0)).alias("total"),
        )
    )


def order_details(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per order with its merged items nested in product order."""
    merged = merge_order_lines(items)
    nested = merged.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("product_id", "units", "unit_price", "discount"))).alias("items"),
        F.sum(F.col("units") * F.col("unit_price")).alias("total"),
    )
    return orders.join(nested, "order_id")


def merge_order_lines(lines: DataFrame) -> DataFrame:
    """Lines of one product become one: units add up, the best discount and first price stay."""
    return (
        lines.groupBy("order_id", "product_id")
        .agg(
            F.sum("units").alias("units"),
            F.max("discount").alias("discount"),
            F.min_by(F.struct("unit_price", "product_name"), F.struct("line_number", "line_id")).alias("_first"),
        )
        .select("order_id", "product_id", "_first.product_name", "_first.unit_price", "units", "discount")
    )


def _errors(rules: dict[str, Column]) -> Column:
    flags = [F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]
    return F.filter(F.array(*flags), lambda e: e.isNotNull())


def validate_order_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn(
        "errors",
        _errors(
            {
                "units_not_positive": F.col("units") <= 0,
                "total_below_discount": F.col("units") * F.col("unit_price") < F.col("discount"),
            }
        ),
    )


def validate_orders(orders: DataFrame, as_of, locations: Sequence[str] = LOCATIONS) -> DataFrame:
    """Adds the list of failed checks: card, expiry, address, location and non-empty items."""
    card = F.length("card_number")
    return orders.withColumn(
        "errors",
        _errors(
            {
                "card_number_length": (card < 12) | (card > 19),
                "card_code_length": F.length("card_security_code") != 3,
                "card_expired": F.col("card_expiration") < at(as_of),
                "location_unknown": ~F.upper(F.trim("location_code")).isin(*locations),
                "no_items": F.col("item_count") <= 0,
            }
        ),
    )


def _step(state: Column, step: Column) -> Column:
    result = state
    for name, moves in STEPS.items():
        for source, target in moves.items():
            code = ORDER_STATUSES.index(source)
            result = F.when(
                (step == name) & (state == code), F.lit(ORDER_STATUSES.index(target))
            ).otherwise(result)
    return result


def _is_error(state: Column, step: Column) -> Column:
    wrong = F.lit(False)
    for name in FAILING_STEPS:
        allowed = [ORDER_STATUSES.index(s) for s in STEPS[name]]
        wrong = wrong | ((step == name) & ~state.isin(*allowed))
    return wrong


def lifecycle_maps(events: DataFrame, position: str = "seq", chunk: Column | None = None) -> DataFrame:
    """Per order and chunk of its history: where each status leads, and the errors on the way.

    The lifecycle has six statuses, so any stretch of history is a table of six answers; tables of
    neighbouring stretches chain. No task has to read an order's whole history.
    """
    chunk = F.floor(F.col(position) / STEP_CHUNK) if chunk is None else chunk
    stretch = events.withColumn("chunk", chunk).groupBy("order_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("step").alias("s")))).alias("_steps")
    )

    def walk(start: int) -> Column:
        return F.aggregate(
            "_steps",
            F.struct(F.lit(start).alias("status"), F.lit(0).cast("long").alias("errors")),
            lambda acc, e: F.struct(
                _step(acc["status"], e["s"]).alias("status"),
                (acc["errors"] + _is_error(acc["status"], e["s"]).cast("long")).alias("errors"),
            ),
        )

    return stretch.select(
        "order_id", "chunk", F.array(*[walk(s) for s in range(len(ORDER_STATUSES))]).alias("leads_to")
    )


def combine_lifecycle(maps: DataFrame, position: str = "chunk") -> DataFrame:
    """One table per order that stands for all its stretches, in order; it has the last one's position.

    Gathered are an order's stretches: one per 65,536 positions, or per batch since the last compaction.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "leads_to")))

    def walk(start: int) -> Column:
        return F.aggregate(
            F.col("_ordered"),
            F.struct(F.lit(start).alias("status"), F.lit(0).cast("long").alias("errors")),
            lambda acc, m: F.struct(
                F.get(m["leads_to"], acc["status"])["status"].alias("status"),
                (acc["errors"] + F.get(m["leads_to"], acc["status"])["errors"]).alias("errors"),
            ),
        )

    return (
        maps.groupBy("order_id")
        .agg(ordered.alias("_ordered"), F.max(position).alias(position))
        .select("order_id", position, F.array(*[walk(s) for s in range(len(ORDER_STATUSES))]).alias("leads_to"))
    )


def chain_lifecycle(maps: DataFrame, position: str = "chunk") -> DataFrame:
    """Final status and number of illegal moves per order from its stretches, in order."""
    names = F.array(*[F.lit(s) for s in ORDER_STATUSES])
    final = F.get("leads_to", F.lit(0))
    return combine_lifecycle(maps, position).select(
        "order_id", F.get(names, final["status"]).alias("status"), final["errors"].alias("illegal_moves")
    )


def order_status_replay(events: DataFrame, position: str = "seq") -> DataFrame:
    """Replays order_id / step events in `position` order, from Submitted on."""
    return chain_lifecycle(lifecycle_maps(events, position))


def rejected_items_text(items: DataFrame, rejected: DataFrame) -> DataFrame:
    """The description of a stock rejection, naming the order's rejected products in line order."""
    hit = items.join(rejected.select("order_id", "product_id").distinct(), ["order_id", "product_id"], "left_semi")
    names = F.array_sort(F.collect_list(F.struct("line_number", "line_id", "product_name")))
    text = F.concat(
        F.lit("The product items don't have stock: ("),
        F.array_join(F.transform("_names", lambda n: n["product_name"]), ", "),
        F.lit(")."),
    )
    return hit.groupBy("order_id").agg(names.alias("_names")).select("order_id", text.alias("description"))


def grace_period_due(orders: DataFrame, grace_minutes: int, as_of) -> DataFrame:
    """Submitted orders whose grace period is over."""
    cutoff = at(as_of) - F.expr(f"interval {int(grace_minutes)} minutes")
    return orders.filter((F.col("order_date") <= cutoff) & (F.col("status") == "Submitted"))


def basket_total(lines: DataFrame) -> DataFrame:
    """Units and price total per basket."""
    return lines.groupBy("buyer_id").agg(
        F.sum("quantity").alias("units"), F.sum(F.col("quantity") * F.col("price")).alias("total")
    )


def latest_basket(upserts: DataFrame) -> DataFrame:
    """Last write per buyer; a delete removes the basket."""
    newest = latest(upserts, ["buyer_id"], ["written_at", "seq"])
    return newest.filter(~F.col("deleted"))


def payment_method_upsert(verifications: DataFrame) -> DataFrame:
    """Marks each card verification ADDED or REUSED and names its payment method.

    Methods match on card type, number and expiry within a buyer. Only the last four digits leave.
    """
    match = ["buyer_id", "card_type_id", "card_number", "expiration"]
    methods = earliest(
        verifications.select(*match, "seq", "verification_id"), match, ["seq", "verification_id"]
    ).select(*match, F.col("verification_id").alias("method_id"))
    joined = lookup_join(verifications, methods, match)
    return joined.select(
        "verification_id", "buyer_id", "card_type_id",
        F.concat(F.lit("****"), F.right("card_number", F.lit(4))).alias("card"),
        "expiration", "method_id",
        F.when(F.col("verification_id") == F.col("method_id"), "ADDED").otherwise("REUSED").alias("outcome"),
    )


def idempotent_requests(commands: DataFrame) -> DataFrame:
    """First command per request id, with the number of repeats that were ignored."""
    rest = [c for c in commands.columns if c != "request_id"]
    first = F.min_by(F.struct(*rest), F.struct("received_at", "seq"))
    picked = commands.groupBy("request_id").agg(first.alias("_row"), (F.count("*") - 1).alias("duplicates"))
    return picked.select("request_id", "_row.*", "duplicates").select(*commands.columns, "duplicates")
