"""Inventory ledger: running balances, violations, reservations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY
from .keyed import keyed_join, running


def on_hand_delta() -> Column:
    """Units a movement adds to stock on hand. Return and Adjustment are our extension."""
    kind, units = F.col("movement_type"), F.col("quantity")
    return (
        F.when(kind == "Sale", -units)
        .when(kind.isin("Restock", "Return", "Adjustment"), units)
        .otherwise(F.lit(0))
    )


def reserved_delta() -> Column:
    kind, units = F.col("movement_type"), F.col("quantity")
    return F.when(kind == "Reserve", units).when(kind.isin("Release", "Sale"), -units).otherwise(F.lit(0))


def version_chunk(column: str = "resulting_balance_version", size: int = 65536) -> Column:
    return F.floor(F.col(column) / size)


def ledger_balance(
    initial: DataFrame,
    movements: DataFrame,
    order: tuple[str, ...] = ("resulting_balance_version", "movement_id"),
    chunk: Column | None = None,
) -> DataFrame:
    """Stock after every movement, starting from the opening balance of its key."""
    chunk = version_chunk() if chunk is None else chunk
    moved = running(
        movements, KEY, order, chunk,
        sums={
            "_on_hand": on_hand_delta(), "_reserved": reserved_delta(), "_steps": F.lit(1),
        },
    )
    opening = initial.select(
        *KEY, F.col("on_hand").alias("_open_on_hand"), F.col("reserved").alias("_open_reserved"),
        F.col("version").alias("_open_version"), "max_stock",
    )
    # One opening row per key; a hot key's movements are spread by AQE's skew join.
    joined = keyed_join(moved, opening, KEY)
    return (
        joined.withColumn("ledger_on_hand", F.col("_open_on_hand") + F.col("_on_hand"))
        .withColumn("ledger_reserved", F.col("_open_reserved") + F.col("_reserved"))
        .withColumn("ledger_available", F.col("ledger_on_hand") - F.col("ledger_reserved"))
        .withColumn("ledger_version", F.col("_open_version") + F.col("_steps"))
        .drop("_on_hand", "_reserved", "_steps", "_open_on_hand", "_open_reserved", "_open_version")
    )


def ledger_violations(
    initial: DataFrame,
    movements: DataFrame,
    order: tuple[str, ...] = ("resulting_balance_version", "movement_id"),
    chunk: Column | None = None,
) -> DataFrame:
    """Movements the stock before them did not allow, and gaps in the version sequence."""
    after = ledger_balance(initial, movements, order, chunk)
    before_on_hand = F.col("ledger_on_hand") - on_hand_delta()
    before_reserved = F.col("ledger_reserved") - reserved_delta()
    kind, units = F.col("movement_type"), F.col("quantity")
    flags = F.array(
        F.when((kind == "Reserve") & (units > before_on_hand - before_reserved), "reserve_above_available"),
        F.when(kind.isin("Sale", "Release") & (units > before_reserved), "taken_above_reserved"),
        F.when(F.col("ledger_on_hand") > F.col("max_stock"), "on_hand_above_max"),
        F.when(F.col("resulting_balance_version") != F.col("ledger_version"), "version_gap"),
    )
    return after.withColumn("violations", F.filter(flags, lambda f: f.isNotNull())).filter(
        F.size("violations") > 0
    )


def restock_accepted(quantity: Column, on_hand: Column, max_stock: Column) -> Column:
    """Units that fit; 0 means no capacity."""
    return F.greatest(F.least(quantity, max_stock - on_hand), F.lit(0))


def merge_request_lines(lines: DataFrame, request: list[str]) -> DataFrame:
    """One line per sku and request."""
    return lines.groupBy(*request, "sku_id").agg(F.sum("quantity").alias("quantity"))


def redelivery_outcome(lines: DataFrame, delivery: str | None = None) -> DataFrame:
    """One outcome per delivery: Succeeded for the first of an order and location, then AlreadyProcessed or Conflict.

    `lines` has request_id, requested_at, order_id, location_code, sku_id and quantity. A request delivered
    again, with its id, was already processed; another request is, if its lines equal those that were
    reserved, and else conflicts. Deliveries of a request differ in requested_at, or in the column `delivery`
    where given; lines without order or location belong to no request. Lines meet by order, location and sku, where
    the first delivery of a sku shows whether the order's first one holds it, so neither a busy order nor a long
    request is gathered.
    """
    place = ["order_id", "location_code"]
    known = lines.filter(F.col("order_id").isNotNull() & F.col("location_code").isNotNull())
    numbered = known.withColumn("_delivery", F.col(delivery) if delivery else F.lit(0)).repartition(*place, "sku_id")
    came = ["requested_at", "_delivery", "request_id"]
    one, arrival = [*place, *came], F.struct(*came)
    # One shuffle and one sort for the merged lines and for the window over them; sorting spills, an aggregate of
    # nearly unique lines holds them all.
    of_line = Window.partitionBy(*place, "sku_id", *came).orderBy(F.lit(0))
    merged = numbered.select(
        *one, "sku_id", F.sum("quantity").over(of_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("quantity"),
        F.row_number().over(of_line).alias("_i"),
    ).filter("_i = 1")
    of_sku = Window.partitionBy(*place, "sku_id").orderBy(*came).rowsBetween(Window.unboundedPreceding, 0)
    met = merged.select(
        *one, F.col("sku_id").isNotNull().alias("_named"), "quantity",
        F.first("quantity").over(of_sku).alias("_first_quantity"), F.first(arrival).over(of_sku).alias("_by"),
    )
    # A delivery's lines come from many tasks: combining them before the shuffle would sort them for nothing.
    same = met.repartition(*one).groupBy(*one).agg(
        F.count(F.when(F.col("_named") & (F.col("quantity") == F.col("_first_quantity")), 1)).alias("same"),
        F.count("*").alias("n"), F.min("_by").alias("_from"), F.max("_by").alias("_to"),
    )
    # Taken with all columns, so that both sides of the join read one shuffle; an order's arrivals are distinct.
    whole = F.struct(*came, "n", "same", "_from", "_to")
    firsts = same.groupBy(*place).agg(F.min(whole).alias("_first")).select(
        *place, F.struct(*[F.col(f"_first.{c}").alias(c) for c in came]).alias("first"), F.col("_first.n").alias("first_n")
    )
    # Every sku of the delivery came first with the order's first one; one without time or id has no lines to compare.
    told = F.col("first.requested_at").isNotNull() & F.col("first.request_id").isNotNull() & F.col("first._delivery").isNotNull()
    of_first = (F.col("_from") == F.col("first")) & (F.col("_to") == F.col("first"))
    equal = told & of_first & (F.col("same") == F.col("n")) & (F.col("n") == F.col("first_n"))
    return same.join(firsts, place).select(
        "request_id", *place,
        F.when(arrival == F.col("first"), "Succeeded")
        .when((F.col("request_id") == F.col("first.request_id")) | equal, "AlreadyProcessed")
        .otherwise("Conflict")
        .alias("outcome"),
    )


def reservation_state(movements: DataFrame) -> DataFrame:
    """Reserved, Committed or Released per (order, sku, location); the first terminal move stays."""
    terminal = F.col("movement_type").isin("Sale", "Release")
    when = F.when(terminal, F.struct("occurred_at", "movement_id"))
    return (
        movements.filter(F.col("movement_type").isin("Reserve", "Sale", "Release"))
        .groupBy("order_id", *KEY)
        .agg(
            F.sum(F.when(F.col("movement_type") == "Reserve", F.col("quantity"))).alias("reserved_quantity"),
            F.min_by("movement_type", when).alias("_terminal"),
        )
        .filter(F.col("reserved_quantity").isNotNull())
        .select(
            "order_id", *KEY, "reserved_quantity",
            F.when(F.col("_terminal") == "Sale", "Committed")
            .when(F.col("_terminal") == "Release", "Released")
            .otherwise("Reserved")
            .alias("status"),
        )
    )


def reservations_of(movements: DataFrame, order_id: int) -> DataFrame:
    """Reserved units of one order per sku and location; the filter reaches the scan."""
    return (
        movements.filter((F.col("order_id") == order_id) & (F.col("movement_type") == "Reserve"))
        .groupBy("order_id", *KEY)
        .agg(F.sum("quantity").alias("reserved_quantity"))
    )
