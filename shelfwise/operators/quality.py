"""Invariants, row rules, parity and audit-chain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_location
from ..model import MOVEMENT_TYPES
from .keyed import earliest


def balance_invariants_hold(row: Column | None = None) -> Column:
    c = F.col if row is None else row.getField
    return (
        (c("reserved") >= 0)
        & (c("reserved") <= c("on_hand"))
        & (c("on_hand") <= c("max_stock"))
        & (c("safety_stock") >= 0)
        & (c("safety_stock") <= c("reorder_point"))
        & (c("reorder_point") <= c("max_stock"))
        & (c("available") == c("on_hand") - c("reserved"))
    )


def _named_violations(rules: dict[str, Column]) -> Column:
    flags = [F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def balance_violations(balances: DataFrame) -> DataFrame:
    """Balances that break an invariant, with the names of the broken ones."""
    rules = {
        "reserved_negative": F.col("reserved") < 0,
        "reserved_above_on_hand": F.col("reserved") > F.col("on_hand"),
        "on_hand_above_max": F.col("on_hand") > F.col("max_stock"),
        "safety_negative": F.col("safety_stock") < 0,
        "safety_above_reorder": F.col("safety_stock") > F.col("reorder_point"),
        "reorder_above_max": F.col("reorder_point") > F.col("max_stock"),
        "available_mismatch": F.col("available") != F.col("on_hand") - F.col("reserved"),
    }
    return balances.withColumn("violations", _named_violations(rules)).filter(
        F.size("violations") > 0
    )


def count_violations(violating: DataFrame) -> DataFrame:
    """Rows per violation name."""
    return (
        violating.select(F.explode("violations").alias("violation"))
        .groupBy("violation")
        .agg(F.count("*").alias("rows"))
    )


def movement_violations(movements: DataFrame) -> DataFrame:
    """Adds the list of broken movement rules to every row."""
    location = normalize_location("location_code")
    adjustment = F.col("movement_type") == "Adjustment"
    rules = {
        "movement_id_missing": F.col("movement_id").isNull(),
        "source_event_missing": F.col("source_event_id").isNull(),
        "sku_not_positive": F.col("sku_id") <= 0,
        "order_not_positive": F.coalesce(F.col("order_id") <= 0, F.lit(False)),
        "type_unknown": ~F.col("movement_type").isin(*MOVEMENT_TYPES),
        "adjustment_zero": adjustment & (F.col("quantity") == 0),
        "quantity_not_positive": ~adjustment & (F.col("quantity") <= 0),
        "version_not_positive": F.col("resulting_balance_version") <= 0,
        "location_blank": location == "",
        "location_too_long": F.length(location) > 16,
        "reason_too_long": F.coalesce(F.length(F.trim("reason")) > 200, F.lit(False)),
    }
    return movements.withColumn("violations", _named_violations(rules))


def source_sink_parity(source: DataFrame, sink: DataFrame, key: str = "movement_id") -> DataFrame:
    """Counts, distinct ids, one-sided ids and settled quantities of two copies of the facts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.count("*").alias(f"{name}_rows"),
            F.sum(F.when(F.col("movement_type") == "Reserve", F.col("quantity"))).alias(f"{name}_reserve"),
            F.sum(F.when(F.col("movement_type") == "Sale", F.col("quantity"))).alias(f"{name}_sale"),
        )

    both = side(source, "source").join(side(sink, "sink"), key, "full")
    zero = F.lit(0).cast("long")
    return both.agg(
        F.coalesce(F.sum("source_rows"), zero).alias("source_rows"),
        F.coalesce(F.sum("sink_rows"), zero).alias("sink_rows"),
        F.count("source_rows").alias("source_ids"),
        F.count("sink_rows").alias("sink_ids"),
        F.count(F.when(F.col("sink_rows").isNull(), 1)).alias("missing_in_sink"),
        F.count(F.when(F.col("source_rows").isNull(), 1)).alias("only_in_sink"),
        F.coalesce(F.sum("sink_reserve"), zero).alias("sink_reserve_units"),
        F.coalesce(F.sum("sink_sale"), zero).alias("sink_sale_units"),
    )


def audit_chain_breaks(
    decisions: DataFrame,
    simulations: DataFrame,
    proposals: DataFrame,
    policies: DataFrame,
    attempts: DataFrame,
) -> DataFrame:
    """Audit rows whose parent is missing, and rows with a negative quantity."""

    def orphans(child: DataFrame, child_id: str, parent: DataFrame, ref: str, name: str) -> DataFrame:
        known = parent.select(ref).distinct()
        return child.join(known, ref, "left_anti").select(
            F.lit(name).alias("rule"), F.col(child_id).alias("row_id")
        )

    negative = lambda df, row_id, column, name: df.filter(F.col(column) < 0).select(
        F.lit(name).alias("rule"), F.col(row_id).alias("row_id")
    )
    checks = [
        orphans(simulations, "simulation_id", decisions, "decision_id", "simulation_without_decision"),
        orphans(proposals, "proposal_id", decisions, "decision_id", "proposal_without_decision"),
        orphans(policies, "policy_decision_id", proposals, "proposal_id", "policy_without_proposal"),
        orphans(attempts, "attempt_id", proposals, "proposal_id", "attempt_without_proposal"),
        negative(decisions, "decision_id", "recommended_quantity", "negative_recommendation"),
        negative(simulations, "simulation_id", "selected_quantity", "negative_selection"),
        negative(proposals, "proposal_id", "quantity", "negative_proposal"),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Stored rows plus incoming rows whose id is new; the earliest incoming copy wins."""
    fresh = earliest(incoming, [key], order).join(stored.select(key).distinct(), key, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert_proposals(
    stored: DataFrame,
    incoming: DataFrame,
    key: str = "proposal_id",
    order: str = "updated_at",
    replaced: tuple[str, ...] = ("status", "updated_at", "reasoning"),
) -> DataFrame:
    """New ids are appended; known ids take only the `replaced` columns of their newest copy.

    `order` must be unique per id within the incoming rows.
    """
    every = stored.withColumn("_in", F.lit(0)).unionByName(
        incoming.select(*stored.columns).withColumn("_in", F.lit(1))
    )
    rank = F.struct("_in", order)
    kept = [c for c in stored.columns if c != key and c not in replaced]
    return (
        every.groupBy(key)
        .agg(
            F.min_by(F.struct(*kept), rank).alias("_first"),
            F.max_by(F.struct(*replaced), rank).alias("_last"),
        )
        .select(key, "_first.*", "_last.*")
        .select(*stored.columns)
    )
