"""Reorder decisions, simulation, proposals, policy gate and execution preflight."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clamp, normalize_location, trunc_int, uuid_v5
from ..model import KEY, GovernancePolicy, ReplenishmentPolicy
from .demand import at
from .keyed import earliest, keyed_join

# Reason codes and messages.
REASON_SPIKE = "DEMAND_SPIKE"
REASON_STOCKOUT = "STOCKOUT_BEFORE_OR_NEAR_LEAD_TIME"
REASON_BELOW = "INVENTORY_POSITION_BELOW_ADAPTIVE_TARGET"
REASON_SUFFICIENT = "INVENTORY_POSITION_SUFFICIENT"
CDC_CANDIDATES = (20, 81, 150)
PREFLIGHT_POLICY = "policy does not allow automatic execution"
PREFLIGHT_STATUS = "proposal is not executable"
PREFLIGHT_KEY = "proposal does not match current inventory key"
PREFLIGHT_CAPACITY = "proposal quantity exceeds current capacity"
PREFLIGHT_OK = "execution validated"
# End of fixed values.


def stockout_hours(available: Column, forecast: Column) -> Column:
    return F.when(
        forecast > 0, F.greatest(available, F.lit(0)).cast("double") / forecast * F.lit(24.0)
    )


def stockout_eta(hours: Column, computed_at: Column) -> Column:
    millis = F.floor(clamp(hours * 3_600_000.0, 0.0, 4.0e15)).cast("long")
    return F.timestamp_micros(F.unix_micros(computed_at) + millis * 1000)


def risk_level(hours: Column, policy: ReplenishmentPolicy = ReplenishmentPolicy()) -> Column:
    return (
        F.when(hours <= policy.critical_risk_hours, "CRITICAL")
        .when(hours <= policy.high_risk_hours, "HIGH")
        .when(hours <= policy.medium_risk_hours, "MEDIUM")
        .otherwise("LOW")
    )


def reason_codes(spike: Column, risk: Column, recommended: Column) -> Column:
    codes = F.array(
        F.when(spike, REASON_SPIKE),
        F.when(risk.isin("HIGH", "CRITICAL"), REASON_STOCKOUT),
        F.when(recommended > 0, REASON_BELOW).otherwise(REASON_SUFFICIENT),
    )
    return F.filter(codes, lambda code: code.isNotNull())


def reorder_decision(features: DataFrame, policy: ReplenishmentPolicy = ReplenishmentPolicy()) -> DataFrame:
    """Adds the decision columns. Needs the feature row, its stock limits and `incoming`."""
    horizon_days = max(1, ceil(policy.lead_time_days + policy.review_period_days))
    incoming = F.coalesce("incoming", F.lit(0))
    forecast = F.greatest("forecast_units_per_day", F.lit(0.0))
    learned = policy.service_factor * F.col("historical_stddev_units_per_day") * policy.lead_time_days**0.5
    points = F.slice("horizon", 1, horizon_days)
    demand = F.when(
        F.coalesce(F.size("horizon"), F.lit(0)) > 0,
        F.aggregate(points, F.lit(0.0), lambda total, p: total + p["forecast_units"]),
    ).otherwise(forecast * (policy.lead_time_days + policy.review_period_days))
    hours = stockout_hours(F.col("available"), forecast)
    df = (
        features.withColumn("incoming", incoming)
        .withColumn("forecast_units_per_day", forecast)
        .withColumn("inventory_position", F.col("on_hand") - F.col("reserved") + F.col("incoming"))
        .withColumn("decision_safety_stock", F.greatest(trunc_int(F.ceil(learned)), F.col("safety_stock")))
        .withColumn("horizon_demand_units", demand)
        .withColumn(
            "target_inventory",
            clamp(
                trunc_int(F.ceil("horizon_demand_units")).cast("long") + F.col("decision_safety_stock"),
                0, F.col("max_stock"),
            ).cast("int"),
        )
        .withColumn(
            "capacity",
            F.greatest(F.col("max_stock") - F.col("on_hand") - F.col("incoming"), F.lit(0)),
        )
        .withColumn(
            "recommended_quantity",
            F.least(
                F.greatest(F.col("target_inventory") - F.col("inventory_position"), F.lit(0)),
                F.col("capacity"),
            ),
        )
        .withColumn("stockout_hours", hours)
        .withColumn("risk_level", risk_level(F.col("stockout_hours"), policy))
        .withColumn("estimated_stockout_at", stockout_eta(F.col("stockout_hours"), F.col("computed_at")))
    )
    identity = F.concat_ws(
        ":", "sku_id", "location_code", "balance_version", F.unix_millis("computed_at"),
        "recommended_quantity", F.lit(policy.model_version),
    )
    return (
        df.withColumn(
            "reason_codes",
            reason_codes(F.col("spike_detected"), F.col("risk_level"), F.col("recommended_quantity")),
        )
        .withColumn("decision_id", uuid_v5(identity))
        .withColumn("model_version", F.lit(policy.model_version))
        .withColumn("mode", F.lit(policy.mode))
    )


def candidate_quantities(strategy: str = "cdc") -> Column:
    """Sorted distinct order quantities to compare, from the decision's columns."""
    recommended = F.col("recommended_quantity")
    if strategy == "cdc":
        values = [F.lit(q) for q in CDC_CANDIDATES] + [recommended, F.col("capacity")]
    elif strategy == "review":
        # This generator leaves incoming supply out of the capacity.
        recommended = F.greatest(recommended, F.lit(0))
        values = [
            F.lit(0),
            F.floor(recommended / 2).cast("int"),
            recommended,
            trunc_int(F.ceil(recommended * 1.25)),
            F.greatest(F.col("max_stock") - F.col("on_hand"), F.lit(0)),
        ]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    kept = F.filter(F.array(*[v.cast("int") for v in values]), lambda q: q >= 0)
    return F.array_sort(F.array_distinct(kept))


def _alternative(quantity: Column) -> Column:
    demand = F.greatest("horizon_demand_units", F.lit(0.0))
    accepted = clamp(quantity, 0, F.col("capacity"))
    position = F.col("inventory_position") + accepted
    available = F.col("available") + accepted
    short = F.greatest(demand - available, F.lit(0.0))
    excess = F.greatest(position.cast("double") - F.col("target_inventory"), F.lit(0.0))
    coverage = F.when(demand <= 0, F.lit(1.0)).otherwise(
        clamp(available / F.when(demand > 0, demand), 0.0, 1.5)
    )
    risk = (
        F.when(short <= 0, "LOW")
        .when(coverage >= 0.75, "MEDIUM")
        .when(coverage >= 0.5, "HIGH")
        .otherwise("CRITICAL")
    )
    return F.struct(
        quantity.alias("quantity"),
        position.alias("projected_inventory_position"),
        available.alias("projected_available_after_restock"),
        demand.alias("expected_horizon_demand"),
        short.alias("expected_stockout_units"),
        excess.alias("expected_excess_units"),
        coverage.alias("demand_coverage_ratio"),
        (quantity - F.col("capacity")).alias("capacity_violation_units"),
        clamp(1.0 - short / F.greatest(demand, F.lit(1.0)), 0.0, 1.0).alias("service_level_score"),
        risk.alias("risk_level"),
    )


def simulate_reorder(decisions: DataFrame, candidates: Column | None = None, strategy: str = "cdc") -> DataFrame:
    """Adds `alternatives` (one struct per candidate), the selected quantity and simulation id.

    Works inside the row: a handful of candidates per decision needs no shuffle.
    """
    candidates = candidate_quantities(strategy) if candidates is None else candidates
    df = decisions.withColumn("candidates", candidates).withColumn(
        "alternatives", F.transform("candidates", _alternative)
    )
    listed = F.concat(
        F.lit("["), F.array_join(F.transform("candidates", lambda q: q.cast("string")), ", "), F.lit("]")
    )
    identity = F.concat_ws(":", "decision_id", "balance_version", "incoming", listed)
    return df.withColumn("selected_quantity", select_quantity()).withColumn(
        "simulation_id", uuid_v5(identity)
    )


def select_quantity(alternatives: str = "alternatives", capacity: str = "capacity") -> Column:
    """Least stock-out, then least excess, then first listed; within capacity; 0 if none."""
    ranked = F.transform(
        alternatives,
        lambda a, i: F.struct(
            a["expected_stockout_units"].alias("short"), a["expected_excess_units"].alias("excess"),
            i.alias("listed"), a["quantity"].alias("quantity"),
        ),
    )
    best = F.array_min(ranked)["quantity"]
    return F.coalesce(clamp(best, 0, F.col(capacity)), F.lit(0))


def simulation_alternatives(simulated: DataFrame) -> DataFrame:
    """One row per candidate quantity."""
    # An inner generator would filter on the size of its array below all projections, with the whole decision spelled out.
    listed = simulated.select(*KEY, "simulation_id", "decision_id", F.explode_outer("alternatives").alias("_a"))
    return listed.filter(F.col("_a").isNotNull()).select(*KEY, "simulation_id", "decision_id", "_a.*")


def proposals(simulated: DataFrame) -> DataFrame:
    """Adds the proposal of the selected quantity."""
    identity = F.concat_ws(":", "decision_id", "sku_id", "location_code", "selected_quantity")
    return (
        simulated.withColumn("proposal_id", uuid_v5(identity))
        .withColumn("quantity", F.col("selected_quantity"))
        .withColumn("proposal_status", F.lit("PROPOSED"))
        .withColumn("created_at", F.col("computed_at"))
        .withColumn("correlation_id", F.col("decision_id"))
    )


def policy_gate(
    proposed: DataFrame,
    data_status: Column | None = None,
    policy: GovernancePolicy = GovernancePolicy(),
) -> DataFrame:
    """Adds the policy outcome, its reason code and id."""
    status = F.lit("FINAL") if data_status is None else data_status
    risk = F.col("risk_level")
    safe = status.isin("FINAL", "PROVISIONAL")
    reason = F.when(~safe, "DATA_NOT_EXECUTION_SAFE").when(
        F.col("quantity") <= 0, "NO_REORDER_QUANTITY"
    )
    outcome = F.when(~safe, "REQUIRES_HUMAN_APPROVAL").when(F.col("quantity") <= 0, "REJECTED")
    reason = reason.when(risk == "LOW", "LOW_RISK_AUTO_POLICY")
    outcome = outcome.when(risk == "LOW", "AUTO_APPROVED")
    allowed = {"MEDIUM": policy.allow_medium, "HIGH": policy.allow_high, "CRITICAL": policy.allow_critical}
    for level, auto in allowed.items():
        code = f"{level}_RISK_AUTO_POLICY_ENABLED" if auto else f"{level}_RISK_REQUIRES_APPROVAL"
        reason = reason.when(risk == level, code)
        outcome = outcome.when(risk == level, "AUTO_APPROVED" if auto else "REQUIRES_HUMAN_APPROVAL")
    return (
        proposed.withColumn("policy_outcome", outcome)
        .withColumn("policy_reasons", F.array(reason))
        .withColumn("policy_version", F.lit(policy.policy_version))
        .withColumn(
            "policy_decision_id",
            uuid_v5(
                F.concat_ws(":", "proposal_id", "policy_version", F.array_join("policy_reasons", ","))
            ),
        )
    )


def execution_preflight(gated: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """Adds the execution attempt: EXECUTING, or FAILED with the first failed check.

    With `balances` (sku_id, location_code, on_hand, max_stock, version) the proposal meets the
    balance of its own key as it is now; without, the row must carry `current_location_code`,
    `current_on_hand`, `current_max_stock` and `current_version`.
    """
    if balances is not None:
        current = balances.select(
            *KEY,
            F.col("location_code").alias("current_location_code"),
            F.col("on_hand").alias("current_on_hand"),
            F.col("max_stock").alias("current_max_stock"),
            F.col("version").alias("current_version"),
        )
        gated = keyed_join(gated, current, KEY, "left")
    room = F.col("current_max_stock") - F.col("current_on_hand")
    same_key = F.coalesce(
        F.col("current_location_code") == normalize_location("location_code"), F.lit(False)
    )
    problem = (
        F.when(F.col("policy_outcome") != "AUTO_APPROVED", PREFLIGHT_POLICY)
        .when(~F.col("proposal_status").isin("APPROVED", "PROPOSED"), PREFLIGHT_STATUS)
        .when(~same_key, PREFLIGHT_KEY)
        .when((F.col("quantity") <= 0) | (F.col("quantity") > room), PREFLIGHT_CAPACITY)
    )
    df = gated.withColumn("_problem", problem)
    detail = F.coalesce(F.col("_problem"), F.col("current_version").cast("string"))
    return (
        df.withColumn("attempt_status", F.when(F.col("_problem").isNull(), "EXECUTING").otherwise("FAILED"))
        .withColumn("attempt_message", F.coalesce("_problem", F.lit(PREFLIGHT_OK)))
        .withColumn("attempt_id", uuid_v5(F.concat_ws(":", "proposal_id", detail)))
        .withColumn("operation_id", F.col("proposal_id"))
        .drop("_problem")
    )


def execution_result_id(operation_id: Column, result_code: Column) -> Column:
    return uuid_v5(F.concat_ws(":", operation_id, result_code))


def escalation_filter(features: DataFrame, factor: float = 1.2) -> DataFrame:
    """Keys worth a review: a spike, or stock at most `factor` times the reorder point."""
    threshold = trunc_int(F.col("reorder_point").cast("double") * factor)
    return features.filter(F.col("spike_detected") | (F.col("on_hand") <= threshold))


def with_expiry(proposed: DataFrame, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """Adds expires_at and `expired` (only pending proposals expire)."""
    expires = F.timestamp_micros(F.unix_micros("created_at") + F.lit(ttl_seconds * 1_000_000))
    return proposed.withColumn("expires_at", expires).withColumn(
        "expired", (F.col("expires_at") < at(as_of)) & (F.col("proposal_status") == "PROPOSED")
    )


def proposal_expiry(proposed: DataFrame, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """Proposals with their expiry, newest first."""
    return with_expiry(proposed, as_of, ttl_seconds).orderBy(F.desc("created_at"), "proposal_id")


def proposal_approval(approvals: DataFrame, proposed: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Outcome of every approval request; the first valid one approves.

    `approvals` has (request_id, proposal_id, requested_at). The first request on a pending
    proposal decides it: APPROVED, or EXPIRED when it came too late. Later ones find it no longer
    pending.
    """
    first = earliest(
        approvals.select("proposal_id", "requested_at", "request_id"),
        ["proposal_id"], ["requested_at", "request_id"],
    ).select("proposal_id", F.col("request_id").alias("_first"))
    known = proposed.select("proposal_id", "proposal_status", "created_at").withColumn(
        "_expires", F.timestamp_micros(F.unix_micros("created_at") + F.lit(ttl_seconds * 1_000_000))
    )
    verdicts = first.join(known, "proposal_id", "left")
    outcome = (
        F.when(F.col("proposal_status").isNull(), "NOT_FOUND")
        .when(F.col("proposal_status") != "PROPOSED", "NOT_PENDING")
        .when(F.col("request_id") != F.col("_first"), "NOT_PENDING")
        .when(F.col("_expires") < F.col("requested_at"), "EXPIRED")
        .otherwise("APPROVED")
    )
    action = F.when(F.col("outcome") == "APPROVED", "APPROVED").when(
        F.col("outcome") == "EXPIRED", "APPROVAL_REJECTED_EXPIRED"
    )
    return (
        approvals.join(verdicts, "proposal_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("audit_action", action)
        .select("request_id", "proposal_id", "requested_at", "outcome", "audit_action")
    )
