"""From facts and balances to governed proposals, for every key in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sku_location_key
from ..model import KEY, GovernancePolicy, ReplenishmentPolicy
from ..operators.demand import RETENTION_DAYS
from ..operators.forecast import sku_features
from ..operators.replenish import (
    execution_preflight, policy_gate, proposals, reorder_decision, simulate_reorder,
)
from ..operators.recent_rate import recent_rates_at
from ..operators.state import incoming_supply


def evaluate_all(
    balances: DataFrame,
    movements: DataFrame,
    as_of,
    replenishments: DataFrame | None = None,
    policy: ReplenishmentPolicy = ReplenishmentPolicy(),
    governance: GovernancePolicy = GovernancePolicy(),
    strategy: str = "cdc",
    with_recent_rates: bool = True,
    retention_days: int | None = RETENTION_DAYS,
) -> DataFrame:
    """One row per balance key with features, decision, simulation, proposal, policy and preflight.

    `balances` is current (one row per key) and `movements` holds each fact once. Everything after
    the feature row is a projection, so decisions cost no further shuffle.
    """
    rates = recent_rates_at(movements, as_of, retention_days) if with_recent_rates else None
    features = sku_features(balances, movements, as_of, rates, retention_days=retention_days)
    if replenishments is None:
        features = features.withColumn("incoming", F.lit(0))
    else:
        features = features.join(incoming_supply(replenishments), KEY, "left").fillna(0, ["incoming"])
    decided = reorder_decision(features, policy)
    proposed = proposals(simulate_reorder(decided, strategy=strategy))
    gated = policy_gate(proposed, policy=governance)
    # The balance that was evaluated is the current one, so the preflight needs no join here.
    current = gated.withColumns(
        {
            "current_location_code": F.col("location_code"),
            "current_on_hand": F.col("on_hand"),
            "current_max_stock": F.col("max_stock"),
            "current_version": F.col("balance_version"),
        }
    )
    return execution_preflight(current).drop(
        "current_location_code", "current_on_hand", "current_max_stock", "current_version"
    )


def dashboard(evaluated: DataFrame, key: str | None = None) -> DataFrame:
    """One overview row per key, sorted by the key text; `key` picks a single one."""
    view = evaluated.select(
        sku_location_key().alias("stream_key"), *KEY, "on_hand", "reserved", "available",
        "forecast_units_per_day", "spike_detected", "risk_level", "recommended_quantity",
        F.col("quantity").alias("proposed_quantity"), "policy_outcome",
        F.size("alternatives").alias("alternatives"), "incoming",
    )
    if key is not None:
        return view.filter(F.col("stream_key") == key)
    # Sorting samples what it sorts: from this shuffle, not by evaluating every key a second time.
    return view.repartition("stream_key").orderBy("stream_key")
