"""Evaluation that follows a change stream: the keys that a batch touches, and nothing else.

A batch stores its new facts and balance changes. Keys with a new Sale or Reserve are evaluated on the days that
the features retain: other days' directories aren't opened, other keys don't pass the scan's join. What comes out is
one wide row a key, appended to a log in the batch's own directory; decisions, simulations, proposals, policy
decisions and executions are read from it, each once by its id, and the newest row of a key is its current
evaluation. A batch that runs again writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import KEY, GovernancePolicy, ReplenishmentPolicy
from ..operators.decode import balances_of, decode_changes, movements_of
from ..operators.demand import RETENTION_DAYS
from ..operators.keyed import earliest, latest
from ..plans.evaluation import evaluate_all
from ..sources.serving import ServingTable
from .dedup import store_first, stored_days
from .jobs import balance_delta, balance_table, fact_table, metrics_table, start

EVALUATED_TYPES = ("Sale", "Reserve")
AUTO_APPROVED = "AUTO_APPROVED"
_RECORDS = {
    "decisions": ("decision_id", [
        "decision_id", *KEY, "computed_at", "balance_version", "recommended_quantity", "target_inventory", "inventory_position",
        "risk_level", "reason_codes", "estimated_stockout_at", "model_version", "mode",
    ]),
    "simulations": ("simulation_id", ["simulation_id", "decision_id", *KEY, "computed_at", "candidates", "alternatives", "selected_quantity"]),
    "proposals": ("proposal_id", ["proposal_id", "decision_id", *KEY, "quantity", "proposal_status", "created_at", "correlation_id"]),
    "policy_decisions": ("policy_decision_id", ["policy_decision_id", "proposal_id", *KEY, "policy_outcome", "policy_reasons", "policy_version"]),
    "executions": ("attempt_id", ["attempt_id", "operation_id", "proposal_id", *KEY, "attempt_status", "attempt_message"]),
}


class EvaluationTables:
    """Facts, current balances, the log of evaluations and the job's counts."""

    def __init__(self, spark: SparkSession, root: str):
        root = root.rstrip("/")
        self.facts, self.balances = fact_table(spark, f"{root}/facts"), balance_table(spark, f"{root}/balances")
        self.metrics = metrics_table(spark, f"{root}/metrics")
        self.log = ServingTable(spark, f"{root}/evaluations", lambda rows: rows, _newest_of_each_key)

    def newest(self) -> DataFrame | None:
        """The current evaluation of every key evaluated so far."""
        rows = self.log.read()
        return None if rows is None else rows.drop("number")

    def records(self, kind: str) -> DataFrame | None:
        """All decisions, simulations, proposals, policy_decisions or executions, each once."""
        identity, columns = _RECORDS[kind]
        rows = self.log.deltas()
        if rows is None:
            return None
        if kind == "executions":  # only what the policy lets run is tried
            rows = rows.filter(F.col("policy_outcome") == AUTO_APPROVED)
        return earliest(rows.filter(F.col(identity).isNotNull()), [identity], ["number"]).select(*columns)

    def counts(self) -> dict[str, int]:
        rows = self.metrics.read()
        return {} if rows is None else {r["metric"]: r["value"] for r in rows.collect()}


def _newest_of_each_key(rows: DataFrame) -> DataFrame:
    return latest(rows, KEY, ["number"])


def _retained_days(as_of: datetime, days: int) -> list[str]:
    return [(as_of - timedelta(days=n)).strftime("%Y-%m-%d") for n in range(days + 1)]


def evaluate_touched(
    tables: EvaluationTables, touched: DataFrame, as_of: datetime, batch_id: int, retention_days: int = RETENTION_DAYS, **how
) -> DataFrame | None:
    """Evaluates the touched keys on what is stored up to the batch; keys without a balance have no evaluation."""
    stored = stored_days(tables.facts, _retained_days(as_of, retention_days), batch_id + 1)
    balances = tables.balances.deltas(batch_id + 1)
    if stored is None or balances is None:
        return None
    own = balances.join(touched, KEY, "left_semi")
    near = tables.facts.combine(stored.join(touched, KEY, "left_semi")).drop("batch", "day")
    current = tables.balances.render(own).drop("batch", "operation")
    return evaluate_all(current, near, as_of.isoformat(sep=" "), retention_days=retention_days, **how)


def keep_evaluations(
    log: DataFrame,
    tables: EvaluationTables,
    checkpoint: str,
    as_of: datetime | None = None,
    evaluated_types: Sequence[str] = EVALUATED_TYPES,
    on_balance: bool = False,
    replenishments: DataFrame | None = None,
    policy: ReplenishmentPolicy = ReplenishmentPolicy(),
    governance: GovernancePolicy = GovernancePolicy(),
    **how,
) -> StreamingQuery:
    """Change log -> facts, balances and the evaluation of each key that a new fact of evaluated_types names.

    as_of: the instant of evaluation, the newest record time of a batch if not given, so a retried batch evaluates at
    the same instant. on_balance: also evaluate keys whose balance changed; without it a new balance waits for its
    key's next sale or reservation. Counts of each batch are taken while its rows are written.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        decoded = decode_changes(df).persist()
        try:
            fresh = store_first(movements_of(decoded), tables.facts, ["movement_id"], "occurred_at", batch_id, ["partition", "offset"])
            changed = tables.balances.write_batch(balance_delta(balances_of(decoded)), batch_id)
            instant = as_of or decoded.agg(F.max("timestamp")).first()[0]
        finally:
            decoded.unpersist()
        counts = {}
        touched = fresh.filter(F.col("movement_type").isin(list(evaluated_types))).select(*KEY)
        touched = (touched.unionByName(changed.select(*KEY)) if on_balance else touched).distinct()
        rows = None
        if instant is not None:
            rows = evaluate_touched(tables, touched, instant, batch_id, replenishments=replenishments, policy=policy, governance=governance)
        if rows is not None:
            seen = Observation(f"evaluations-{batch_id}")
            rows = rows.withColumn("number", F.lit(batch_id).cast("long"))
            tables.log.write_batch(rows.observe(seen, *_counters()), batch_id)
            counts = seen.get
        listed = [(name, int(n or 0)) for name, n in sorted(counts.items())]
        tables.metrics.write_batch(spark.createDataFrame(listed, "metric string, value long"), batch_id)

    return start(log, handle, checkpoint, **how)


def _counters() -> list:
    tried = F.col("policy_outcome") == AUTO_APPROVED
    return [
        F.count("decision_id").alias("decisions"),
        F.count("simulation_id").alias("simulations"),
        F.count("proposal_id").alias("proposals"),
        F.count("policy_decision_id").alias("policy_decisions"),
        F.count_if(tried & (F.col("attempt_status") == "EXECUTING")).alias("executions"),
        F.count_if(tried & (F.col("attempt_status") == "FAILED")).alias("execution_failures"),
    ]
