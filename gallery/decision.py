"""Forecasts, decisions, simulation, governance: from the feature row to the proposal."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.model import KEY, GovernancePolicy
from shelfwise.operators import forecast as f
from shelfwise.operators import guard, replenish
from shelfwise.operators.demand import demand_model
from shelfwise.operators.keyed import keyed_join
from shelfwise.operators.recent_rate import recent_rates_at
from shelfwise.plans.evaluation import dashboard, evaluate_all

from .demand import HOURLY, RATE_SQL, WINDOW_SQL, fold_sql
from .registry import query
from .state import REPLENISHMENT_SQL, replenishments
from .views import AS_OF, loc, sql_loc

T = f"TIMESTAMP '{AS_OF}'"
STAMP = "%Y-%m-%d %H:%M:%S.%f"
VIEWS = "v_live v_balance"


def sql_uuid(text: str) -> str:
    h = f"sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode({text}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


RATES = f"""ticked AS (SELECT * FROM v_live WHERE occurred_at <= {T} AND CAST(occurred_at AS DATE) >= CAST({T} AS DATE) - 8),
{RATE_SQL},
rate_history AS (SELECT sku_id, location_code, arg_max(ewma, samples) AS ewma, max(tick_at) AS last_at, max(samples) AS samples
  FROM chain GROUP BY sku_id, location_code),
w AS ({WINDOW_SQL}),
rates AS (SELECT r.sku_id, r.location_code, r.samples, r.last_at,
    CASE WHEN {T} - last_at >= INTERVAL 1 MINUTE THEN CASE WHEN ewma = 0 THEN now_rate ELSE 0.35::DOUBLE * now_rate + 0.65::DOUBLE * ewma END
         ELSE ewma END AS ewma
  FROM (SELECT h.*, coalesce(0.55::DOUBLE * sale_units_5m * 288 + 0.30::DOUBLE * sale_units_15m * 96 + 0.15::DOUBLE * sale_units_1h * 24, 0) AS now_rate
        FROM rate_history h LEFT JOIN w USING (sku_id, location_code)) r)"""

MODEL = f"""{HOURLY}, wd AS (SELECT *, isodow(date) - 1 AS weekday FROM daily), hp AS (SELECT * FROM hourly WHERE units > 0),
{fold_sql('wd', 'sku_id, location_code, weekday', 'date', 'units', 'w')},
{fold_sql('hp', 'sku_id, location_code, hour', 'date', 'units', 'h')}"""

FEATURES = f"""{MODEL}, {RATES},
base_features AS (SELECT b.*, coalesce(reserve_units_5m, 0) AS reserve_units_5m, coalesce(sale_units_5m, 0) AS sale_units_5m,
    coalesce(sale_units_15m, 0) AS sale_units_15m, coalesce(sale_units_1h, 0) AS sale_units_1h, coalesce(daily_sales, 0) AS daily_sales,
    0.55::DOUBLE * (coalesce(sale_units_5m, 0) * 288.0::DOUBLE) + 0.30::DOUBLE * (coalesce(sale_units_15m, 0) * 96.0::DOUBLE)
      + 0.15::DOUBLE * (coalesce(sale_units_1h, 0) * 24.0::DOUBLE) AS live, coalesce(r.ewma, 0) AS ewma
  FROM v_balance b LEFT JOIN w USING (sku_id, location_code) LEFT JOIN rates r USING (sku_id, location_code)),
points AS (SELECT bf.sku_id, bf.location_code, d.day, {T} + to_days(CAST(d.day AS INTEGER)) AS instant,
    CASE WHEN live > 0 THEN live ELSE ewma END AS recent, coalesce(sqrt(greatest(ws.variance, 0)), 0) AS stddev,
    greatest(CASE WHEN ws.n > 0 AND hs.n > 0 THEN 0.65::DOUBLE * ws.mean + 0.35::DOUBLE * (hs.mean * 24) WHEN ws.n > 0 THEN ws.mean
         WHEN hs.n > 0 THEN hs.mean * 24 ELSE 12.0::DOUBLE END, 0) AS baseline
  FROM base_features bf CROSS JOIN range(7) AS d(day)
  LEFT JOIN wlast ws ON ws.sku_id = bf.sku_id AND ws.location_code = bf.location_code
    AND ws.weekday = isodow({T} + to_days(CAST(d.day AS INTEGER))) - 1
  LEFT JOIN hlast hs ON hs.sku_id = bf.sku_id AND hs.location_code = bf.location_code AND hs.hour = hour({T})),
scored AS (SELECT *, recent / greatest(baseline, 0.1::DOUBLE) AS ratio,
    greatest((recent - baseline) / greatest(stddev, 1.0::DOUBLE), 0) AS score FROM points),
forecasts AS (SELECT *, greatest((1.0::DOUBLE - weight) * baseline + weight * recent, 0) AS forecast, ratio >= 2 AND score >= 2 AS spike
  FROM (SELECT *, CASE WHEN recent <= 0 THEN 0.0::DOUBLE
      ELSE least(greatest(0.2::DOUBLE + greatest(ratio - 1.25::DOUBLE, 0) * 0.2::DOUBLE, 0.2::DOUBLE), 0.85::DOUBLE) END AS weight FROM scored)),
features AS (SELECT bf.*, n.baseline, n.recent, n.forecast, n.stddev, n.ratio, n.score, n.spike, h.demand
  FROM base_features bf JOIN (SELECT * FROM forecasts WHERE day = 0) n USING (sku_id, location_code)
  JOIN (SELECT sku_id, location_code, (max(CASE WHEN day = 0 THEN forecast END) + max(CASE WHEN day = 1 THEN forecast END))
          + max(CASE WHEN day = 2 THEN forecast END) AS demand FROM forecasts GROUP BY ALL) h USING (sku_id, location_code))"""

DECISIONS = f"""{FEATURES}, {REPLENISHMENT_SQL},
d1 AS (SELECT x.*, coalesce(i.incoming, 0) AS incoming, on_hand - reserved + coalesce(i.incoming, 0) AS position,
    greatest(CAST(ceil(1.65::DOUBLE * stddev * sqrt(2.0::DOUBLE)) AS INTEGER), safety_stock) AS safety,
    greatest(max_stock - on_hand - coalesce(i.incoming, 0), 0) AS capacity,
    CASE WHEN forecast > 0 THEN greatest(available, 0) / forecast * 24 END AS hours
  FROM features x LEFT JOIN incoming_supply i USING (sku_id, location_code)),
d2 AS (SELECT *, CAST(least(greatest(CAST(ceil(demand) AS INTEGER) + safety, 0), max_stock) AS INTEGER) AS target,
    CASE WHEN hours <= 24 THEN 'CRITICAL' WHEN hours <= 48 THEN 'HIGH' WHEN hours <= 96 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d1),
d3 AS (SELECT *, CAST(least(greatest(target - position, 0), capacity) AS INTEGER) AS recommended FROM d2),
decisions AS (SELECT *, {sql_uuid("sku_id || ':' || location_code || ':' || version || ':' || epoch_ms(" + T + ") || ':' || recommended || ':adaptive-ewma-seasonal-v1'")} AS decision_id,
    concat_ws('|', CASE WHEN spike THEN 'DEMAND_SPIKE' END, CASE WHEN risk IN ('HIGH', 'CRITICAL') THEN 'STOCKOUT_BEFORE_OR_NEAR_LEAD_TIME' END,
      CASE WHEN recommended > 0 THEN 'INVENTORY_POSITION_BELOW_ADAPTIVE_TARGET' ELSE 'INVENTORY_POSITION_SUFFICIENT' END) AS reasons FROM d3)"""

SIMULATED = f"""{DECISIONS},
c1 AS (SELECT *, list_sort(list_distinct(list_filter([20, recommended, 81, 150, capacity], lambda q: q >= 0))) AS candidates FROM decisions),
alts AS (SELECT sku_id, location_code, decision_id, q AS quantity, listed, position, available, capacity, target, demand,
    position + least(greatest(q, 0), capacity) AS projected_position, available + least(greatest(q, 0), capacity) AS projected_available,
    greatest(demand - (available + least(greatest(q, 0), capacity)), 0) AS short,
    greatest((position + least(greatest(q, 0), capacity))::DOUBLE - target, 0) AS excess
  FROM (SELECT *, unnest(candidates) AS q, generate_subscripts(candidates, 1) AS listed FROM c1)),
alternatives AS (SELECT *, CASE WHEN short <= 0 THEN 'LOW' WHEN coverage >= 0.75 THEN 'MEDIUM' WHEN coverage >= 0.5 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
  FROM (SELECT *, CASE WHEN demand <= 0 THEN 1.0::DOUBLE ELSE least(greatest(projected_available / demand, 0), 1.5::DOUBLE) END AS coverage,
    least(greatest(1.0::DOUBLE - short / greatest(demand, 1), 0), 1) AS service FROM alts)),
chosen AS (SELECT sku_id, location_code, CAST(least(greatest(arg_min(quantity, (short, excess, listed)), 0), any_value(capacity)) AS INTEGER) AS selected
  FROM alternatives GROUP BY sku_id, location_code),
simulated AS (SELECT c1.*, selected,
    {sql_uuid("decision_id || ':' || version || ':' || incoming || ':[' || array_to_string(candidates, ', ') || ']'")} AS simulation_id
  FROM c1 JOIN chosen USING (sku_id, location_code)),
proposed AS (SELECT *, {sql_uuid("decision_id || ':' || sku_id || ':' || location_code || ':' || selected")} AS proposal_id FROM simulated)"""


def _gate_sql(source: str, status: str, auto: str) -> str:
    """outcome and reason for `source`; `auto` lists the levels that may run on their own."""
    levels = [x.strip("'") for x in auto.split(",") if x]
    enabled = ", ".join(f"'{x}'" for x in levels) or "'-'"
    return f"""(SELECT *, {sql_uuid("proposal_id || ':replenishment-governance-v1:' || reason")} AS policy_decision_id FROM (
   SELECT *, CASE WHEN {status} NOT IN ('FINAL', 'PROVISIONAL') THEN 'REQUIRES_HUMAN_APPROVAL' WHEN selected <= 0 THEN 'REJECTED'
      WHEN risk = 'LOW' OR risk IN ({enabled}) THEN 'AUTO_APPROVED' ELSE 'REQUIRES_HUMAN_APPROVAL' END AS outcome,
    CASE WHEN {status} NOT IN ('FINAL', 'PROVISIONAL') THEN 'DATA_NOT_EXECUTION_SAFE' WHEN selected <= 0 THEN 'NO_REORDER_QUANTITY'
      WHEN risk = 'LOW' THEN 'LOW_RISK_AUTO_POLICY' WHEN risk IN ({enabled}) THEN risk || '_RISK_AUTO_POLICY_ENABLED'
      ELSE risk || '_RISK_REQUIRES_APPROVAL' END AS reason FROM {source}))"""


def rates(v):
    return recent_rates_at(v.live, AS_OF)


def features(v):
    return f.sku_features(v.balances, v.live, AS_OF, rates(v))


def evaluated(v, **kwargs):
    return evaluate_all(v.balances, v.live, AS_OF, replenishments(v), **kwargs)


@query(
    "recent_rate_at_evaluation",
    f"""WITH RECURSIVE {RATES} SELECT sku_id, location_code, round(ewma, 6) AS recent_rate_ewma, samples,
       strftime(last_at, '{STAMP}') AS last_sample_at FROM rates""",
    "v_live",
)
def recent_rate_at_evaluation(v):
    return rates(v)


@query(
    "seasonal_baseline",
    f"""WITH RECURSIVE {MODEL}, keys AS (SELECT DISTINCT sku_id, location_code FROM hourly)
       SELECT k.sku_id, k.location_code, CAST(d.day AS INTEGER) AS day, round(CASE WHEN ws.n > 0 AND hs.n > 0
         THEN 0.65::DOUBLE * ws.mean + 0.35::DOUBLE * (hs.mean * 24) WHEN ws.n > 0 THEN ws.mean
         WHEN hs.n > 0 THEN hs.mean * 24 ELSE 12.0::DOUBLE END, 6) AS baseline
       FROM keys k CROSS JOIN range(7) AS d(day)
       LEFT JOIN wlast ws ON ws.sku_id = k.sku_id AND ws.location_code = k.location_code AND ws.weekday = d.day
       LEFT JOIN hlast hs ON hs.sku_id = k.sku_id AND hs.location_code = k.location_code AND hs.hour = 12""",
    "v_live",
)
def seasonal_baseline(v):
    model = demand_model(v.live, AS_OF)
    days = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda d: F.struct(
            d.alias("day"), f.baseline(F.get("weekday_stats", d), F.get("hour_stats", F.lit(12))).alias("baseline")
        ),
    )
    return model.select(*KEY, F.inline(days))


FORECAST_COLUMNS = """round(baseline, 6) AS baseline_units_per_day, round(recent, 6) AS recent_units_per_day,
  round(forecast, 6) AS forecast_units_per_day, round(stddev, 6) AS historical_stddev_units_per_day,
  round(ratio, 6) AS recent_vs_baseline_ratio, round(score, 6) AS spike_score, spike AS spike_detected"""


@query(
    "adaptive_forecast",
    f"WITH RECURSIVE {FEATURES} SELECT sku_id, location_code, {FORECAST_COLUMNS} FROM features",
    VIEWS,
)
def adaptive_forecast(v):
    return features(v).select(*KEY, *f.FORECAST_FIELDS)


@query(
    "forecast_horizon",
    f"""WITH RECURSIVE {FEATURES} SELECT sku_id, location_code, strftime(instant, '%Y-%m-%d') AS date, upper(strftime(instant, '%a')) AS weekday,
       round(forecast, 6) AS forecast_units, round(baseline, 6) AS baseline_units, round(recent, 6) AS recent_units,
       spike AS spike_detected FROM forecasts""",
    VIEWS,
)
def forecast_horizon(v):
    return features(v).select(*KEY, F.inline("horizon"))


@query(
    "sku_features",
    f"""WITH RECURSIVE {FEATURES} SELECT sku_id, location_code, strftime({T}, '{STAMP}') AS computed_at, on_hand, reserved, available,
       version AS balance_version, safety_stock, reorder_point, max_stock, reserve_units_5m, sale_units_5m, sale_units_15m, sale_units_1h,
       sale_units_5m * 288.0::DOUBLE AS sale_velocity_5m, sale_units_15m * 96.0::DOUBLE AS sale_velocity_15m,
       sale_units_1h * 24.0::DOUBLE AS sale_velocity_1h, daily_sales, {FORECAST_COLUMNS} FROM features""",
    VIEWS,
)
def sku_features(v):
    return features(v).drop("horizon")


@query(
    "reorder_decisions",
    f"""WITH RECURSIVE {DECISIONS} SELECT decision_id, sku_id, location_code, incoming, position AS inventory_position, safety AS decision_safety_stock,
       round(demand, 6) AS horizon_demand_units, target AS target_inventory, capacity, recommended AS recommended_quantity,
       round(hours, 6) AS stockout_hours, risk AS risk_level,
       strftime({T} + to_milliseconds(CAST(floor(hours * 3600000.0::DOUBLE) AS BIGINT)), '{STAMP}') AS estimated_stockout_at, reasons AS reason_codes
       FROM decisions""",
    VIEWS,
)
def reorder_decisions(v):
    return evaluated(v).select(
        "decision_id", *KEY, "incoming", "inventory_position", "decision_safety_stock", "horizon_demand_units",
        "target_inventory", "capacity", "recommended_quantity", "stockout_hours", "risk_level",
        "estimated_stockout_at", "reason_codes",
    )


@query(
    "risk_and_reason_counts",
    f"WITH RECURSIVE {DECISIONS} SELECT risk AS risk_level, reasons AS reason_codes, count(*) AS rows FROM decisions GROUP BY ALL",
    VIEWS,
)
def risk_and_reason_counts(v):
    return (
        evaluated(v)
        .groupBy("risk_level", F.array_join("reason_codes", "|").alias("reason_codes"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "review_candidate_quantities",
    f"""WITH RECURSIVE {DECISIONS} SELECT sku_id, location_code, array_to_string(list_sort(list_distinct([0, recommended // 2, recommended,
       CAST(ceil(recommended * 1.25::DOUBLE) AS INTEGER), greatest(max_stock - on_hand, 0)])), '|') AS candidates FROM decisions""",
    VIEWS,
)
def review_candidate_quantities(v):
    return evaluated(v, strategy="review").select(*KEY, "candidates")


@query(
    "simulation_alternatives",
    f"""WITH RECURSIVE {SIMULATED} SELECT a.sku_id, a.location_code, simulation_id, a.decision_id, quantity,
       projected_position AS projected_inventory_position, projected_available AS projected_available_after_restock,
       round(a.demand, 6) AS expected_horizon_demand, round(short, 6) AS expected_stockout_units, round(excess, 6) AS expected_excess_units,
       round(coverage, 6) AS demand_coverage_ratio, quantity - a.capacity AS capacity_violation_units,
       round(service, 6) AS service_level_score, a.risk_level FROM alternatives a JOIN simulated s USING (sku_id, location_code)""",
    VIEWS,
)
def simulation_alternatives(v):
    return replenish.simulation_alternatives(evaluated(v))


@query(
    "proposals",
    f"""WITH RECURSIVE {SIMULATED} SELECT proposal_id, decision_id, simulation_id, sku_id, location_code, selected AS quantity,
       'PROPOSED' AS proposal_status, strftime({T}, '{STAMP}') AS created_at, decision_id AS correlation_id,
       array_to_string(candidates, '|') AS candidates FROM proposed""",
    VIEWS,
)
def proposals(v):
    return evaluated(v).select(
        "proposal_id", "decision_id", "simulation_id", *KEY, "quantity", "proposal_status", "created_at",
        "correlation_id", "candidates",
    )


STATUS_SQL = "(['FINAL', 'PROVISIONAL', 'STALE', 'UNRECONCILED'])[sku_id % 4 + 1]"


def data_status():
    return F.element_at(
        F.array(*[F.lit(x) for x in ("FINAL", "PROVISIONAL", "STALE", "UNRECONCILED")]), F.col("sku_id") % 4 + 1
    )


@query(
    "policy_gate",
    f"""WITH RECURSIVE {SIMULATED} SELECT policy_decision_id, proposal_id, outcome AS policy_outcome, reason AS policy_reasons
       FROM {_gate_sql('proposed', STATUS_SQL, '')}""",
    VIEWS,
)
def policy_gate(v):
    return replenish.policy_gate(evaluated(v), data_status()).select(
        "policy_decision_id", "proposal_id", "policy_outcome", "policy_reasons"
    )


@query(
    "policy_gate_with_automation",
    f"""WITH RECURSIVE {SIMULATED} SELECT policy_decision_id, proposal_id, outcome AS policy_outcome, reason AS policy_reasons
       FROM {_gate_sql('proposed', "'FINAL'", "'HIGH','CRITICAL'")}""",
    VIEWS,
)
def policy_gate_with_automation(v):
    auto = GovernancePolicy(allow_high=True, allow_critical=True)
    return evaluated(v, governance=auto).select(
        "policy_decision_id", "proposal_id", "policy_outcome", "policy_reasons"
    )


def changed_balances(v):
    """Stock moved on since the evaluation."""
    return v.balances.withColumn("on_hand", F.col("on_hand") + F.col("sku_id") % 40).withColumn(
        "version", F.col("version") + 1
    )


PREFLIGHT_SQL = f"""SELECT CASE WHEN problem IS NULL THEN 'EXECUTING' ELSE 'FAILED' END AS attempt_status, proposal_id,
   coalesce(problem, 'execution validated') AS attempt_message, {sql_uuid("proposal_id || ':' || coalesce(problem, CAST(version + 1 AS VARCHAR))")} AS attempt_id
 FROM (SELECT *, CASE WHEN outcome <> 'AUTO_APPROVED' THEN 'policy does not allow automatic execution'
     WHEN sku_id % 13 = 0 THEN 'proposal is not executable'
     WHEN sku_id % 11 = 0 THEN 'proposal does not match current inventory key'
     WHEN selected <= 0 OR selected > max_stock - (on_hand + sku_id % 40) THEN 'proposal quantity exceeds current capacity' END AS problem
   FROM {_gate_sql('proposed', "'FINAL'", "'HIGH','CRITICAL'")})"""


@query("execution_preflight", f"WITH RECURSIVE {SIMULATED} {PREFLIGHT_SQL}", VIEWS)
def execution_preflight(v):
    auto = GovernancePolicy(allow_high=True, allow_critical=True)
    gated = evaluated(v, governance=auto).drop("attempt_status", "attempt_message", "attempt_id", "operation_id")
    gated = gated.withColumn(
        "proposal_status", F.when(F.col("sku_id") % 13 == 0, "REJECTED").otherwise("PROPOSED")
    )
    current = changed_balances(v).select(
        *KEY,
        F.when(F.col("sku_id") % 11 == 0, "ELSEWHERE").otherwise(F.col("location_code")).alias("current_location_code"),
        F.col("on_hand").alias("current_on_hand"), F.col("max_stock").alias("current_max_stock"),
        F.col("version").alias("current_version"),
    )
    return replenish.execution_preflight(keyed_join(gated, current, KEY)).select(
        "attempt_status", "proposal_id", "attempt_message", "attempt_id"
    )


@query(
    "escalations",
    f"""WITH RECURSIVE {FEATURES} SELECT sku_id, location_code, on_hand, reorder_point, spike AS spike_detected FROM features
       WHERE spike OR on_hand - sku_id % 90 <= CAST(floor(reorder_point * 1.2::DOUBLE) AS INTEGER)""",
    VIEWS,
)
def escalations(v):
    lowered = features(v).withColumn("_kept", F.col("on_hand")).withColumn("on_hand", F.col("on_hand") - F.col("sku_id") % 90)
    return replenish.escalation_filter(lowered).select(
        *KEY, F.col("_kept").alias("on_hand"), "reorder_point", "spike_detected"
    )


@query(
    "full_evaluation",
    f"""WITH RECURSIVE {SIMULATED} SELECT sku_id, location_code, on_hand, available, {FORECAST_COLUMNS}, round(demand, 6) AS horizon_demand_units,
       target AS target_inventory, recommended AS recommended_quantity, risk AS risk_level, reasons AS reason_codes, incoming,
       selected AS selected_quantity, decision_id, simulation_id, proposal_id, outcome AS policy_outcome,
       CASE WHEN outcome = 'AUTO_APPROVED' AND selected > 0 AND selected <= max_stock - on_hand THEN 'EXECUTING' ELSE 'FAILED' END AS attempt_status
       FROM {_gate_sql('proposed', "'FINAL'", '')}""",
    VIEWS,
)
def full_evaluation(v):
    return evaluated(v).select(
        *KEY, "on_hand", "available", *f.FORECAST_FIELDS, "horizon_demand_units", "target_inventory",
        "recommended_quantity", "risk_level", "reason_codes", "incoming", "selected_quantity", "decision_id",
        "simulation_id", "proposal_id", "policy_outcome", "attempt_status",
    )


@query(
    "dashboard",
    f"""WITH RECURSIVE {SIMULATED} SELECT sku_id || ':' || location_code AS stream_key, sku_id, location_code, on_hand, reserved, available,
       round(forecast, 6) AS forecast_units_per_day, spike AS spike_detected, risk AS risk_level, recommended AS recommended_quantity,
       selected AS proposed_quantity, outcome AS policy_outcome, CAST(len(candidates) AS INTEGER) AS alternatives, incoming
       FROM {_gate_sql('proposed', "'FINAL'", '')}""",
    VIEWS,
)
def dashboard_query(v):
    return dashboard(evaluated(v))


def external_decisions(v):
    """Decisions as an outside adviser might word them, good and bad."""
    n = F.col("sku_id")
    words = ["reorder now", " Restock ", "WAIT", "please review", "PURCHASE_NOW", "Reorder", "wait a week", "REORDER", "review"]
    action = F.element_at(F.array(*[F.lit(w) for w in words]), n % 9 + 1)
    return v.balances.withColumns(
        {
            "action": action,
            "reorder_quantity": (F.when(n % 17 == 0, -5).when(n % 4 == 0, 0).otherwise(n % 120)).cast("int"),
            "confidence": (n % 23) / F.lit(20.0),
            "summary": F.when(n % 29 == 0, "  ").otherwise("stock is low"),
            "key_points": F.when(n % 31 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("demand"))),
            "risk_level": F.when(n % 2 == 0, "Low").otherwise("HIGH"),
            "on_hand": F.when(n % 3 == 0, 5).otherwise(F.col("on_hand")),
            "available": F.when(n % 3 == 0, 1).otherwise(F.col("available")),
        }
    )


EXTERNAL_SQL = """ext AS (SELECT sku_id AS n, sku_id, location_code, max_stock, safety_stock,
   (['reorder now', ' Restock ', 'WAIT', 'please review', 'PURCHASE_NOW', 'Reorder', 'wait a week', 'REORDER', 'review'])[sku_id % 9 + 1] AS action,
   CASE WHEN sku_id % 17 = 0 THEN -5 WHEN sku_id % 4 = 0 THEN 0 ELSE sku_id % 120 END AS q, (sku_id % 23) / 20.0::DOUBLE AS confidence,
   sku_id % 29 = 0 AS blank, sku_id % 31 = 0 AS pointless, CASE WHEN sku_id % 2 = 0 THEN 'Low' ELSE 'HIGH' END AS risk_level,
   CASE WHEN sku_id % 3 = 0 THEN 5 ELSE on_hand END AS on_hand, CASE WHEN sku_id % 3 = 0 THEN 1 ELSE available END AS available FROM v_balance),
g1 AS (SELECT *, greatest(max_stock - on_hand, 0) AS capacity, CASE WHEN upper(action) LIKE '%REORDER%' OR upper(action) LIKE '%RESTOCK%' THEN 'REORDER'
   WHEN upper(action) LIKE '%WAIT%' THEN 'WAIT' WHEN upper(action) LIKE '%REVIEW%' THEN 'REVIEW' END AS act FROM ext),
g2 AS (SELECT *, act IS NULL OR NOT confidence BETWEEN 0 AND 1 OR blank OR pointless AS bad, act IS NOT NULL AND ((act <> 'REORDER' AND q > 0) OR q < 0) AS early FROM g1),
g3 AS (SELECT *, NOT bad AND NOT early AND (on_hand <= 0 OR available <= 0 OR on_hand <= safety_stock) AND upper(risk_level) = 'LOW' AS raised FROM g2)"""


@query(
    "guarded_decisions",
    f"""WITH {EXTERNAL_SQL} SELECT sku_id, location_code,
       CASE WHEN bad THEN 'REJECTED' WHEN early OR q > capacity OR least(q, capacity) > 60 THEN 'CLAMPED' ELSE 'PASSED' END AS guard_outcome,
       CASE WHEN act IS NULL THEN 'invalid action ''' || action || '''; must be REORDER, WAIT, or REVIEW'
         WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence ' || CAST(confidence AS VARCHAR) || ' out of [0.0, 1.0]'
         WHEN blank THEN 'summary is empty' WHEN pointless THEN 'key_points array is empty'
         WHEN act <> 'REORDER' AND q > 0 THEN 'action is ' || act || ' but proposed quantity was ' || q || '; clamped to 0'
         WHEN q < 0 THEN 'negative quantity ' || q || ' clamped to 0'
         WHEN least(q, capacity) > 60 THEN 'quantity ' || q || ' exceeded max order budget limit 60; clamped'
         WHEN q > capacity THEN 'quantity ' || q || ' exceeded available capacity ' || capacity || ' (max_stock ' || max_stock
           || ' - on_hand ' || on_hand || '); clamped to capacity' END AS guard_reason,
       CASE WHEN NOT bad THEN act END AS guarded_action, CAST(CASE WHEN bad THEN q WHEN early THEN 0 ELSE least(q, capacity, 60) END AS INTEGER) AS guarded_quantity,
       raised AS risk_elevated, CASE WHEN raised THEN 'MEDIUM' ELSE risk_level END AS guarded_risk,
       CASE WHEN raised THEN 2 WHEN pointless THEN 0 ELSE 1 END AS points FROM g3""",
    "v_balance",
)
def guarded_decisions(v):
    return guard.guard_decisions(external_decisions(v), max_quantity=60).select(
        *KEY, "guard_outcome", "guard_reason", "guarded_action", "guarded_quantity", "risk_elevated", "guarded_risk",
        F.size("guarded_points").alias("points"),
    )


def decision_texts(v):
    n = F.col("event_id")
    body = F.concat(
        F.lit('{"action":"REORDER","reorder_quantity":'), F.when(n % 7 == 0, F.lit('"12"')).otherwise((n % 90).cast("string")),
        F.lit(',"urgency":"now","risk_level":"HIGH","summary":"'), F.when(n % 11 == 0, "").otherwise("low stock"),
        F.lit('","key_points":'), F.when(n % 13 == 0, "[]").otherwise('["a","b"]'),
        F.lit(',"confidence":'), F.when(n % 5 == 0, F.lit("1.5")).otherwise(F.lit("0.75")),
        F.when(n % 17 == 0, "").otherwise("}"),
    )
    fenced = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        n % 3 == 1, F.concat(F.lit(" ```"), body, F.lit("```"))
    ).otherwise(body)
    return v.table("events").select(n.alias("event_id"), fenced.alias("text"))


@query(
    "parsed_decision_texts",
    """SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 7 = 0 THEN 'MALFORMED'
         WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 5 = 0 THEN 'INVALID' END AS parse_error,
       CASE WHEN parse_error IS NULL THEN 'REORDER' END AS action, CASE WHEN parse_error IS NULL THEN CAST(event_id % 90 AS INTEGER) END AS reorder_quantity,
       CASE WHEN parse_error IS NULL THEN 'low stock' END AS summary, CASE WHEN parse_error IS NULL THEN 'a|b' END AS key_points,
       CASE WHEN parse_error IS NULL THEN 0.75::DOUBLE END AS confidence FROM events""",
)
def parsed_decision_texts(v):
    return guard.parse_decision_json(decision_texts(v), "text").select(
        "event_id", "parse_error", "action", "reorder_quantity", "summary", "key_points", "confidence"
    )


def stored_proposals(v):
    n = F.col("event_id")
    return v.table("events").select(
        F.concat(F.lit("p-"), n).alias("proposal_id"), F.col("ts").alias("created_at"),
        F.when(n % 4 == 0, "APPROVED").when(n % 9 == 0, "FAILED").otherwise("PROPOSED").alias("proposal_status"),
        loc(n).alias("location_code"),
    )


PROPOSAL_SQL = f"""stored AS (SELECT 'p-' || event_id AS proposal_id, ts AS created_at, {sql_loc('event_id')} AS location_code,
   CASE WHEN event_id % 4 = 0 THEN 'APPROVED' WHEN event_id % 9 = 0 THEN 'FAILED' ELSE 'PROPOSED' END AS proposal_status FROM events)"""


@query(
    "proposal_expiry",
    f"""WITH {PROPOSAL_SQL} SELECT proposal_id, location_code, proposal_status, strftime(created_at, '{STAMP}') AS created_at,
       strftime(created_at + INTERVAL 1 HOUR, '{STAMP}') AS expires_at,
       created_at + INTERVAL 1 HOUR < {T} AND proposal_status = 'PROPOSED' AS expired FROM stored""",
)
def proposal_expiry(v):
    return replenish.proposal_expiry(stored_proposals(v), AS_OF)


@query(
    "proposal_approval",
    f"""WITH {PROPOSAL_SQL}, req AS (SELECT 'a-' || event_id AS request_id, 'p-' || (CASE WHEN event_id % 10 = 7 THEN event_id + 1000000000 ELSE event_id - event_id % 3 END) AS proposal_id,
         ts + to_minutes(event_id % 50) AS requested_at FROM events),
       ranked AS (SELECT r.*, s.proposal_status, s.created_at, row_number() OVER (PARTITION BY r.proposal_id ORDER BY requested_at, request_id) AS i
         FROM req r LEFT JOIN stored s USING (proposal_id)),
       judged AS (SELECT *, CASE WHEN proposal_status IS NULL THEN 'NOT_FOUND' WHEN proposal_status <> 'PROPOSED' OR i > 1 THEN 'NOT_PENDING'
         WHEN created_at + INTERVAL 1 HOUR < requested_at THEN 'EXPIRED' ELSE 'APPROVED' END AS outcome FROM ranked)
       SELECT request_id, proposal_id, strftime(requested_at, '{STAMP}') AS requested_at, outcome,
       CASE outcome WHEN 'APPROVED' THEN 'APPROVED' WHEN 'EXPIRED' THEN 'APPROVAL_REJECTED_EXPIRED' END AS audit_action FROM judged""",
)
def proposal_approval(v):
    n = F.col("event_id")
    requests = v.table("events").select(
        F.concat(F.lit("a-"), n).alias("request_id"),
        F.concat(F.lit("p-"), F.when(n % 10 == 7, n + 1_000_000_000).otherwise(n - n % 3)).alias("proposal_id"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (n % 50).cast("int"))).alias("requested_at"),
    )
    return replenish.proposal_approval(requests, stored_proposals(v))


@query(
    "stockout_estimates",
    f"""SELECT sku_id, location_code, risk AS risk_level, strftime({T} + to_milliseconds(CAST(floor(hours * 3600000.0::DOUBLE) AS BIGINT)), '{STAMP}') AS estimated_stockout_at
       FROM (SELECT *, CASE WHEN hours <= 24 THEN 'CRITICAL' WHEN hours <= 48 THEN 'HIGH' WHEN hours <= 96 THEN 'MEDIUM' ELSE 'LOW' END AS risk
         FROM (SELECT *, CASE WHEN sku_id % 60 > 0 THEN greatest(available, 0) / (sku_id % 60)::DOUBLE * 24 END AS hours FROM v_balance))""",
    "v_balance",
)
def stockout_estimates(v):
    hours = replenish.stockout_hours(F.col("available"), (F.col("sku_id") % 60).cast("double"))
    at = F.lit(AS_OF).cast("timestamp")
    return v.balances.select(
        *KEY, replenish.risk_level(hours).alias("risk_level"), replenish.stockout_eta(hours, at).alias("estimated_stockout_at")
    )
