"""Checks on externally proposed decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strict_json

# Limits, the note added when a risk is raised, and the texts of the outcomes.
MAX_ORDER_QUANTITY = 5000
ELEVATION_NOTE = (
    "SAFETY_FIREWALL: Risk level elevated from LOW to MEDIUM because stock is at/below safety "
    "stock or depleted"
)
INVALID_ACTION = "invalid action '{}'; must be REORDER, WAIT, or REVIEW"
CONFIDENCE_OUT_OF_RANGE = "confidence {} out of [0.0, 1.0]"
EMPTY_SUMMARY = "summary is empty"
EMPTY_KEY_POINTS = "key_points array is empty"
QUANTITY_WITHOUT_REORDER = "action is {} but proposed quantity was {}; clamped to 0"
NEGATIVE_QUANTITY = "negative quantity {} clamped to 0"
ABOVE_BUDGET = "quantity {} exceeded max order budget limit {}; clamped"
ABOVE_CAPACITY = "quantity {} exceeded available capacity {} (max_stock {} - on_hand {}); clamped to capacity"
# End of fixed values.


def _message(template: str, *values: Column) -> Column:
    """The template with its gaps filled; null if a value is."""
    first, *others = template.split("{}")
    parts = [F.lit(first)]
    for value, text in zip(values, others):
        parts += [value.cast("string"), F.lit(text)]
    return F.concat(*parts)


def normalized_action(action: Column) -> Column:
    raw = F.upper(F.trim(action))
    return (
        F.when(raw.contains("REORDER") | raw.contains("RESTOCK"), "REORDER")
        .when(raw.contains("WAIT"), "WAIT")
        .when(raw.contains("REVIEW"), "REVIEW")
    )


def guard_decisions(df: DataFrame, max_quantity: int = MAX_ORDER_QUANTITY) -> DataFrame:
    """Adds guard_outcome (PASSED, CLAMPED, REJECTED), guard_reason and the corrected fields.

    Needs action, confidence, summary, key_points, reorder_quantity, risk_level and the balance
    columns on_hand, available, safety_stock, max_stock. A quantity on a non-reorder action and a
    negative quantity return before the risk check.
    """
    given = F.col("reorder_quantity")
    action = normalized_action(F.col("action"))
    capacity = F.greatest(F.col("max_stock") - F.col("on_hand"), F.lit(0))
    rejected = (
        F.when(action.isNull(), _message(INVALID_ACTION, F.col("action")))
        .when(
            ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
            _message(CONFIDENCE_OUT_OF_RANGE, F.col("confidence")),
        )
        .when(F.coalesce(F.trim("summary"), F.lit("")) == "", EMPTY_SUMMARY)
        .when(F.coalesce(F.size("key_points"), F.lit(0)) <= 0, EMPTY_KEY_POINTS)
    )
    df = df.withColumn("_action", action).withColumn("_rejected", rejected)
    early = F.when(
        (F.col("_action") != "REORDER") & (given > 0),
        _message(QUANTITY_WITHOUT_REORDER, F.col("_action"), given),
    ).when(given < 0, _message(NEGATIVE_QUANTITY, given))
    # Both limits apply in turn, so the budget message wins when both are exceeded.
    within_capacity = F.least(given, capacity)
    late = F.when(within_capacity > max_quantity, _message(ABOVE_BUDGET, given, F.lit(max_quantity))).when(
        given > capacity, _message(ABOVE_CAPACITY, given, capacity, F.col("max_stock"), F.col("on_hand"))
    )
    df = df.withColumn("_early", early)
    checked = F.col("_rejected").isNull()
    through = checked & F.col("_early").isNull()
    depleted = (
        (F.col("on_hand") <= 0) | (F.col("available") <= 0) | (F.col("on_hand") <= F.col("safety_stock"))
    )
    raise_risk = through & depleted & (F.upper(F.trim("risk_level")) == "LOW")
    quantity = (
        F.when(~checked, given)
        .when(F.col("_early").isNotNull(), F.lit(0))
        .otherwise(F.least(within_capacity, F.lit(max_quantity)))
    )
    reason = F.coalesce(F.col("_rejected"), F.col("_early"), F.when(through, late))
    return (
        df.withColumn("guard_reason", reason)
        .withColumn(
            "guard_outcome",
            F.when(~checked, "REJECTED").when(F.col("guard_reason").isNotNull(), "CLAMPED").otherwise("PASSED"),
        )
        .withColumn("guarded_action", F.when(checked, F.col("_action")))
        .withColumn("guarded_quantity", quantity.cast("int"))
        .withColumn("risk_elevated", F.coalesce(raise_risk, F.lit(False)))
        .withColumn("guarded_risk", F.when(F.col("risk_elevated"), "MEDIUM").otherwise(F.col("risk_level")))
        .withColumn(
            "guarded_points",
            F.when(F.col("risk_elevated"), F.array_append("key_points", F.lit(ELEVATION_NOTE))).otherwise(
                F.col("key_points")
            ),
        )
        .drop("_action", "_rejected", "_early")
    )


def parse_decision_json(df: DataFrame, column: str) -> DataFrame:
    """Typed decision fields from a JSON text column; bad rows get a parse_error instead.

    A surrounding code fence is removed first. action, reorder_quantity, urgency, risk_level,
    summary, key_points and confidence are required.
    """
    body = F.trim(F.col(column), F.lit(" \t\r\n"))
    fenced = F.regexp_extract(body, r"(?s)^```(?:json)?(.*?)(?:```)?$", 1)
    body = F.when(body.startswith("```"), F.trim(fenced, F.lit(" \t\r\n"))).otherwise(body)
    df = df.withColumn("_doc", strict_json(body))
    doc = F.col("_doc")

    def field(name: str, target: str, *shapes: str) -> tuple[Column, Column]:
        node = F.try_variant_get(doc, f"$.{name}", "variant")
        value = F.try_variant_get(doc, f"$.{name}", target)
        return value, F.coalesce(
            F.regexp_like(F.schema_of_variant(node), F.lit(f"^({'|'.join(shapes)})")) & value.isNotNull(),
            F.lit(False),
        )

    fields = {
        "action": field("action", "string", "STRING"),
        "reorder_quantity": field("reorder_quantity", "int", "BIGINT"),
        "urgency": field("urgency", "string", "STRING"),
        "risk_level": field("risk_level", "string", "STRING"),
        "summary": field("summary", "string", "STRING"),
        "key_points": field("key_points", "array<string>", "ARRAY<STRING>", "ARRAY<VOID>"),
        "confidence": field("confidence", "double", "BIGINT", "DECIMAL", "DOUBLE"),
    }
    typed = F.lit(True)
    for _, ok in fields.values():
        typed = typed & ok
    value = {name: pair[0] for name, pair in fields.items()}
    complete = (
        (F.trim(value["summary"]) != "")
        & (F.size(value["key_points"]) > 0)
        & value["confidence"].between(0.0, 1.0)
    )
    error = F.when(~typed, "MALFORMED").when(~F.coalesce(complete, F.lit(False)), "INVALID")
    df = df.withColumn("parse_error", error)
    return df.withColumns(
        {name: F.when(F.col("parse_error").isNull(), v) for name, v in value.items()}
    ).drop("_doc")
