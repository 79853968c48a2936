"""Baseline, adaptive forecast and horizon, as column expressions on a feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let, weekday_index, weekday_name
from ..functions.folds import stddev_of
from ..model import KEY
from .demand import RETENTION_DAYS, at, demand_model, hour_at, live_rate, window_units, with_velocities

# Forecast constants.
NO_HISTORY_BASELINE = 12.0
WEEKDAY_SHARE, HOUR_SHARE = 0.65, 0.35
RATIO_FLOOR = 0.1
WEIGHT_MIN, WEIGHT_MAX, WEIGHT_SLOPE, WEIGHT_START = 0.2, 0.85, 0.2, 1.25
SPIKE_RATIO, SPIKE_SCORE = 2.0, 2.0
# End of fixed values.

FORECAST_FIELDS = (
    "baseline_units_per_day", "recent_units_per_day", "forecast_units_per_day",
    "historical_stddev_units_per_day", "recent_vs_baseline_ratio", "spike_score", "spike_detected",
)


def baseline(weekday_stat: Column, hour_stat: Column, no_history: float = NO_HISTORY_BASELINE) -> Column:
    """Seasonal units per day; a stat that is null or has n=0 counts as no history."""
    seen = lambda stat: F.coalesce(stat["n"] > 0, F.lit(False))
    hourly = hour_stat["mean"] * 24.0
    return (
        F.when(
            seen(weekday_stat) & seen(hour_stat),
            WEEKDAY_SHARE * weekday_stat["mean"] + HOUR_SHARE * hourly,
        )
        .when(seen(weekday_stat), weekday_stat["mean"])
        .when(seen(hour_stat), hourly)
        .otherwise(F.lit(no_history))
    )


def adaptive_forecast(weekday_stat: Column, hour_stat: Column, live: Column, recent_rate: Column) -> Column:
    """Struct of the seven forecast values at one instant."""
    inputs = F.struct(
        F.greatest(baseline(weekday_stat, hour_stat), F.lit(0.0)).alias("base"),
        F.when(live > 0, live).otherwise(F.coalesce(recent_rate, F.lit(0.0))).alias("recent"),
        F.coalesce(stddev_of(weekday_stat), F.lit(0.0)).alias("stddev"),
    )

    def scored(x: Column) -> Column:
        base, recent = x["base"], x["recent"]
        return let(
            F.struct(
                base.alias("base"), recent.alias("recent"), x["stddev"].alias("stddev"),
                (recent / F.greatest(base, F.lit(RATIO_FLOOR))).alias("ratio"),
                F.greatest((recent - base) / F.greatest(x["stddev"], F.lit(1.0)), F.lit(0.0)).alias("score"),
            ),
            mixed,
        )

    def mixed(x: Column) -> Column:
        weight = F.when(x["recent"] <= 0, F.lit(0.0)).otherwise(
            F.least(
                F.greatest(
                    WEIGHT_MIN + F.greatest(x["ratio"] - WEIGHT_START, F.lit(0.0)) * WEIGHT_SLOPE,
                    F.lit(WEIGHT_MIN),
                ),
                F.lit(WEIGHT_MAX),
            )
        )
        forecast = let(weight, lambda w: F.greatest((1.0 - w) * x["base"] + w * x["recent"], F.lit(0.0)))
        values = (
            x["base"], x["recent"], forecast, x["stddev"], x["ratio"], x["score"],
            (x["ratio"] >= SPIKE_RATIO) & (x["score"] >= SPIKE_SCORE),
        )
        return F.struct(*[v.alias(n) for v, n in zip(values, FORECAST_FIELDS)])

    return let(inputs, scored)


def forecast_points(instant: Column, days: int, weekday_stats: Column, hour_stats: Column,
                    live: Column, recent_rate: Column) -> Column:
    """Array of (date, weekday, forecast) for each day from `instant` on.

    Every point keeps the hour of day and the velocities and takes its own weekday's history.
    """

    def point(day: Column) -> Column:
        then = instant + F.make_interval(days=day)
        return F.struct(
            F.to_date(then).alias("date"),
            weekday_name(then).alias("weekday"),
            adaptive_forecast(
                F.get(weekday_stats, weekday_index(then)), F.get(hour_stats, F.hour(then)), live, recent_rate
            ).alias("forecast"),
        )

    # Spelled out, not in a lambda: with a constant instant each day's date, weekday and hour are constants.
    return F.array(*[point(F.lit(d)) for d in range(days)])


def forecast_horizon(points: Column) -> Column:
    """The horizon as it is reported: one flat struct per day."""
    return F.transform(
        points,
        lambda p: F.struct(
            p["date"].alias("date"),
            p["weekday"].alias("weekday"),
            p["forecast"]["forecast_units_per_day"].alias("forecast_units"),
            p["forecast"]["baseline_units_per_day"].alias("baseline_units"),
            p["forecast"]["recent_units_per_day"].alias("recent_units"),
            p["forecast"]["spike_detected"].alias("spike_detected"),
        ),
    )


def sku_features(
    balances: DataFrame,
    movements: DataFrame,
    as_of,
    recent_rates: DataFrame | None = None,
    horizon_days: int = 7,
    retention_days: int | None = RETENTION_DAYS,
) -> DataFrame:
    """Feature row per balance key: stock, windows, forecast and horizon at `as_of`.

    `recent_rates` (key, recent_rate_ewma) holds the average after its observation at `as_of`;
    without it the rate observed at `as_of` alone is used. Every input is one row per key by the
    time it is joined, so the joins cannot skew.
    """
    instant = at(as_of)
    windows = window_units(movements, as_of)
    # Every point keeps the hour of the instant: where that is known, no other hour's history is folded.
    hour = hour_at(as_of, balances.sparkSession.conf.get("spark.sql.session.timeZone"))
    model = demand_model(movements, as_of, retention_days, wanted_hours=None if hour is None else [hour])
    # Keyed like the aggregates it meets: the joins share this one shuffle of the balances, and the
    # forecasts after them run on all tasks even when the other sides are broadcast.
    keyed = balances.repartition(*KEY)
    df = keyed.join(windows, KEY, "left").join(model, KEY, "left")
    counts = [c for c in windows.columns if c not in KEY]
    df = with_velocities(df.fillna(0, counts)).withColumn("_live", live_rate())
    if recent_rates is None:
        df = df.withColumn("recent_rate_ewma", F.col("_live"))
    else:
        df = df.join(recent_rates.select(*KEY, "recent_rate_ewma"), KEY, "left")
    points = forecast_points(
        instant, horizon_days, F.col("weekday_stats"), F.col("hour_stats"), F.col("_live"),
        F.col("recent_rate_ewma"),
    )
    result = let(
        points,
        lambda p: F.struct(
            *[F.get(p, F.lit(0))["forecast"][n].alias(n) for n in FORECAST_FIELDS],
            forecast_horizon(p).alias("horizon"),
        ),
    )
    velocities = [f"sale_velocity_{w}" for w in ("5m", "15m", "1h")]
    # A generator's output is computed once, whatever later filters and decisions mention.
    return df.withColumn("computed_at", instant).select(
        *KEY, "computed_at", "on_hand", "reserved", "available",
        F.col("version").alias("balance_version"), "safety_stock", "reorder_point", "max_stock",
        "reserve_units_5m", "sale_units_5m", "sale_units_15m", "sale_units_1h", *velocities,
        "daily_sales", F.inline(F.array(result)),
    )
