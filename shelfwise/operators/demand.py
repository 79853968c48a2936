"""Event-time demand: daily totals, rolling windows, seasonal profiles, recent rate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decayed_stat, weekday_index, weekday_name
from ..model import KEY

# Window widths in minutes, the blend of their rates, the state retention.
WIDTHS = {"5m": 5, "15m": 15, "1h": 60}
BLEND = {"5m": 0.55, "15m": 0.30, "1h": 0.15}
RETENTION_DAYS = 8
# End of fixed values.

_MINUTE = 60_000_000


def at(as_of: datetime | str | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def hour_at(as_of: datetime | str | Column, time_zone: str) -> int | None:
    """Hour of the day at `as_of`, which is the same on every later day in UTC; None where it can't be told beforehand."""
    if isinstance(as_of, Column) or time_zone != "UTC":
        return None
    try:
        when = datetime.fromisoformat(str(as_of))
    except ValueError:
        return None
    return (when if when.tzinfo is None else when.astimezone(timezone.utc)).hour


def daily_demand(silver: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Sale units and rows per sku, location and day."""
    sales = silver.filter(
        (F.col("movement_type") == "Sale")
        & F.col("sku_id").isNotNull()
        & F.col("location_code").isNotNull()
        & F.col("quantity").isNotNull()
        & F.col("occurred_at").isNotNull()
    )
    if since is not None:
        sales = sales.filter(F.col("occurred_at") >= since)
    if until is not None:
        sales = sales.filter(F.col("occurred_at") < until)
    return (
        sales.groupBy(*KEY, F.to_date("occurred_at").alias("date"))
        .agg(F.sum("quantity").alias("sale_units"), F.count("*").alias("movement_count"))
        .select(*KEY, "date", weekday_name("date").alias("weekday"), "sale_units", "movement_count")
    )


def historical_daily_sales(
    movements: DataFrame,
    days_back: int,
    as_of,
    sku_id: int | None = None,
    location_code: str | None = None,
) -> DataFrame:
    """Units sold per day over the last days, for one key or for all keys."""
    sales = movements.filter(
        (F.col("movement_type") == "Sale")
        & (F.col("occurred_at") >= at(as_of) - F.expr(f"interval {int(days_back)} days"))
    )
    keys = KEY
    if sku_id is not None and location_code is not None:
        keys = []
        sales = sales.filter(
            (F.col("sku_id") == sku_id) & (F.col("location_code") == location_code.strip().upper())
        )
    daily = sales.groupBy(*keys, F.to_date("occurred_at").alias("date")).agg(
        F.sum("quantity").alias("total_units")
    )
    return daily.orderBy(*keys, "date")


def _units_between(kind: str, start: Column, end: Column) -> Column:
    inside = (F.col("movement_type") == kind) & F.col("occurred_at").between(start, end)
    return F.coalesce(F.sum(F.when(inside, F.col("quantity"))), F.lit(0)).cast("long")


def window_units(movements: DataFrame, as_of) -> DataFrame:
    """Closed windows ending at `as_of`: sales of 5m/15m/1h and today, reserves of 5m."""
    end = at(as_of)
    midnight = F.date_trunc("day", end)
    back = {w: end - F.expr(f"interval {m} minutes") for w, m in WIDTHS.items()}
    earliest_needed = F.least(midnight, back["1h"])
    recent = movements.filter(
        F.col("movement_type").isin("Sale", "Reserve")
        & F.col("occurred_at").between(earliest_needed, end)
    )
    return recent.groupBy(*KEY).agg(
        *[_units_between("Sale", back[w], end).alias(f"sale_units_{w}") for w in WIDTHS],
        _units_between("Reserve", back["5m"], end).alias("reserve_units_5m"),
        _units_between("Sale", midnight, end).alias("daily_sales"),
    )


def units_today(movements: DataFrame, as_of) -> DataFrame:
    """Sales from UTC midnight to `as_of`, both inclusive."""
    end = at(as_of)
    return (
        movements.filter(
            (F.col("movement_type") == "Sale")
            & F.col("occurred_at").between(F.date_trunc("day", end), end)
        )
        .groupBy(*KEY)
        .agg(F.sum("quantity").alias("daily_sales"))
    )


def velocity(units: Column, minutes: int) -> Column:
    """Units in a window, as units per day."""
    return units * F.lit(1440.0 / minutes)


def with_velocities(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"sale_velocity_{w}": velocity(F.col(f"sale_units_{w}"), m) for w, m in WIDTHS.items()}
    )


def live_rate() -> Column:
    """Blend of the three velocities."""
    return (
        BLEND["5m"] * F.col("sale_velocity_5m")
        + BLEND["15m"] * F.col("sale_velocity_15m")
        + BLEND["1h"] * F.col("sale_velocity_1h")
    )


def rolling_units(
    movements: DataFrame,
    columns: dict[str, tuple[str, int]],
    keys: list[str] = KEY,
    extra: list[str] | None = None,
    bucket_minutes: int = 60,
) -> DataFrame:
    """Per event: units of a movement type in the closed window of some minutes before it.

    `columns` maps an output name to (movement type, minutes). Time is cut into buckets at least
    as long as the widest window; each row also visits the next bucket as look-back only, so a
    hot key is spread over its buckets instead of sorting in one task.
    """
    widest = max(m for _, m in columns.values())
    bucket = max(bucket_minutes, widest) * _MINUTE
    micros = F.unix_micros("occurred_at")
    own = F.floor(micros / bucket)
    # Rows at one instant are summed first: the closed window sees them together anyway.
    wanted = sorted({kind for kind, _ in columns.values()})
    instants = movements.groupBy(*keys, "occurred_at").agg(
        *[
            F.sum(F.when(F.col("movement_type") == kind, F.col("quantity"))).alias(f"_u_{kind}")
            for kind in wanted
        ]
    )
    # Only rows close enough to the end of their bucket are needed by the next one.
    near_end = (own + 1) * bucket - micros <= widest * _MINUTE
    visits = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = (
        instants.withColumn("_us", micros)
        .withColumn("_own", own)
        .withColumn("_bucket", F.explode(visits))
    )
    values = {}
    for name, (kind, minutes) in columns.items():
        frame = (
            Window.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-minutes * _MINUTE, 0)
        )
        values[name] = F.coalesce(F.sum(f"_u_{kind}").over(frame), F.lit(0)).cast("long")
    rolled = (
        spread.withColumns(values)
        .filter(F.col("_bucket") == F.col("_own"))
        .select(*keys, "occurred_at", *columns)
    )
    if extra is None:
        return rolled
    return movements.select(*extra, *keys, "occurred_at").join(rolled, [*keys, "occurred_at"])


def _retention_start(end: Column, retention_days: int) -> Column:
    """Midnight of the first retained day: whole calendar days only."""
    return F.date_sub(F.to_date(end), int(retention_days)).cast("timestamp")


def demand_buckets(movements: DataFrame, as_of, retention_days: int | None = RETENTION_DAYS) -> DataFrame:
    """Hourly sale totals of the days closed before `as_of`, with their day totals.

    Hour totals are aggregated first; day totals are a window over at most 24 of them. Only
    positive totals are kept. `retention_days=None` learns from all history.
    """
    end = at(as_of)
    sales = movements.filter(
        (F.col("movement_type") == "Sale") & (F.col("occurred_at") < F.date_trunc("day", end))
    )
    if retention_days is not None:
        sales = sales.filter(F.col("occurred_at") >= _retention_start(end, retention_days))
    hourly = sales.groupBy(
        *KEY, F.to_date("occurred_at").alias("date"), F.hour("occurred_at").alias("hour")
    ).agg(F.sum("quantity").alias("hour_units"))
    day = Window.partitionBy(*KEY, "date")
    return hourly.withColumn("day_units", F.sum("hour_units").over(day)).filter(
        (F.col("hour_units") > 0) | (F.col("day_units") > 0)
    )


def daily_buckets(movements: DataFrame, as_of, retention_days: int | None = RETENTION_DAYS,
                  include_zero_days: bool = False) -> DataFrame:
    """Day totals of closed days; zero days between sales only when asked for."""
    hourly = demand_buckets(movements, as_of, retention_days)
    daily = (
        hourly.groupBy(*KEY, "date").agg(F.sum("hour_units").alias("units")).filter(F.col("units") > 0)
    )
    if not include_zero_days:
        return daily
    last_closed = F.date_sub(F.to_date(at(as_of)), 1)
    calendar = daily.groupBy(*KEY).agg(F.min("date").alias("_from")).select(
        *KEY, F.explode(F.sequence(F.col("_from"), last_closed)).alias("date")
    )
    return calendar.join(daily, [*KEY, "date"], "left").fillna(0, ["units"])


def weekday_profile(daily: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Decayed mean and variance of day totals per key and weekday (Monday is 0)."""
    series = F.collect_list(F.struct(F.col("date").alias("ord"), F.col("units").alias("v")))
    return (
        daily.groupBy(*KEY, weekday_index("date").alias("weekday"))
        .agg(decayed_stat(series, alpha).alias("stat"))
        .select(*KEY, "weekday", "stat.*")
    )


def hour_profile(hourly: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Decayed mean and variance of hour totals per key and hour of day."""
    series = F.collect_list(F.struct(F.col("date").alias("ord"), F.col("hour_units").alias("v")))
    return (
        hourly.filter(F.col("hour_units") > 0)
        .groupBy(*KEY, "hour")
        .agg(decayed_stat(series, alpha).alias("stat"))
        .select(*KEY, "hour", "stat.*")
    )


def demand_model(movements: DataFrame, as_of, retention_days: int | None = RETENTION_DAYS,
                 alpha: float = 0.2, wanted_hours: Sequence[int] | None = None) -> DataFrame:
    """One row per key: `weekday_stats` (7 stats, Monday first) and `hour_stats` (24 stats).

    wanted_hours: hours of the day whose stats are asked for; the others are null. Without it, all.

    Sales are combined to one row per key and day before the first shuffle; the second gathers
    one entry per closed day, so a key's array is as long as the calendar, not as its sales.
    """
    end = at(as_of)
    sales = movements.filter(
        (F.col("movement_type") == "Sale") & (F.col("occurred_at") < F.date_trunc("day", end))
    )
    if retention_days is not None:
        sales = sales.filter(F.col("occurred_at") >= _retention_start(end, retention_days))
    hour, units = F.hour("occurred_at"), F.col("quantity")
    wanted = sorted(range(24) if wanted_hours is None else set(wanted_hours))
    days = (
        sales.groupBy(*KEY, F.to_date("occurred_at").alias("ord"))
        .agg(
            F.sum(units).alias("day_units"),
            *[F.sum(F.when(hour == h, units)).alias(f"h{h}") for h in wanted],
        )
        .select(*KEY, "ord", "day_units", F.array(*[f"h{h}" for h in wanted]).alias("hours"))
    )
    per_key = days.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("ord", "day_units", "hours"))).alias("days")
    )

    def fold(kept, value) -> Column:
        series = F.transform(
            F.filter("days", kept), lambda d: F.struct(d["ord"].alias("ord"), value(d).alias("v"))
        )
        return decayed_stat(series, alpha, presorted=True)

    weekdays = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda w: fold(
            lambda d: (F.weekday(d["ord"]) == w) & (d["day_units"] > 0), lambda d: d["day_units"]
        ),
    )
    def hour_stat(i: Column | int) -> Column:
        return fold(lambda d: F.get(d["hours"], i) > 0, lambda d: F.get(d["hours"], i))

    if wanted_hours is None:
        hours = F.transform(F.sequence(F.lit(0), F.lit(23)), hour_stat)
    else:
        place = {h: F.lit(i) for i, h in enumerate(wanted)}
        hours = F.array(*[hour_stat(place[h]) if h in place else F.lit(None) for h in range(24)])
    return per_key.select(*KEY, weekdays.alias("weekday_stats"), hours.alias("hour_stats"))
