"""Demand, windows, profiles, statistics and load runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import weekday_index
from shelfwise.model import KEY
from shelfwise.operators import demand as d
from shelfwise.operators import stats
from shelfwise.operators.lookups import evaluated_movements
from shelfwise.operators.recent_rate import rate_ticks, recent_rate_ewma

from .registry import query
from .views import AS_OF, HISTORY_AS_OF

T = f"TIMESTAMP '{AS_OF}'"
STAMP = "%Y-%m-%d %H:%M:%S.%f"


@query(
    "daily_demand",
    """SELECT sku_id, location_code, strftime(occurred_at, '%Y-%m-%d') AS date,
       upper(strftime(occurred_at, '%a')) AS weekday, CAST(sum(quantity) AS BIGINT) AS sale_units,
       count(*) AS movement_count
       FROM v_movement WHERE movement_type = 'Sale' GROUP BY ALL""",
    "v_movement",
)
def daily_demand(v):
    return d.daily_demand(v.movements)


@query(
    "gold_from_late_batches",
    """SELECT sku_id, location_code, strftime(occurred_at, '%Y-%m-%d') AS date,
       upper(strftime(occurred_at, '%a')) AS weekday, CAST(sum(quantity) AS BIGINT) AS sale_units,
       CAST(count(*) AS BIGINT) AS movement_count
       FROM v_event_movement WHERE movement_type = 'Sale' GROUP BY ALL""",
    "v_event_movement",
)
def gold_from_late_batches(v):
    """Five shuffled batches with redelivered facts among them, merged as the stream's tables merge theirs."""
    from functools import reduce

    from shelfwise.operators.keyed import earliest
    from shelfwise.streaming.dedup import combine_gold, gold_delta

    number = F.pmod(F.xxhash64("movement_id"), F.lit(5))
    received = v.event_movements.withColumn("batch", F.explode(F.array(number, number + 1)))
    facts = earliest(received, ["movement_id"], ["batch"])
    return combine_gold(reduce(lambda a, b: a.unionByName(b), [gold_delta(facts.filter(F.col("batch") == n)) for n in range(5)]))


@query(
    "daily_demand_date_range",
    """SELECT sku_id, location_code, strftime(occurred_at, '%Y-%m-%d') AS date,
       upper(strftime(occurred_at, '%a')) AS weekday, CAST(sum(quantity) AS BIGINT) AS sale_units,
       count(*) AS movement_count
       FROM v_movement WHERE movement_type = 'Sale' AND occurred_at >= TIMESTAMP '1997-01-01'
       AND occurred_at < TIMESTAMP '1997-07-01' GROUP BY ALL""",
    "v_movement",
)
def daily_demand_date_range(v):
    return d.daily_demand(v.movements, d.at("1997-01-01 00:00:00"), d.at("1997-07-01 00:00:00"))


@query(
    "historical_daily_sales",
    """SELECT sku_id, location_code, strftime(occurred_at, '%Y-%m-%d') AS date,
       CAST(sum(quantity) AS BIGINT) AS total_units FROM v_movement
       WHERE movement_type = 'Sale' AND occurred_at >= TIMESTAMP '1998-09-02' - INTERVAL 365 DAY GROUP BY ALL""",
    "v_movement",
)
def historical_daily_sales(v):
    return d.historical_daily_sales(v.movements, 365, HISTORY_AS_OF)


@query(
    "historical_daily_sales_one_key",
    f"""SELECT strftime(occurred_at, '%Y-%m-%d') AS date, CAST(sum(quantity) AS BIGINT) AS total_units
       FROM v_event_movement WHERE movement_type = 'Sale' AND sku_id = 7 AND location_code = 'BLR'
       AND occurred_at >= {T} - INTERVAL 30 DAY GROUP BY ALL""",
    "v_event_movement",
)
def historical_daily_sales_one_key(v):
    return d.historical_daily_sales(v.event_movements, 30, AS_OF, sku_id=7, location_code=" blr ")


WINDOW_SQL = f"""
  SELECT sku_id, location_code,
    CAST(coalesce(sum(quantity) FILTER (movement_type = 'Sale' AND occurred_at >= {T} - INTERVAL 5 MINUTE), 0) AS BIGINT) AS sale_units_5m,
    CAST(coalesce(sum(quantity) FILTER (movement_type = 'Sale' AND occurred_at >= {T} - INTERVAL 15 MINUTE), 0) AS BIGINT) AS sale_units_15m,
    CAST(coalesce(sum(quantity) FILTER (movement_type = 'Sale' AND occurred_at >= {T} - INTERVAL 60 MINUTE), 0) AS BIGINT) AS sale_units_1h,
    CAST(coalesce(sum(quantity) FILTER (movement_type = 'Reserve' AND occurred_at >= {T} - INTERVAL 5 MINUTE), 0) AS BIGINT) AS reserve_units_5m,
    CAST(coalesce(sum(quantity) FILTER (movement_type = 'Sale' AND occurred_at >= date_trunc('day', {T})), 0) AS BIGINT) AS daily_sales
  FROM v_live WHERE movement_type IN ('Sale', 'Reserve') AND occurred_at <= {T}
    AND occurred_at >= least(date_trunc('day', {T}), {T} - INTERVAL 1 HOUR) GROUP BY ALL"""


@query("window_units", WINDOW_SQL, "v_live")
def window_units(v):
    return d.window_units(v.live, AS_OF)


@query(
    "window_velocities",
    f"""WITH w AS ({WINDOW_SQL})
       SELECT sku_id, location_code, sale_units_5m * 288.0::DOUBLE AS sale_velocity_5m,
       sale_units_15m * 96.0::DOUBLE AS sale_velocity_15m, sale_units_1h * 24.0::DOUBLE AS sale_velocity_1h,
       round(0.55::DOUBLE * sale_units_5m * 288 + 0.30::DOUBLE * sale_units_15m * 96 + 0.15::DOUBLE * sale_units_1h * 24, 6) AS live_rate
       FROM w""",
    "v_live",
)
def window_velocities(v):
    w = d.with_velocities(d.window_units(v.live, AS_OF))
    return w.select(
        *KEY, "sale_velocity_5m", "sale_velocity_15m", "sale_velocity_1h", d.live_rate().alias("live_rate")
    )


@query(
    "units_today",
    f"""SELECT sku_id, location_code, CAST(sum(quantity) AS BIGINT) AS daily_sales FROM v_live
       WHERE movement_type = 'Sale' AND occurred_at BETWEEN date_trunc('day', {T}) AND {T} GROUP BY ALL""",
    "v_live",
)
def units_today(v):
    return d.units_today(v.live, AS_OF)


ROLLING = {
    "sale_units_5m": ("Sale", 5), "sale_units_15m": ("Sale", 15), "sale_units_1h": ("Sale", 60),
    "reserve_units_5m": ("Reserve", 5),
}


def rolling_sql(view: str, distinct: bool = False) -> str:
    frames = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN movement_type = '{kind}' THEN quantity END) OVER (PARTITION BY sku_id, location_code "
        f"ORDER BY occurred_at RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS {name}"
        for name, (kind, m) in ROLLING.items()
    )
    return (
        f"SELECT {'DISTINCT' if distinct else 'movement_id,'} sku_id, location_code, "
        f"strftime(occurred_at, '{STAMP}') AS occurred_at, {frames} FROM {view} "
        "WHERE movement_type IN ('Sale', 'Reserve')"
    )


@query("rolling_units_per_event", rolling_sql("v_event_movement"), "v_event_movement")
def rolling_units_per_event(v):
    return d.rolling_units(evaluated_movements(v.event_movements), ROLLING, extra=["movement_id"])


@query(
    "rolling_units_per_location",
    rolling_sql("(SELECT * REPLACE (1 AS sku_id) FROM v_event_movement)", distinct=True),
    "v_event_movement",
)
def rolling_units_per_location(v):
    return d.rolling_units(evaluated_movements(v.area_movements), ROLLING)


HOURLY = f"""hourly AS (
  SELECT sku_id, location_code, CAST(occurred_at AS DATE) AS date, hour(occurred_at) AS hour, sum(quantity) AS units
  FROM v_live WHERE movement_type = 'Sale' AND occurred_at < date_trunc('day', {T})
  AND CAST(occurred_at AS DATE) >= CAST({T} AS DATE) - 8 GROUP BY ALL),
daily AS (SELECT sku_id, location_code, date, sum(units) AS units FROM hourly GROUP BY ALL HAVING sum(units) > 0)"""


@query(
    "demand_buckets",
    f"""WITH {HOURLY} SELECT h.sku_id, h.location_code, strftime(h.date, '%Y-%m-%d') AS date, CAST(h.hour AS INTEGER) AS hour,
       CAST(h.units AS BIGINT) AS hour_units, CAST(dd.units AS BIGINT) AS day_units
       FROM hourly h JOIN daily dd USING (sku_id, location_code, date)""",
    "v_live",
)
def demand_buckets(v):
    return d.demand_buckets(v.live, AS_OF)


def fold_sql(source: str, keys: str, order: str, value: str, p: str = "") -> str:
    """Decayed mean and variance by recursion over the observation number; CTE names start with p."""
    names = [k.strip() for k in keys.split(",")]
    return f"""{p}seq AS (SELECT {keys}, {value}::DOUBLE AS x, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i FROM {source}),
{p}fold AS (SELECT {keys}, i, x AS mean, 0.0::DOUBLE AS variance FROM {p}seq WHERE i = 1
  UNION ALL
  SELECT {', '.join('f.' + k for k in names)}, s.i, f.mean + 0.2::DOUBLE * (s.x - f.mean),
    0.8::DOUBLE * (f.variance + 0.2::DOUBLE * (s.x - f.mean) * (s.x - f.mean))
  FROM {p}fold f JOIN {p}seq s ON {' AND '.join(f's.{k} = f.{k}' for k in names)} AND s.i = f.i + 1),
{p}last AS (SELECT {keys}, max(i) AS n, arg_max(mean, i) AS mean, arg_max(variance, i) AS variance FROM {p}fold GROUP BY {keys})"""


@query(
    "weekday_profile",
    f"""WITH RECURSIVE {HOURLY}, wd AS (SELECT *, isodow(date) - 1 AS weekday FROM daily),
       {fold_sql('wd', 'sku_id, location_code, weekday', 'date', 'units')}
       SELECT sku_id, location_code, CAST(weekday AS INTEGER) AS weekday, round(mean, 6) AS mean,
       round(variance, 6) AS variance, n FROM last""",
    "v_live",
)
def weekday_profile(v):
    return d.weekday_profile(d.daily_buckets(v.live, AS_OF))


@query(
    "hour_profile",
    f"""WITH RECURSIVE {HOURLY}, hp AS (SELECT * FROM hourly WHERE units > 0),
       {fold_sql('hp', 'sku_id, location_code, hour', 'date', 'units')}
       SELECT sku_id, location_code, CAST(hour AS INTEGER) AS hour, round(mean, 6) AS mean,
       round(variance, 6) AS variance, n FROM last""",
    "v_live",
)
def hour_profile(v):
    return d.hour_profile(d.demand_buckets(v.live, AS_OF))


@query(
    "weekday_profile_full_history",
    f"""WITH RECURSIVE daily AS (SELECT sku_id, location_code, CAST(occurred_at AS DATE) AS date, sum(quantity) AS units
         FROM v_event_movement WHERE movement_type = 'Sale' AND occurred_at < date_trunc('day', {T}) GROUP BY ALL),
       wd AS (SELECT *, isodow(date) - 1 AS weekday FROM daily),
       {fold_sql('wd', 'sku_id, location_code, weekday', 'date', 'units')}
       SELECT sku_id, location_code, CAST(weekday AS INTEGER) AS weekday, round(mean, 6) AS mean,
       round(variance, 6) AS variance, n FROM last""",
    "v_event_movement",
)
def weekday_profile_full_history(v):
    return d.weekday_profile(d.daily_buckets(v.event_movements, AS_OF, retention_days=None))


@query(
    "weekday_profile_with_zero_days",
    f"""WITH RECURSIVE sold AS (SELECT sku_id, location_code, CAST(occurred_at AS DATE) AS date, sum(quantity) AS units
         FROM v_event_movement WHERE movement_type = 'Sale' AND occurred_at < date_trunc('day', {T}) GROUP BY ALL),
       span AS (SELECT sku_id, location_code, unnest(days)::DATE AS date FROM (SELECT sku_id, location_code,
         generate_series(min(date)::TIMESTAMP, TIMESTAMP '2024-01-19', INTERVAL 1 DAY) AS days FROM sold GROUP BY sku_id, location_code)),
       wd AS (SELECT sku_id, location_code, date, coalesce(units, 0) AS units, isodow(date) - 1 AS weekday
         FROM span LEFT JOIN sold USING (sku_id, location_code, date)),
       {fold_sql('wd', 'sku_id, location_code, weekday', 'date', 'units')}
       SELECT sku_id, location_code, CAST(weekday AS INTEGER) AS weekday, round(mean, 6) AS mean,
       round(variance, 6) AS variance, n FROM last""",
    "v_event_movement",
)
def weekday_profile_with_zero_days(v):
    return d.weekday_profile(
        d.daily_buckets(v.event_movements, AS_OF, retention_days=None, include_zero_days=True)
    )


@query(
    "daily_sales_ewma",
    f"""WITH RECURSIVE daily AS (SELECT sku_id, location_code, CAST(occurred_at AS DATE) AS date, sum(quantity) AS units
         FROM v_event_movement WHERE movement_type = 'Sale' GROUP BY ALL),
       {fold_sql('daily', 'sku_id, location_code', 'date', 'units')}
       SELECT sku_id, location_code, round(mean, 6) AS mean, round(variance, 6) AS variance, n,
       round(sqrt(greatest(variance, 0)), 6) AS stddev FROM last""",
    "v_event_movement",
)
def daily_sales_ewma(v):
    from shelfwise.functions import decayed_stat
    from shelfwise.functions.folds import stddev_of

    daily = d.daily_demand(v.event_movements)
    series = F.collect_list(F.struct(F.col("date").alias("ord"), F.col("sale_units").alias("v")))
    stat = daily.groupBy(*KEY).agg(decayed_stat(series).alias("s"))
    return stat.select(*KEY, "s.*", stddev_of(F.col("s")).alias("stddev"))


RATE_SQL = f"""ticks AS (SELECT DISTINCT sku_id, location_code, occurred_at AS tick_at,
    0.55::DOUBLE * s5 * 288 + 0.30::DOUBLE * s15 * 96 + 0.15::DOUBLE * s60 * 24 AS rate
  FROM (SELECT sku_id, location_code, occurred_at, {', '.join(
      f"coalesce(sum(CASE WHEN movement_type = 'Sale' THEN quantity END) OVER (PARTITION BY sku_id, location_code ORDER BY occurred_at "
      f"RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW), 0) AS s{m}" for m in (5, 15, 60))}
    FROM ticked WHERE movement_type IN ('Sale', 'Reserve'))),
chain AS (
  SELECT sku_id, location_code, tick_at, rate AS ewma, 1::BIGINT AS samples FROM (
    SELECT *, row_number() OVER (PARTITION BY sku_id, location_code ORDER BY tick_at) AS i FROM ticks) WHERE i = 1
  UNION ALL
  SELECT t.sku_id, t.location_code, t.tick_at, CASE WHEN c.ewma = 0 THEN t.rate ELSE 0.35::DOUBLE * t.rate + 0.65::DOUBLE * c.ewma END,
    c.samples + 1
  FROM chain c JOIN ticks t ON t.sku_id = c.sku_id AND t.location_code = c.location_code
    AND t.tick_at = (SELECT min(n.tick_at) FROM ticks n WHERE n.sku_id = c.sku_id AND n.location_code = c.location_code
                AND n.tick_at >= c.tick_at + INTERVAL 1 MINUTE))"""
RATE_RESULT = f"""SELECT sku_id, location_code, round(arg_max(ewma, samples), 6) AS recent_rate_ewma, max(samples) AS samples,
       strftime(max(tick_at), '{STAMP}') AS last_sample_at FROM chain GROUP BY sku_id, location_code"""


@query(
    "recent_rate_average",
    f"WITH RECURSIVE ticked AS (SELECT * FROM v_event_movement), {RATE_SQL} {RATE_RESULT}",
    "v_event_movement",
)
def recent_rate_average(v):
    return recent_rate_ewma(rate_ticks(v.event_movements))


SERIES_SQL = """SELECT {keys}, count(*) AS n, round(avg(y), 6) AS mean, round(coalesce(stddev_samp(y), 0), 6) AS stddev,
       min(y) AS min, max(y) AS max, median(y) AS median,
       round(coalesce(CASE WHEN count(*) > 1 THEN regr_slope(y, x) END, 0), 6) AS trend_slope
       FROM (SELECT {keys}, units::DOUBLE AS y, (row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1)::DOUBLE AS x
             FROM daily) GROUP BY ALL"""


@query(
    "sales_statistics",
    """WITH daily AS (SELECT sku_id, location_code, CAST(occurred_at AS DATE) AS date, sum(quantity) AS units
         FROM v_movement WHERE movement_type = 'Sale' GROUP BY ALL) """ + SERIES_SQL.format(keys="sku_id, location_code"),
    "v_movement",
)
def sales_statistics(v):
    return stats.describe_series(d.daily_demand(v.movements), KEY, "date", "sale_units")


def _ranked_sql(rank: str) -> str:
    picks = ", ".join(
        f"coalesce(max(latency_ms) FILTER (i = {rank.format(p=p)}), 0) AS p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99)
    )
    return f"""SELECT location_code, {picks} FROM (
       SELECT location_code, latency_ms, row_number() OVER (PARTITION BY location_code ORDER BY latency_ms) AS i,
         count(*) OVER (PARTITION BY location_code) AS n
       FROM v_request WHERE latency_ms IS NOT NULL) GROUP BY ALL"""


PS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


@query("nearest_rank_percentiles", _ranked_sql("least(greatest(ceil({p}::DOUBLE * n), 1), n)"), "v_request")
def nearest_rank_percentiles(v):
    return stats.nearest_rank_percentiles(v.requests, "latency_ms", PS, ["location_code"])


@query("rounded_index_percentiles", _ranked_sql("floor({p}::DOUBLE * (n - 1) + 0.5) + 1"), "v_request")
def rounded_index_percentiles(v):
    return stats.rounded_index_percentiles(v.requests, "latency_ms", PS, ["location_code"])


@query(
    "load_run_summary",
    """SELECT count(*) AS offered, round(count(*) / 3600.0::DOUBLE, 6) AS offered_per_second,
       count(*) FILTER (outcome = 'ACCEPTED') AS accepted, count(*) FILTER (outcome = 'HTTP_FAILURE') AS failures,
       count(*) FILTER (outcome = 'TIMEOUT') AS timeouts, count(*) FILTER (outcome = 'DROPPED') AS dropped,
       count(*) - count(DISTINCT request_id) AS duplicate_ids, round(sum(lines)::DOUBLE / count(*), 6) AS avg_lines,
       round(sum(units)::DOUBLE / count(*), 6) AS avg_units, round(avg(latency_ms), 6) AS avg_ms,
       quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
       quantile_disc(latency_ms, 0.99) AS p99_ms FROM v_request""",
    "v_request",
)
def load_run_summary(v):
    return stats.load_run_summary(v.requests, 3600)


@query(
    "load_run_counts",
    """SELECT 'status' AS dimension, CAST(status AS VARCHAR) AS value, count(*) AS requests FROM v_request
       WHERE status IS NOT NULL GROUP BY ALL
       UNION ALL SELECT 'location', location_code, count(*) FROM v_request GROUP BY ALL""",
    "v_request",
)
def load_run_counts(v):
    return stats.load_run_counts(v.requests)


@query(
    "max_in_flight",
    """SELECT CAST(max(level) AS BIGINT) AS max_in_flight FROM (
       SELECT sum(step) OVER (ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS level FROM (
         SELECT started_at AS moment, 1 AS step FROM v_request UNION ALL SELECT ended_at, -1 FROM v_request))""",
    "v_request",
)
def max_in_flight(v):
    return stats.max_in_flight(v.requests)


@query(
    "movement_type_counts",
    "SELECT movement_type, location_code, count(*) AS rows FROM v_movement GROUP BY ALL",
    "v_movement",
)
def movement_type_counts(v):
    return stats.status_counts(v.movements, ["movement_type", "location_code"])


@query(
    "fact_distinct_check",
    """SELECT count(*) AS rows, count(DISTINCT movement_id) AS ids, count(*) - count(DISTINCT movement_id) AS duplicates
       FROM v_movement""",
    "v_movement",
)
def fact_distinct_check(v):
    return stats.fact_distinct_check(v.movements)


@query(
    "distinct_sketch_check",
    """SELECT strftime(occurred_at, '%Y-%m-%d') AS day, count(DISTINCT movement_id) AS exact, count(*) * 2 AS n_rows, true AS within_five_percent
       FROM v_event_movement GROUP BY ALL""",
    "v_event_movement",
)
def distinct_sketch_check(v):
    """Sketches of two batches that share all their ids, united by day, beside the exact counts."""
    facts = v.event_movements
    sketches = stats.united_sketches(stats.distinct_sketches(facts).unionByName(stats.distinct_sketches(facts)))
    error = stats.distinct_error(facts, sketches).select("day", "exact", "error")
    return error.join(sketches.select("day", "n_rows"), "day").select(
        "day", "exact", "n_rows", (F.col("error") <= 0.05).alias("within_five_percent")
    )


@query(
    "calendar_and_key_functions",
    """SELECT movement_id, sku_id || ':' || upper(trim(location_code)) AS stream_key,
       upper(strftime(occurred_at, '%a')) AS weekday, CAST(isodow(occurred_at) - 1 AS INTEGER) AS weekday_index,
       strftime(date_trunc('hour', occurred_at), '%Y-%m-%d %H:%M:%S.%f') AS hour_start,
       epoch_ms(occurred_at) AS epoch_ms, strftime(occurred_at, '%Y%m') AS month_bucket,
       regexp_replace('inventory/' || location_code || ' #' || quantity, '[^A-Za-z0-9._-]', '_', 'g') AS safe_topic,
       split_part('Inventory.Events.' || movement_type, '.', 3) AS short_type
       FROM v_movement""",
    "v_movement",
)
def calendar_and_key_functions(v):
    from shelfwise.functions import month_bucket, sanitize_topic, short_type_name, sku_location_key, weekday_name

    return v.movements.select(
        "movement_id",
        sku_location_key(F.col("sku_id"), F.concat(F.lit(" "), F.lower("location_code"))).alias("stream_key"),
        weekday_name("occurred_at").alias("weekday"),
        weekday_index("occurred_at").alias("weekday_index"),
        F.date_trunc("hour", "occurred_at").alias("hour_start"),
        F.unix_millis("occurred_at").alias("epoch_ms"),
        month_bucket("occurred_at").alias("month_bucket"),
        sanitize_topic(F.concat_ws("", F.lit("inventory/"), "location_code", F.lit(" #"), "quantity")).alias("safe_topic"),
        short_type_name(F.concat(F.lit("Inventory.Events."), F.col("movement_type"))).alias("short_type"),
    )


@query(
    "name_based_uuids",
    """SELECT movement_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
         || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
       FROM (SELECT movement_id, sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode(movement_id)) AS h FROM v_movement)""",
    "v_movement",
)
def name_based_uuids(v):
    from shelfwise.functions import uuid_v5

    return v.movements.select("movement_id", uuid_v5("movement_id").alias("uuid"))
