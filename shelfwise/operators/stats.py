"""Series statistics, exact percentiles, load-run summaries and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact_mean
from .keyed import running, value_positions


def describe_series(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, min, max, median and trend slope per key.

    The slope is the least-squares slope over positions 0..n-1. `series` holds one row per key
    and `order` value, such as one per day, so a group is as long as the calendar.
    """
    y = F.col(value).cast("double")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return (
        series.withColumn("_y", y)
        .withColumn("_x", place.cast("double"))
        .groupBy(*keys)
        .agg(
            F.count("_y").alias("n"),
            F.avg("_y").alias("mean"),
            F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("stddev"),
            F.min("_y").alias("min"),
            F.max("_y").alias("max"),
            F.median("_y").alias("median"),
            F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("trend_slope"),
        )
    )


#: Logarithm of a distinct sketch's registers: 16,384 of them, about 0.8 % standard error.
DISTINCT_BITS = 14
#: Cut points of a key's values; a wanted rank lies between two that are three steps apart.
CUTS = 256
# Rank error of the cut points, as a share of the rows: far below a step.
_ACCURACY = 10_000


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics: `ranks` maps a name to a 1-based rank computed from `_total`.

    A mergeable quantile sketch gives cut points of each key's values, and those around a rank bracket it. Rows below
    a bracket are only counted, rows above it are left out, so what is ordered is about a hundredth of the rows a
    rank, and that in pieces of the bracket: neither a hot key nor a global percentile is sorted in one task.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    points = F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], _ACCURACY)
    sketched = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), points.alias("_q"))

    def bracket(name: str, rank: Column) -> Column:
        low = F.greatest(F.floor((rank - 1) * CUTS / F.col("_total")).cast("int") - 1, F.lit(0))
        high = F.least(F.ceil(rank * CUTS / F.col("_total")).cast("int") + 1, F.lit(CUTS))
        return F.struct(
            F.lit(name).alias("name"), rank.cast("long").alias("rank"), F.get("_q", low).alias("low"), F.get("_q", high).alias("high")
        )

    brackets = sketched.select(*keys, F.array(*[bracket(n, r) for n, r in ranks.items()]).alias("_brackets"))
    if keys:
        met = rows.join(brackets, keys)
    else:
        met = rows.withColumn("_brackets", brackets.select("_brackets").scalar())
    met = met.select(*keys, "_v", F.explode(F.filter("_brackets", lambda b: F.col("_v") <= b["high"])).alias("_b"))
    below = F.col("_v") < F.col("_b.low")
    of_bracket = [*keys, "name", "rank", "low", "high"]
    counts = met.select(*keys, "_b.*", F.when(~below, F.col("_v")).alias("_v")).groupBy(*of_bracket, "_v").agg(F.count(F.lit(1)).alias("_n"))
    width = (F.col("high") - F.col("low")).cast("double")
    part = F.floor((F.col("_v") - F.col("low")).cast("double") * 64 / F.when(width > 0, width))
    placed = value_positions(counts, [*keys, "name"], "_v", "_n", F.coalesce(part, F.when(F.col("_v").isNull(), -1).otherwise(0)))
    hit = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("_n") < F.col("rank")) & F.col("_v").isNotNull()
    wanted = [F.max(F.when(hit & (F.col("name") == n), F.col("_v"))).alias(n) for n in ranks]
    found = placed.groupBy(*keys).agg(*wanted, F.count_if(hit).alias("_found"), F.count(F.lit(1)).alias("_rows"))
    # A rank outside its bracket would mean a sketch beyond its stated error; better no answer than a wrong one.
    sound = (F.col("_found") == len(ranks)) | (F.col("_rows") == 0)
    checked = F.when(sound, True).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("boolean"))
    return found.filter(checked).drop("_found", "_rows")


def nearest_rank_percentiles(df: DataFrame, value: str, percentiles: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """sorted[ceil(p * n) - 1] per name; 0 for an empty input without keys."""
    total = F.col("_total")
    ranks = {
        name: F.least(F.greatest(F.ceil(F.lit(p) * total), F.lit(1)), total) for name, p in percentiles.items()
    }
    return _at_ranks(df, keys or [], value, ranks).fillna(0, list(percentiles))


def rounded_index_percentiles(df: DataFrame, value: str, percentiles: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """sorted[round(p * (n - 1))], halves away from zero."""
    total = F.col("_total")
    ranks = {
        name: F.floor(F.lit(p) * (total - 1) + 0.5).cast("long") + 1 for name, p in percentiles.items()
    }
    return _at_ranks(df, keys or [], value, ranks).fillna(0, list(percentiles))


def load_run_summary(requests: DataFrame, window_seconds: float) -> DataFrame:
    """One row about a load run.

    `requests` has request_id, lines, units, outcome (ACCEPTED, TIMEOUT, DROPPED or another
    failure) and latency_ms (null for dropped requests). Duplicates are counted through one row
    per id, so no task sees all ids.
    """
    outcome = F.col("outcome")
    per_id = requests.groupBy("request_id").agg(
        F.count("*").alias("offered"),
        F.sum("lines").alias("lines"),
        F.sum("units").alias("units"),
        F.count(F.when(outcome == "ACCEPTED", 1)).alias("accepted"),
        F.count(F.when(~outcome.isin("ACCEPTED", "TIMEOUT", "DROPPED"), 1)).alias("failures"),
        F.count(F.when(outcome == "TIMEOUT", 1)).alias("timeouts"),
        F.count(F.when(outcome == "DROPPED", 1)).alias("dropped"),
        F.sum("latency_ms").alias("latency_sum"),
        F.count("latency_ms").alias("latencies"),
    )
    names = ("offered", "lines", "units", "accepted", "failures", "timeouts", "dropped", "latency_sum", "latencies")
    zero = F.lit(0).cast("long")
    totals = per_id.agg(
        *[F.coalesce(F.sum(n), zero if n != "latency_sum" else F.lit(0.0)).alias(n) for n in names],
        F.count("*").alias("ids"),
    )
    latency = nearest_rank_percentiles(
        requests, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    )
    per_second = F.col("offered") / F.lit(float(window_seconds)) if window_seconds > 0 else F.lit(0.0)
    latency = latency.select(F.struct("p50_ms", "p95_ms", "p99_ms").alias("all")).scalar()
    return totals.withColumn("_latency", latency).select(
        "offered",
        per_second.alias("offered_per_second"),
        "accepted", "failures", "timeouts", "dropped",
        (F.col("offered") - F.col("ids")).alias("duplicate_ids"),
        exact_mean(F.col("lines"), F.col("offered")).alias("avg_lines"),
        exact_mean(F.col("units"), F.col("offered")).alias("avg_units"),
        exact_mean(F.col("latency_sum"), F.col("latencies")).alias("avg_ms"),
        "_latency.p50_ms", "_latency.p95_ms", "_latency.p99_ms",
    )


def load_run_counts(requests: DataFrame) -> DataFrame:
    """Requests per status code and per location, as (dimension, value, requests)."""
    pair = F.array(
        F.struct(F.lit("status").alias("dimension"), F.col("status").cast("string").alias("value")),
        F.struct(F.lit("location").alias("dimension"), F.col("location_code").alias("value")),
    )
    return (
        requests.select(F.inline(pair))
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count("*").alias("requests"))
    )


def max_in_flight(requests: DataFrame, start: str = "started_at", end: str = "ended_at",
                  bucket_seconds: int = 60) -> DataFrame:
    """Peak number of requests running at once; an end frees its slot before a start takes one."""
    steps = requests.select(
        F.inline(
            F.array(
                F.struct(F.col(start).alias("at"), F.lit(1).alias("step"), F.lit(1).alias("rank")),
                F.struct(F.col(end).alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("rank")),
            )
        )
    )
    net = steps.groupBy("at", "rank").agg(F.sum("step").alias("step"))
    bucket = F.floor(F.unix_micros("at") / (bucket_seconds * 1_000_000))
    level = running(net, [], ["at", "rank"], bucket, sums={"in_flight": F.col("step")})
    return level.agg(F.coalesce(F.max("in_flight"), F.lit(0).cast("long")).alias("max_in_flight"))


def status_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def fact_distinct_check(facts: DataFrame, key: str = "movement_id", approximate: bool = False) -> DataFrame:
    """Rows against distinct ids; the exact form counts through one row per id."""
    if approximate:
        return facts.agg(F.count("*").alias("rows"), F.approx_count_distinct(key).alias("ids"))
    per_id = facts.groupBy(key).agg(F.count("*").alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"), F.count(key).alias("ids")
    ).withColumn("duplicates", F.col("rows") - F.col("ids"))


def distinct_sketches(facts: DataFrame, identity: str = "movement_id", time: str = "occurred_at") -> DataFrame:
    """day, ids (a mergeable sketch of the day's distinct identities), n_rows; null identities don't count.

    A sketch has a few kilobytes whatever it stands for, so days, batches and stored tables are united without
    reading facts again. Copies of an identity count once, also across what is united. The day is null for facts without one.
    """
    return facts.groupBy(F.to_date(time).alias("day")).agg(
        F.hll_sketch_agg(identity, DISTINCT_BITS).alias("ids"), F.count(F.lit(1)).alias("n_rows")
    )


def united_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of any batches, one a day: the combining rule of a serving table of them."""
    return sketches.groupBy("day").agg(F.hll_union_agg("ids").alias("ids"), F.sum("n_rows").alias("n_rows"))


def distinct_over(sketches: DataFrame, since=None, until=None) -> DataFrame:
    """ids, n_rows: estimated distinct identities and counted rows of the days from since to until, both included."""
    days = sketches
    if since is not None:
        days = days.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.filter(F.col("day") <= F.lit(until).cast("date"))
    return days.agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("ids")), F.lit(0)).alias("ids"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
    )


def distinct_error(facts: DataFrame, sketches: DataFrame, identity: str = "movement_id", time: str = "occurred_at") -> DataFrame:
    """day, exact, estimate, error: the sketches' estimates beside exact counts, the error as a share of the exact one."""
    exact = facts.groupBy(F.to_date(time).alias("day")).agg(F.count_distinct(identity).alias("exact"))
    found = united_sketches(sketches).select("day", F.hll_sketch_estimate("ids").alias("estimate"))
    same = exact["day"].eqNullSafe(found["day"])
    error = F.abs(F.col("estimate") - F.col("exact")) / F.greatest(F.col("exact"), F.lit(1))
    return exact.join(found, same).select(exact["day"], "exact", "estimate", error.alias("error"))
