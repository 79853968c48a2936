"""Streaming jobs run over the given tables, a few batches each; what they store must equal the batch SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.model import KEY
from shelfwise.session import scratch_path
from shelfwise.streaming import jobs, keyed_state

from .demand import ROLLING, rolling_sql
from .orders_and_audit import lifecycle_events
from .registry import SQL, query

BATCHES = 4
ROWS_A_TASK, LEAST_ROWS_A_TASK = 250_000, 10_000


@contextmanager
def _partitions_for(spark: SparkSession, rows: int):
    """State and shuffle partitions by the rows of a batch, while a stream runs: as many as there are cores, if rows suffice."""
    name = "spark.sql.shuffle.partitions"
    kept = spark.conf.get(name)
    cores = min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS_A_TASK)
    spark.conf.set(name, str(max(4, cores, rows // ROWS_A_TASK)))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def _run(df: DataFrame, batch: Column, name: str, begin) -> None:
    """Adds df to a folder a batch at a time, in order; after each, `begin(stream, root)` reads what is new to the end."""
    spark, root = df.sparkSession, scratch_path(df.sparkSession, name)
    df.withColumn("_batch", batch).write.partitionBy("_batch").parquet(f"{root}/numbered")
    read = spark.read.parquet(f"{root}/numbered")
    with _partitions_for(spark, read.count() // BATCHES):
        for n in range(BATCHES):
            read.filter(F.col("_batch") == n).drop("_batch").write.mode("append").parquet(f"{root}/in")
            running = begin(spark.readStream.schema(df.schema).parquet(f"{root}/in"), root)
            running.awaitTermination()
            if running.exception() is not None:
                raise running.exception()


def _shuffled(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BATCHES)).cast("int")


@query("streamed_daily_demand", SQL["gold_from_late_batches"])
def streamed_daily_demand(v):
    """Facts in no order, a third of them twice: each counts once, on its own day."""
    facts = v.event_movements
    twice = facts.withColumn("copy", F.explode(F.when(F.col("arrival") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tables = []

    def begin(stream, root):
        store, table = jobs.fact_table(v.spark, f"{root}/facts"), jobs.daily_demand_table(v.spark, f"{root}/gold")
        tables.append(table)
        return jobs.keep_daily_demand(stream.drop("copy"), store, table, f"{root}/checkpoint")

    _run(twice, _shuffled("movement_id", "copy"), "streamed-demand", begin)
    return tables[0].read()


@query("streamed_rolling_units", rolling_sql("v_event_movement", distinct=True), "v_event_movement")
def streamed_rolling_units(v):
    """Windows of every instant, corrected by facts that come late."""
    from shelfwise.operators.lookups import evaluated_movements

    tables = []

    def begin(stream, root):
        store, table = jobs.fact_table(v.spark, f"{root}/facts"), jobs.rolling_table(v.spark, f"{root}/rolling")
        tables.append(table)
        return jobs.keep_rolling_units(stream, store, table, ROLLING, f"{root}/checkpoint")

    _run(evaluated_movements(v.event_movements), _shuffled("movement_id"), "streamed-rolling", begin)
    return tables[0].read().select(*KEY, "occurred_at", *ROLLING)


@query(
    "streamed_balances",
    f"SELECT sku_id, location_code, on_hand, reserved, available, version FROM ({SQL['current_balance']})",
)
def streamed_balances(v):
    """Balances held as operator state, batch after batch of the log."""
    keyed_state.use_rocksdb(v.spark)
    changes = v.balance_changes
    last = changes.agg(F.max("offset")).first()[0] or 0
    batch = F.least(F.floor(F.col("offset") * BATCHES / (last + 1)), F.lit(BATCHES - 1)).cast("int")
    tables = []

    def begin(stream, root):
        table = keyed_state.newest_table(v.spark, f"{root}/balances", KEY)
        tables.append(table)
        return keyed_state.keep_newest(keyed_state.balance_states(stream), table, f"{root}/checkpoint")

    _run(changes, batch, "streamed-balances", begin)
    return tables[0].read().select(*KEY, "on_hand", "reserved", "available", "version")


@query("streamed_order_statuses", SQL["order_status_replay"])
def streamed_order_statuses(v):
    """Order events in no order: those ahead wait in the state for those before them."""
    keyed_state.use_rocksdb(v.spark)
    counted = lifecycle_events(v).withColumn("seq", F.row_number().over(Window.partitionBy("order_id").orderBy("seq")).cast("long"))
    tables = []

    def begin(stream, root):
        table = keyed_state.newest_table(v.spark, f"{root}/orders", ["order_id"])
        tables.append(table)
        return keyed_state.keep_newest(keyed_state.lifecycle_states(stream, first=1), table, f"{root}/checkpoint")

    _run(counted, _shuffled("order_id", "seq"), "streamed-orders", begin)
    return tables[0].read().select("order_id", "status", "illegal_moves")
