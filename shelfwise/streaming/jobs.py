"""Micro-batch jobs that keep serving tables current.

Every job writes only deltas named by the batch id. Each delta is a summary that can be merged with
those before and after it, so reading the table gives what one batch run over all records gives,
however the stream was cut into batches and however late a record arrives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import KEY
from ..operators.decode import balances_of, decode_changes, movements_of
from ..operators.demand import rolling_units
from ..operators.orders import chain_lifecycle, combine_lifecycle, lifecycle_maps
from ..operators.state import current_balance, flag_stale_balances, latest_by
from ..sources import lake
from ..sources.serving import ServingTable, complete_dirs
from .dedup import combine_gold, fact_store, gold_delta, store_first, stored_days, with_event_key


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append", available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def balance_table(spark: SparkSession, path: str) -> ServingTable:
    """Reset-aware current balances. A delta of a batch with a snapshot acts as one itself."""
    return ServingTable(
        spark, path, lambda rows: balance_delta(rows, "batch"), lambda rows: current_balance(rows, position="batch")
    )


def balance_delta(changes: DataFrame, position: str = "offset") -> DataFrame:
    """One row per key of a batch: its winner, marked SNAPSHOT when the batch held a snapshot."""
    had_reset = changes.groupBy(*KEY).agg(
        F.bool_or(F.col("operation") == "SNAPSHOT").alias("_reset")
    )
    winners = current_balance(changes, position)
    return winners.join(had_reset, KEY).withColumn(
        "operation", F.when(F.col("_reset"), "SNAPSHOT").otherwise("UPDATE")
    ).drop("_reset")


def keep_balances(changes: DataFrame, table: ServingTable, checkpoint: str, **how) -> StreamingQuery:
    return start(changes, lambda df, n: table.write_batch(balance_delta(df), n), checkpoint, **how)


def fact_table(spark: SparkSession, path: str) -> ServingTable:
    return fact_store(spark, path, ["movement_id"])


def keep_movements(movements: DataFrame, facts: ServingTable, checkpoint: str, **how) -> StreamingQuery:
    """Every movement once, by id."""
    return start(movements, lambda df, n: store_first(df, facts, ["movement_id"], "occurred_at", n), checkpoint, **how)


def event_table(spark: SparkSession, path: str) -> ServingTable:
    return fact_store(spark, path, ["event_key"])


def keep_events(events: DataFrame, table: ServingTable, checkpoint: str, time: str | None = "occurred_at",
                **how) -> StreamingQuery:
    """Every stock event once, by its own id or its derived key; `time` names the day it is stored under."""
    return start(
        events, lambda df, n: store_first(with_event_key(df), table, ["event_key"], time, n), checkpoint, **how
    )


def inbox_table(spark: SparkSession, path: str) -> ServingTable:
    return fact_store(spark, path, ["event_id"])


def keep_inbox(events: DataFrame, table: ServingTable, checkpoint: str, time: str | None = None,
               **how) -> StreamingQuery:
    """First delivery of every message; `time` names the day it is stored under."""
    return start(events, lambda df, n: store_first(df, table, ["event_id"], time, n), checkpoint, **how)


def daily_demand_table(spark: SparkSession, path: str) -> ServingTable:
    return ServingTable(spark, path, combine_gold)


def keep_daily_demand(
    movements: DataFrame, facts: ServingTable, table: ServingTable, checkpoint: str, **how
) -> StreamingQuery:
    """Gold rows of a movement stream: a batch adds its new facts to their days, whichever they are."""

    def handle(df: DataFrame, batch_id: int) -> None:
        fresh = store_first(df, facts, ["movement_id"], "occurred_at", batch_id)
        table.write_batch(gold_delta(fresh), batch_id)

    return start(movements, handle, checkpoint, **how)


def lifecycle_table(spark: SparkSession, path: str) -> ServingTable:
    """Order statuses: each delta is a table of where every status leads."""
    return ServingTable(
        spark, path, lambda rows: combine_lifecycle(rows, "position"), lambda rows: chain_lifecycle(rows, "position")
    )


def keep_order_statuses(events: DataFrame, table: ServingTable, checkpoint: str,
                        position: str = "seq", **how) -> StreamingQuery:
    """Events of one order must arrive in order across batches; within a batch `position` decides."""

    def handle(df: DataFrame, batch_id: int) -> None:
        maps = lifecycle_maps(df, position)
        place = F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("chunk"))
        table.write_batch(maps.withColumn("position", place).drop("chunk"), batch_id)

    return start(events, handle, checkpoint, **how)


def rolling_table(spark: SparkSession, path: str) -> ServingTable:
    return ServingTable(spark, path, lambda rows: latest_by(rows, [*KEY, "occurred_at"], "batch", "batch"))


def touched_buckets(fresh: DataFrame, bucket: int, widest: int) -> DataFrame:
    """Keys and time buckets (seconds // bucket) whose instants the new facts can have changed."""
    at = F.unix_seconds("occurred_at")
    return fresh.select(
        *KEY, F.explode(F.array(F.floor(at / bucket), F.floor((at + widest) / bucket))).alias("_bucket")
    ).distinct()


def keep_rolling_units(
    movements: DataFrame, facts: ServingTable, table: ServingTable, columns: dict[str, tuple[str, int]],
    checkpoint: str, **how,
) -> StreamingQuery:
    """Rolling units of every instant, corrected however late a movement arrives.

    A batch stores its facts and evaluates again only the buckets of their keys that they reach; it reads
    those and the ones before, on their own days. A row a year late touches two buckets, not the year.
    """
    widest = 60 * max(m for _, m in columns.values())
    bucket = max(3600, widest)

    def handle(df: DataFrame, batch_id: int) -> None:
        fresh = store_first(df, facts, ["movement_id"], "occurred_at", batch_id)
        touched = touched_buckets(fresh, bucket, widest)
        needed = touched.select(*KEY, F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)).alias("_bucket")).distinct()
        edges = F.array(F.col("_bucket") * bucket, (F.col("_bucket") + 1) * bucket - 1)
        days = [r["day"] for r in needed.select(F.explode(edges).alias("s")).select(
            F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd").alias("day")).distinct().collect()]
        own = F.floor(F.unix_seconds("occurred_at") / bucket)
        stored = facts.combine(stored_days(facts, days, batch_id + 1)).drop("batch", "day")
        near = stored.withColumn("_bucket", own).join(needed, [*KEY, "_bucket"], "left_semi").drop("_bucket")
        rolled = rolling_units(near, columns).withColumn("_bucket", own)
        table.write_batch(rolled.join(touched, [*KEY, "_bucket"], "left_semi").drop("_bucket"), batch_id)

    return start(movements, handle, checkpoint, **how)


class IngestTables:
    """Where one ingest job keeps bronze, silver, dead letters, facts, balances and its counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.facts = fact_table(spark, f"{self.root}/facts")
        self.balances = balance_table(spark, f"{self.root}/balances")
        self.metrics = metrics_table(spark, f"{self.root}/metrics")

    def batch_path(self, layer: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{layer}" if batch_id is None else f"{self.root}/{layer}/batch={batch_id}"

    def read(self, layer: str, before: int | None = None) -> DataFrame | None:
        """The complete batches of a layer."""
        batches = [b for b in complete_dirs(self.spark, self.batch_path(layer), "batch=") if before is None or b < before]
        if not batches:
            return None
        paths = [self.batch_path(layer, b) for b in batches]
        return self.spark.read.option("basePath", self.batch_path(layer)).parquet(*paths)

    def stored_like(self, df: DataFrame, batch_id: int) -> DataFrame | None:
        """Bronze identities of earlier batches that records of this one can equal.

        A redelivered record has its place and time again. The offset ranges, one a topic and partition of the
        batch, and the batch's days reach the scan; records without a time are looked up among their like.
        """
        stored = self.read("bronze", batch_id)
        spans = df.groupBy("topic", "partition").agg(
            F.min("offset").alias("low"), F.max("offset").alias("high"),
            F.collect_set(F.to_date("timestamp")).alias("days"), F.bool_or(F.col("timestamp").isNull()).alias("undated"),
        ).collect()
        if stored is None or not spans:
            return None
        in_range = reduce(
            lambda a, b: a | b,
            [
                (F.col("topic") == r["topic"]) & (F.col("partition") == r["partition"]) & F.col("offset").between(r["low"], r["high"])
                for r in spans
            ],
        )
        days = sorted({d for r in spans for d in r["days"]})
        parts = [stored.filter(F.col("date").isin(days) & F.col("event_timestamp").isNotNull())] if days else []
        if any(r["undated"] for r in spans):
            parts.append(stored.filter(F.col("event_timestamp").isNull()))
        return reduce(DataFrame.unionByName, [p.filter(in_range).select(*lake.IDENTITY) for p in parts])


def metrics_table(spark: SparkSession, path: str) -> ServingTable:
    """Counts of any number of batches: metric, value."""
    return ServingTable(
        spark, path, lambda rows: rows.groupBy("metric").agg(F.sum("value").alias("value"), F.max("batch").alias("batch"))
    )


def keep_lake(log: DataFrame, tables: IngestTables, checkpoint: str, ingested_at: Column | None = None,
              **how) -> StreamingQuery:
    """Change log -> bronze, dead letters, silver, facts and balance deltas, one decode per batch.

    A record delivered again, in this batch or a later one, is not stored twice. The batch's counts are
    stored with it, see `pipeline_metrics`.
    """
    at = F.current_timestamp() if ingested_at is None else ingested_at

    def write(df: DataFrame, layer: str, batch_id: int, *partitions: str) -> None:
        df.write.mode("overwrite").partitionBy(*partitions).parquet(tables.batch_path(layer, batch_id))

    def handle(df: DataFrame, batch_id: int) -> None:
        known = tables.stored_like(df, batch_id)
        fresh = df.dropDuplicates(lake.IDENTITY) if known is None else lake.new_records(df, known)
        decoded = decode_changes(fresh).persist()
        try:
            bronze = lake.to_bronze(decoded.select(*df.columns), at)
            write(bronze.hint("rebalance", "date", "hour"), "bronze", batch_id, "date", "hour")
            silver = lake.silver_partitions(lake.to_silver(decoded), at)
            write(silver.hint("rebalance", "date", "hour"), "silver", batch_id, "date", "hour")
            write(lake.dead_letters(decoded, at), "dead_letters", batch_id)
            facts = store_first(
                movements_of(decoded), tables.facts, ["movement_id"], "occurred_at", batch_id, ["partition", "offset"]
            )
            tables.balances.write_batch(balance_delta(balances_of(decoded)), batch_id)
            tables.metrics.write_batch(_counts(df, decoded, facts), batch_id)
        finally:
            decoded.unpersist()

    return start(log, handle, checkpoint, **how)


def _counts(received: DataFrame, decoded: DataFrame, facts: DataFrame) -> DataFrame:
    """metric, value rows of one batch."""
    kind, good = F.col("event_kind"), F.col("decode_error").isNull()
    of = decoded.agg(
        F.count(F.lit(1)).alias("bronze_written"),
        F.count(F.when(good, 1)).alias("silver_written"),
        F.count("decode_error").alias("dead_letters"),
        F.count(F.when(kind == "movement", 1)).alias("movements"),
        F.count(F.when(kind == "balance", 1)).alias("balances"),
        F.count(F.when(kind.isin("movement_delete", "balance_delete"), 1)).alias("deletes"),
        F.count(F.when(kind == "tombstone", 1)).alias("tombstones"),
    ).first().asDict()
    consumed, stored = received.count(), facts.count()
    of |= {
        "consumed": consumed, "bronze_duplicates": consumed - of["bronze_written"],
        "facts_written": stored, "duplicate_movements": of["movements"] - stored,
    }
    return received.sparkSession.createDataFrame(sorted(of.items()), "metric string, value long")


def pipeline_metrics(tables: IngestTables) -> dict[str, int]:
    """Counts of an ingest job so far, over all its batches, and the stale balance changes among what it stored."""
    rows = tables.metrics.read()
    counts = {} if rows is None else {r["metric"]: r["value"] for r in rows.collect()}
    silver = tables.read("silver")
    if silver is not None:
        changes = silver.filter("event_type = 'INVENTORY_BALANCE'").select(
            *KEY, F.col("balance_version").alias("version"), F.col("cdc_operation").alias("operation"),
            F.col("source_offset").alias("offset"),
        )
        counts["stale_balances"] = flag_stale_balances(changes).filter("outcome = 'STALE'").count()
    return counts
