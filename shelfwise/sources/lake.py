"""Bronze, silver and gold tables.

Writers rebalance by their partition columns: small partitions share a task, and a hot hour is
split over several tasks and files by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import month_bucket, sanitize_topic
from ..model import (
    BRONZE, GOLD_DAILY_DEMAND_SCHEMA_VERSION, RAW_EVENT_SCHEMA_VERSION, SILVER,
    SILVER_EVENT_SCHEMA_VERSION, SILVER_REQUIRED,
)

IDENTITY = ["topic", "partition", "offset"]


def stable_id(topic="topic", partition="partition", offset="offset") -> Column:
    return F.concat_ws(":", F.col(topic), F.col(partition), F.col(offset))


def _base64(value: Column | str) -> Column:
    """Unbroken base64 text: Spark may fold long lines."""
    return F.translate(F.base64(value), "\r\n", "")


def to_bronze(log: DataFrame, ingested_at: Column) -> DataFrame:
    """Every record as received, tombstones included, with its partition columns."""
    headers = F.transform(
        F.coalesce(F.col("headers"), F.array().cast(log.schema["headers"].dataType)),
        lambda h: F.struct(h["key"].alias("key"), _base64(h["value"]).alias("value_base64")),
    )
    at = F.coalesce("event_timestamp", "ingestion_timestamp")
    return (
        log.withColumn("event_timestamp", F.col("timestamp"))
        .withColumn("ingestion_timestamp", ingested_at.cast("timestamp"))
        .select(
            *IDENTITY,
            "event_timestamp",
            _base64("key").alias("key_base64"),
            _base64("value").alias("value_base64"),
            F.col("value").isNull().alias("value_is_null"),
            F.to_json(headers, {"ignoreNullFields": "false"}).alias("headers_json"),
            "ingestion_timestamp",
            F.lit(RAW_EVENT_SCHEMA_VERSION).alias("schema_version"),
            F.to_date(at).alias("date"),
            F.hour(at).alias("hour"),
        )
    )


def new_records(incoming: DataFrame, stored: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """Records not stored yet; a re-delivery inside the batch keeps one copy."""
    fresh = incoming.join(stored.select(*identity).distinct(), identity, "left_anti")
    return fresh.dropDuplicates(identity)


def write_bronze(bronze: DataFrame, path: str) -> None:
    (
        bronze.withColumn("topic_dir", sanitize_topic("topic"))
        .hint("rebalance", "topic_dir", "date", "hour")
        .write.mode("append")
        .partitionBy("topic_dir", "date", "hour")
        .parquet(path)
    )


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*BRONZE.fields, T.StructField("topic_dir", T.StringType())])).parquet(path).drop("topic_dir")


def to_silver(decoded: DataFrame) -> DataFrame:
    """Sixteen typed columns per decoded change; failed decodes are left to the dead letters."""
    kind = F.col("event_kind")
    movement, balance = kind == "movement", kind == "balance"
    m, b = F.col("movement"), F.col("balance")
    event_type = (
        F.when(movement, "INVENTORY_MOVEMENT")
        .when(balance, "INVENTORY_BALANCE")
        .when(kind == "movement_delete", "INVENTORY_MOVEMENT_DELETE")
        .when(kind == "balance_delete", "INVENTORY_BALANCE_DELETE")
        .otherwise(F.concat(F.lit("KAFKA_TOMBSTONE:"), F.col("topic")))
    )
    version = F.lit(SILVER_EVENT_SCHEMA_VERSION)
    return decoded.filter(F.col("decode_error").isNull()).select(
        stable_id().alias("event_id"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        F.col("operation").alias("cdc_operation"),
        event_type.alias("event_type"),
        F.coalesce(m["sku_id"], b["sku_id"]).alias("sku_id"),
        F.coalesce(m["location_code"], b["location_code"]).alias("location_code"),
        m["movement_type"].alias("movement_type"),
        m["quantity"].alias("quantity"),
        F.coalesce(m["occurred_at"], b["updated_at"]).alias("occurred_at"),
        F.coalesce(m["resulting_balance_version"], b["version"]).alias("balance_version"),
        b["on_hand"].alias("on_hand"),
        b["reserved"].alias("reserved"),
        b["available"].alias("available"),
        F.when(kind == "movement_delete", F.concat_ws(":", version, F.col("deleted_movement_id")))
        .otherwise(version)
        .alias("schema_version"),
    )


def silver_partitions(silver: DataFrame, ingested_at: Column) -> DataFrame:
    """Date and hour of the event time; rows without one use the ingestion time."""
    at = F.coalesce(F.col("occurred_at"), ingested_at.cast("timestamp"))
    return silver.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))


def write_silver(silver: DataFrame, path: str, ingested_at: Column) -> None:
    (
        silver_partitions(silver, ingested_at)
        .hint("rebalance", "date", "hour")
        .write.mode("append")
        .partitionBy("date", "hour")
        .parquet(path)
    )


def read_silver(
    spark: SparkSession, path: str, strict: bool = True, days: tuple[str, str] | None = None
) -> DataFrame:
    """All silver rows below `path`; a null in a required column fails the job.

    `days` (first, last) reads only those date partitions.
    """
    partitioned = T.StructType([*SILVER.fields, T.StructField("date", T.DateType()), T.StructField("hour", T.IntegerType())])
    silver = spark.read.schema(partitioned).parquet(path)
    if days is not None:
        silver = silver.filter(F.col("date").between(*[F.lit(d).cast("date") for d in days]))
    silver = silver.drop("date", "hour")
    return required_not_null(silver, SILVER_REQUIRED) if strict else silver


def required_not_null(df: DataFrame, columns) -> DataFrame:
    def check(name: str) -> Column:
        message = F.lit(f"null in required column {name}")
        return F.coalesce(F.col(name), F.raise_error(message).cast(df.schema[name].dataType))

    return df.withColumns({c: check(c) for c in columns})


def write_facts(facts: DataFrame, path: str, time: str = "occurred_at") -> None:
    """Appends facts filed by the month of their time; those without one go to the null partition.

    A month with most of the facts is split over several files of moderate size.
    """
    filed = facts.withColumn("month", month_bucket(time))
    filed.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def read_facts(spark: SparkSession, path: str, schema: T.StructType, months: tuple[str, str] | None = None) -> DataFrame:
    """Facts with their `month`; `months` (first, last, as yyyyMM) reads only those partitions."""
    filed = spark.read.schema(T.StructType([*schema.fields, T.StructField("month", T.StringType())])).parquet(path)
    return filed if months is None else filed.filter(F.col("month").between(*months))


def write_gold(daily: DataFrame, path: str) -> None:
    (
        daily.withColumn("schema_version", F.lit(GOLD_DAILY_DEMAND_SCHEMA_VERSION))
        .hint("rebalance", "date")
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(path)
    )


def dead_letters(decoded: DataFrame, recorded_at: Column) -> DataFrame:
    """Records that failed to decode, with the reason and the payload text."""
    return decoded.filter(F.col("decode_error").isNotNull()).select(
        *IDENTITY,
        F.col("decode_error").alias("error"),
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("payload"),
        recorded_at.cast("timestamp").alias("recorded_at"),
    )


def explode_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Newline-delimited JSON rows; blank lines are dropped, a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
