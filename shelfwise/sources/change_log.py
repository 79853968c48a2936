"""The change log: topic, partition, offset, timestamp, key, value, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BALANCE_TOPIC, CHANGE_LOG, MOVEMENT_TOPIC


def read_change_log(
    spark: SparkSession,
    path: str | None = None,
    kafka: dict[str, str] | None = None,
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """Committed records from the earliest offset on, from Kafka or from Parquet files."""
    if (path is None) == (kafka is None):
        raise ValueError("give either a path or Kafka options")
    reader = spark.readStream if streaming else spark.read
    if path is not None:
        reader = reader.schema(CHANGE_LOG).format("parquet")
        if streaming and max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.load(path)
    options = {
        "subscribe": f"{MOVEMENT_TOPIC},{BALANCE_TOPIC}",
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "includeHeaders": "true",
        "failOnDataLoss": "true",
        **kafka,
    }
    if streaming and max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return (
        reader.format("kafka")
        .options(**options)
        .load()
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE_LOG.fields])
    )
