"""Exactly-once facts on streams, however late a record arrives.

A micro-batch keeps the first copy of each key and compares with the keys stored before it. Nothing is
dropped for being late: there is no watermark, and stored facts are the state. A copy may bear another time than
the first, or none, so keys are looked up by themselves: an index holds every stored key in directories by its
hash, and a batch opens those that its own keys fall into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order_event_key
from ..model import KEY
from ..operators.demand import daily_demand
from ..operators.keyed import earliest
from ..sources.serving import ServingTable, complete_dirs

NO_DAY = "none"


#: Directories of a key index, each with its share of the keys.
BUCKETS = 64


class FactStore(ServingTable):
    """Facts by key, in directories by day of their time, and the index of their keys beside them.

    The copy of the earliest batch stays. Both are compacted and vacuumed together.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        super().__init__(spark, path, lambda rows: earliest(rows, list(keys), ["batch"]), partitions=("day",))
        self.keys, self.buckets = list(keys), buckets
        first = lambda rows: rows.groupBy("id", "bucket").agg(F.min("batch").alias("batch"))
        self.index = ServingTable(spark, f"{path.rstrip('/')}-keys", first, partitions=("bucket",))

    def identified(self, rows: DataFrame) -> DataFrame:
        """rows with id, the text of their key, and its bucket."""
        text = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        return rows.withColumn("id", text).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def known(self, identified: DataFrame, before: int) -> DataFrame | None:
        """The stored ids of batches before one, in the buckets that some identified rows fall into; no other is opened."""
        self._index_what_is_stored(before)
        stored = self.index.deltas(before)
        if stored is None:
            return None
        touched = [r["bucket"] for r in identified.select("bucket").distinct().collect()]  # at most `buckets`
        return stored.filter(F.col("bucket").isin(touched)).select("id", "bucket")

    def _index_what_is_stored(self, before: int) -> None:
        """Facts written before there was an index get one."""
        base, batches = self._state()
        missing = [b for b in batches if b < before and b not in complete_dirs(self.spark, f"{self.index.path}/deltas", "batch=")]
        if base is not None and not complete_dirs(self.spark, f"{self.index.path}/base", "upto=") or missing:
            rows = self.deltas(before)
            if rows is not None:
                ids = self.identified(rows).select("id", "bucket").distinct()
                last = max([b for b in batches if b < before], default=base)
                self.index._write(ids, f"{self.index.path}/base/upto={last}")

    def write_batch(self, rows: DataFrame, batch_id: int) -> DataFrame:
        stored = super().write_batch(rows, batch_id)
        self.index.write_batch(self.identified(stored).select("id", "bucket"), batch_id)
        return stored

    def compact(self, committed: int | None = None) -> None:
        super().compact(committed)
        self.index.compact(committed)

    def vacuum(self) -> None:
        super().vacuum()
        self.index.vacuum()


def fact_store(spark: SparkSession, path: str, keys: Sequence[str]) -> FactStore:
    return FactStore(spark, path, keys)


def days_of(rows: DataFrame) -> list[str]:
    """The distinct days of a batch: as many as it touches, however large the table is."""
    return [r["day"] for r in rows.select("day").distinct().collect()]


def stored_days(store: ServingTable, days: list[str], before: int | None = None) -> DataFrame | None:
    """Stored facts of some days; other directories aren't opened."""
    rows = store.deltas(before)
    return None if rows is None else rows.filter(F.col("day").cast("string").isin(days))


def store_first(df: DataFrame, store: FactStore, keys: Sequence[str], time: str | None, batch_id: int,
                order: Sequence[Column | str] = ()) -> DataFrame:
    """Stores the rows of a batch whose key is new and returns them as stored.

    Within the batch the first by `order` stays (any, without one). `time` names the day a row is stored under; a copy
    is found whatever its time. A retried batch is compared with the batches before it, so it writes the same again.
    """
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(NO_DAY)) if time else F.lit(NO_DAY)
    rows = df.withColumn("day", day)
    fresh = earliest(rows, list(keys), list(order)) if order else rows.dropDuplicates(list(keys))
    identified = store.identified(fresh)
    known = store.known(identified, batch_id)
    if known is not None:
        fresh = identified.join(known, ["id", "bucket"], "left_anti").select(*rows.columns)
    return store.write_batch(fresh, batch_id)


def with_event_key(events: DataFrame) -> DataFrame:
    """A stock event's own id or, without one, its derived key."""
    key = order_event_key("event_id", "order_id", "sku_id", "location_code", "quantity_depleted")
    return events.withColumn("event_key", key)


def gold_delta(facts: DataFrame) -> DataFrame:
    """What new facts add to the gold rows of their keys and days, early or late."""
    return daily_demand(facts)


def combine_gold(rows: DataFrame) -> DataFrame:
    """Gold rows are sums over facts, so the parts that batches add are summed."""
    return rows.groupBy(*KEY, "date", "weekday").agg(
        F.sum("sale_units").alias("sale_units"), F.sum("movement_count").alias("movement_count")
    )
