"""Serving tables: per-batch deltas, merged when read, compacted now and then.

A micro-batch writes one directory named by its id, so a retried batch replaces its own output and
nothing else, and its cost follows the batch, not the table. A table has two rules. `combine` is
associative: it turns any deltas, in batch order, into one that stands for them all. `render` turns
combined rows into the table's current rows. Compaction combines base and deltas into a new base.
Directories count from the moment their write is complete; what a crash left behind is ignored and
written over. Only the newest batch of a stream can be retried, so a compaction leaves it out: a retry
then still finds all that came before it, apart from itself. `vacuum` removes what a newer base stands for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "_SUCCESS"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop)


def complete_dirs(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the directories below `path` whose write is complete."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    done = [n for n in names if n.startswith(prefix) and path_exists(spark, f"{path}/{n}/{_DONE}")]
    return sorted(int(n[len(prefix):]) for n in done)


def has_files(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hadoop))


class ServingTable:
    """`combine` and `render` see deltas with their `batch` number; `partitions` are directory columns of a delta."""

    def __init__(
        self, spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame],
        render: Callable[[DataFrame], DataFrame] | None = None, partitions: tuple[str, ...] = (),
    ):
        self.spark, self.path, self.combine = spark, path.rstrip("/"), combine
        self.render, self.partitions = render or combine, partitions

    def _write(self, rows: DataFrame, path: str) -> None:
        writer = (rows.hint("rebalance", *self.partitions) if self.partitions else rows).write.mode("overwrite")
        writer.partitionBy(*self.partitions).parquet(path)

    def write_batch(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Writes a delta and returns it as stored."""
        path = f"{self.path}/deltas/batch={batch_id}"
        self._write(rows, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/deltas/batch={batch_id}")

    def _state(self) -> tuple[int | None, list[int]]:
        bases = complete_dirs(self.spark, f"{self.path}/base", "upto=")
        base = bases[-1] if bases else None
        batches = complete_dirs(self.spark, f"{self.path}/deltas", "batch=")
        return base, [b for b in batches if base is None or b > base]

    def deltas(self, before: int | None = None) -> DataFrame | None:
        """Base rows (numbered as their last batch) and the deltas after them, `before` a batch where given.

        What came before a batch that a base already stands for can't be told any more: that is an error.
        """
        base, batches = self._state()
        if base is not None and before is not None and before <= base:
            raise ValueError(f"{self.path}: batch {before} is folded into the base up to {base}")
        parts = []
        if base is not None:
            rows = self.spark.read.parquet(f"{self.path}/base/upto={base}")
            parts.append(rows.withColumn("batch", F.lit(base).cast("long")))
        # A partitioned delta without rows has no files, and so no schema.
        batches = [
            b for b in batches
            if (before is None or b < before) and (not self.partitions or has_files(self.spark, f"{self.path}/deltas/batch={b}"))
        ]
        if batches:
            read = self.spark.read.option("basePath", f"{self.path}/deltas").parquet(
                *[f"{self.path}/deltas/batch={b}" for b in batches]
            )
            parts.append(read.withColumn("batch", F.col("batch").cast("long")))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self) -> DataFrame | None:
        rows = self.deltas()
        return None if rows is None else self.render(rows).drop("batch")

    def compact(self, committed: int | None = None) -> None:
        """Writes a base that stands for the deltas up to `committed`; a reader keeps what it has opened.

        committed: the last batch that its stream has committed. Without it, all complete deltas but the newest:
        a stream starts a batch after the one before it is committed.
        """
        _, batches = self._state()
        batches = batches[:-1] if committed is None else [b for b in batches if b <= committed]
        if batches:
            self._write(self.combine(self.deltas(batches[-1] + 1)).drop("batch"), f"{self.path}/base/upto={batches[-1]}")

    def vacuum(self) -> None:
        """Removes older bases and the deltas that the newest base stands for; run it when no reader is left on them."""
        bases = complete_dirs(self.spark, f"{self.path}/base", "upto=")
        if bases:
            batches = complete_dirs(self.spark, f"{self.path}/deltas", "batch=")
            old = [f"base/upto={b}" for b in bases[:-1]] + [f"deltas/batch={b}" for b in batches if b <= bases[-1]]
            for name in old:
                hadoop, fs = _file_system(self.spark, f"{self.path}/{name}")
                fs.delete(hadoop, True)


def write_current(spark: SparkSession, path: str, keys: list[str], version: str) -> ServingTable:
    """Last-wins upsert table: highest version per key, the later batch wins ties."""
    from ..operators.state import latest_by

    return ServingTable(spark, path, lambda rows: latest_by(rows, keys, version, "batch"))
