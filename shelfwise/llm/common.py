"""Shared folder, shipping of this package to executors, and small Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that were started elsewhere (as --py-files would)."""
    context = spark.sparkContext
    if getattr(context, "_shelfwise_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="shelfwise-")
    archive = os.path.join(folder, "shelfwise_llm.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for name in ("__init__.py", *(f"llm/{f}" for f in os.listdir(f"{_PACKAGE}/llm") if f.endswith(".py"))):
            out.write(f"{_PACKAGE}/{name}", f"shelfwise/{name}")
    context.addPyFile(archive)
    context._shelfwise_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset on one machine (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shelfwise-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    # A path without a scheme lies in the cluster's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate path that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column: sizes that partition counts are derived from."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


_HELD: dict[object, object] = {}


def held(name: object, make):
    """A cache that this worker process keeps between tasks: one at a time, another name's is given up."""
    if name not in _HELD:
        _HELD.clear()
        release_unused()
        _HELD[name] = make()
    return _HELD[name]


def release_unused() -> None:
    """Gives freed memory of this process back to the machine: workers live on between the steps of a job."""
    for pool in {p.backend_name: p for p in (pa.default_memory_pool(), pa.system_memory_pool())}.values():
        pool.release_unused()


def slices(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch holding about `limit` characters each, so that long texts don't pile up."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )
