"""Nearest items by cosine distance for many query vectors at once.

Vectors are scaled to length one; there, distance is a metric, and squared distance is twice the cosine
distance. A fixed number of items, drawn by hash, are centers. Every item goes to its nearest center, and the
items are ordered over all tasks by (center, distance from it), then cut into blocks of bounded size: rings
round a center, each with its least and greatest distance. A query first searches one block near it, which
bounds its k-th distance; it then opens only rings that the triangle inequality lets hold a nearer item. The
candidates left get their distance from the same expression as a single search.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine_distance
from ..session import scratch_path

# Executors need not have the package: its Python functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Above the rounding of unit vectors, so that no bound excludes an item that ties with the k-th.
SLACK = 1e-6


def _unit(packed) -> np.ndarray:
    x = np.stack([np.frombuffer(v, "<f8") for v in packed])
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _assign(centers: np.ndarray):
    """Adds each vector's packed form, its nearest center and the distance from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            packed = [np.asarray(v, "<f8").tobytes() for v in rows["vector"]]
            if not packed:
                continue
            far = _distances(_unit(packed), centers)
            center = far.argmin(1)
            yield pd.DataFrame(
                {"id": rows["id"], "v": packed, "center": center.astype("int32"), "off": far[np.arange(len(far)), center]}
            )

    return run


def _blocks(block_rows: int):
    """Consecutive items of one center, at most `block_rows` a block; a task holds one block and one batch."""

    def block(rows: pd.DataFrame) -> dict:
        return {
            "center": rows["center"].iloc[0], "low": rows["off"].min(), "high": rows["off"].max(), "n": len(rows),
            "ids": rows["id"].to_numpy("<i8").tobytes(), "vectors": b"".join(rows["v"]),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            groups = [g for _, g in held.groupby("center", sort=False)]
            done = []
            for i, group in enumerate(groups):
                full = len(group) // block_rows * block_rows if i == len(groups) - 1 else len(group)
                done += [block(group.iloc[a : a + block_rows][: full - a]) for a in range(0, full, block_rows)]
                held = group.iloc[full:]
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    return run


def _near(centers: np.ndarray, home: int):
    """Each query's distance from the `home` nearest centers, or from all (0). Which rings it opens is decided by their bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            far = _distances(_unit(rows["v"]), centers)
            if home:
                cut = np.sort(far, 1)[:, min(home, far.shape[1]) - 1]
                at, center = np.nonzero(far <= cut[:, None])
            else:
                at, center = np.nonzero(np.isfinite(far))
            yield pd.DataFrame(
                {"query_id": rows["query_id"].to_numpy()[at], "reach": rows["reach"].to_numpy()[at],
                 "center": center.astype("int32"), "away": far[at, center]}
            )

    return run


def _open(k: int):
    """The items of a block that can be among a query's k nearest: within its reach, and of the block's own k nearest.

    Items at the distance of the k-th stay, of equal vectors the k with the smallest ids.
    """

    def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "id": [], "v": [], "q": [], "approx": []})
        none = none.astype({"query_id": "int64", "id": "int64", "v": object, "q": object, "approx": "float64"})
        if not len(blocks) or not len(queries):
            return none
        one = blocks.iloc[0]
        ids = np.frombuffer(one["ids"], "<i8")
        width = len(one["vectors"]) // len(ids)
        packed = np.array([one["vectors"][i * width : (i + 1) * width] for i in range(len(ids))], dtype=object)
        order = np.argsort(ids, kind="stable")
        copy = pd.Series(packed[order]).groupby(packed[order]).cumcount().to_numpy()
        kept = order[copy < k]
        ids, packed = ids[kept], packed[kept]
        far = _distances(_unit(queries["q"]), _unit(packed))
        kth = np.sort(far, 1)[:, min(k, far.shape[1]) - 1]
        cut = np.minimum(queries["reach"].to_numpy(), kth + SLACK)
        at, item = np.nonzero(far <= cut[:, None])
        return pd.DataFrame(
            {"query_id": queries["query_id"].to_numpy()[at], "id": ids[item], "v": packed[item],
             "q": queries["q"].to_numpy()[at], "approx": far[at, item]}
        )

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for name in ("v", "q"):
            rows[name] = [np.frombuffer(v, "<f8") for v in rows[name]]
        yield rows[["query_id", "id", "v", "q"]]


def usable_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector as doubles): rows with an id and a vector that has a direction.

    Null, empty and all-zero vectors and those with null or non-finite components have no cosine.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    directed = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & ~bad & F.exists(x, lambda c: c != 0.0)
    return df.filter(directed).select(F.col(id_column).cast("long").alias("id"), x.alias("vector"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _searched(blocks: DataFrame, asked: DataFrame, queries: DataFrame, k: int, query_block: int) -> DataFrame:
    """Candidates of the asked (query, block) pairs. A block is repeated once for every `query_block` queries that ask it."""
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
    # No query's vector is in the pairs: it joins after the rings were chosen.
    pairs = asked.join(parts, "block").select("block", part, "query_id", "reach").join(queries.select("query_id", "q"), "query_id")
    copies = blocks.join(parts, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "vectors"
    )
    key = ["block", "part"]
    schema = "query_id long, id long, v binary, q binary, approx double"
    return copies.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInPandas(_open(k), schema)


def _nearest(items: DataFrame, queries: DataFrame, k: int, n_centers: int, block_rows: int, query_block: int) -> DataFrame:
    drawn = items.orderBy(F.xxhash64("id", "vector"), "id").limit(n_centers).collect()
    if not drawn:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, v array<double>, q array<double>, opened long, blocks long")
    centers = _unit([np.asarray(r["vector"], "<f8").tobytes() for r in drawn])
    assigned = items.mapInPandas(_assign(centers), "id long, v binary, center int, off double")
    spark = items.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ordered over all tasks: a center with most of the items, equal ones included, lies in many of them.
    ordered = assigned.repartitionByRange(tasks, "center", "off", "id").sortWithinPartitions("center", "off", "id")
    stored = ordered.mapInPandas(
        _blocks(block_rows), "center int, low double, high double, n long, ids binary, vectors binary"
    ).withColumn("block", F.monotonically_increasing_id())
    blocks = _written(stored, "vector-blocks")
    rings = blocks.select("block", "center", "low", "high", "n")

    asking = queries.mapInPandas(_assign(centers), "id long, v binary, center int, off double")
    asking = _written(asking.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "vector-queries")
    near = "query_id long, reach double, center int, away double"

    def looked_at(reach: DataFrame, home: int) -> DataFrame:
        return reach.withColumnRenamed("q", "v").mapInPandas(_near(centers, home), near).join(rings, "center")

    gap = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"), F.lit(0.0))
    first = (
        looked_at(asking.withColumn("reach", F.lit(float("inf"))), 4)
        .groupBy("query_id")
        .agg(F.min_by("block", F.struct((F.col("n") < k).alias("few"), F.col("away"), gap, F.col("block"))).alias("block"))
        .withColumn("reach", F.lit(float("inf")))
    )
    found = _searched(blocks, first, asking, k, query_block)
    place = Window.partitionBy("query_id").orderBy("approx", "id")
    kth = (
        found.select("query_id", "id", "approx")
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k)
        .groupBy("query_id")
        .agg(F.max("approx").alias("kth"), F.count("*").alias("many"))
        .filter(F.col("many") == k)
    )
    reach = F.coalesce(F.col("kth") + SLACK, F.lit(float("inf")))
    bounded = asking.join(kth, "query_id", "left").select("query_id", "q", reach.alias("reach"))
    pairs = looked_at(bounded, 0).filter(gap <= F.col("reach") + SLACK).select("query_id", "block", "reach")
    asked = _written(pairs, "vector-asked")
    candidates = _searched(blocks, asked, asking, k, query_block)
    whole = candidates.select("query_id", "id", "v", "q").mapInPandas(
        _unpack, "query_id long, id long, v array<double>, q array<double>"
    )
    opened = asked.groupBy("query_id").agg(F.count("*").alias("opened"))
    return whole.join(opened, "query_id").withColumn("blocks", blocks.agg(F.count("*").alias("n")).scalar())


def batch_top_k(
    items: DataFrame, queries: DataFrame, vector: str, id_column: str, query_vector: str | None = None,
    query_id: str | None = None, k: int = 10, centers: int = 64, block_rows: int = 512, query_block: int = 1024,
) -> DataFrame:
    """The k nearest items of every query: query_id, place (from 1), id_column, distance, total_items, opened, blocks.

    Exact: distances are those of `semantic_top_k`, ties go to the smaller id. Ids are whole numbers, unique per side.
    Items and queries without an id or a direction (see `usable_vectors`) take no part; an item meets the queries of its
    own length. `total_items` counts all items, also those. Of a query's `blocks` rings, `opened` could hold a near item.
    Extra columns are ignored. `centers` bounds what reaches the driver; it, `block_rows` and `query_block` change no result.
    A block gives every item that ties with its k-th to within 1e-6, so scaled copies of one vector all become candidates.
    """
    spark = items.sparkSession
    total: Column = items.agg(F.count("*").alias("n")).select("n").scalar()
    usable = usable_vectors(items, id_column, vector)
    asking = usable_vectors(queries, query_id or id_column, query_vector or vector)
    parts = []
    for (length,) in asking.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect():
        same = F.size("vector") == length
        parts.append(_nearest(usable.filter(same), asking.filter(same), k, centers, block_rows, query_block))
    if not parts:
        parts = [spark.createDataFrame([], "query_id long, id long, v array<double>, q array<double>, opened long, blocks long")]
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    place = Window.partitionBy("query_id").orderBy("distance", "id")
    measured = candidates.withColumn("distance", cosine_distance(F.col("v"), F.col("q")))
    return (
        measured.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= k)
        .select(
            "query_id", F.col("place").cast("int").alias("place"), F.col("id").alias(id_column), "distance",
            total.alias("total_items"), "opened", "blocks",
        )
    )
