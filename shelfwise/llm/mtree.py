"""Exact top-k by inner product through an M-tree with best-first search.

A vector x of norm |x| <= R becomes the point (x, sqrt(R^2 - |x|^2)), a query q the point (q, 0). Then
distance^2 = R^2 + |q|^2 - 2 q.x, so nearest points are largest inner products, in a metric.

The tree has three levels. Cells: each point belongs to the nearest of a bounded number of pivots, which grows with
the table. Shards: a cell's points in the order of their distance from its pivot, cut into rings of bounded size; a
ring keeps its least and greatest distance to the parent and is one stored row. Leaves: pages of a shard, with a
routing point, a covering radius and each object's distance to it. A query first searches the shard that its own
row lies in, which bounds its k-th best. It then visits the rings that the triangle inequality doesn't exclude by
their distances to the parent, in each the leaves in order of their least possible distance, and computes an object's
distance only where |d(query, leaf) - d(object, leaf)| is below the bound. Bounds carry a slack above rounding; scores
are exact integers. A shard is read as often as `query_block` goes into the queries that visit it, rounded up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, materialized, ship, shuffle_partitions

_LEAF = 64
_SLACK = 1e-6
_LEAST = -(1 << 62)
_NO_ID = np.iinfo(np.int64).max
_ASSIGNED = pa.schema(
    [("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("cell", pa.int32()), ("off", pa.float64())]
)
_STORED = (
    "cell int, low double, high double, rows binary, ids binary, vectors binary, ends binary, centers binary, radius binary, "
    "to_center binary, asks array<struct<row:long,vec_id:long,v:binary,bound:long>>"
)
_ROUTED = pa.schema([("row", pa.int64()), ("bound", pa.int64()), ("cell", pa.int32()), ("away", pa.float64()), ("reach", pa.float64())])
_MOST_PIVOTS = 1024


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<i8") for v in values])


def lifted(x: np.ndarray, square: int) -> np.ndarray:
    """Points of the metric space; square: R^2."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def slack(square: int) -> float:
    """Above the rounding of distances, which is worst between near points far from the origin."""
    return _SLACK * (1 + square**0.5)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floats where no sum can exceed their whole numbers."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def leaves(points: np.ndarray, size: int = _LEAF) -> list[np.ndarray]:
    """Row numbers of pages of at most `size` near points: halved between two far points until small enough."""
    pages, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            pages.append(rows)
            continue
        own = points[rows]
        one = int(distances(own[:1], own)[0].argmax())
        to_one = distances(own[one : one + 1], own)[0]
        lean = to_one - distances(own[int(to_one.argmax())][None], own)[0]
        order = np.argsort(lean, kind="stable")  # halves of equal size also where all points are equal
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return pages


class Shard:
    """One stored subtree: pages of objects with routing point, radius and distances to it."""

    def __init__(self, rows, ids, vectors, ends, centers, radius, to_center):
        self.rows, self.ids, self.vectors, self.centers, self.radius, self.to_center = rows, ids, vectors, centers, radius, to_center
        self.spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, square: int) -> Shard:
        pages = leaves(lifted(vectors, square))
        order, ends = np.concatenate(pages), np.cumsum([len(p) for p in pages])
        points = lifted(vectors[order], square)
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        centers = np.stack([points[a:b].mean(0) for a, b in spans])
        to_center = np.concatenate([distances(c[None], points[a:b])[0] for c, (a, b) in zip(centers, spans)])
        radius = np.array([to_center[a:b].max() for a, b in spans])
        return cls(rows[order], ids[order], vectors[order], ends.astype(np.int64), centers, radius, to_center)

    def stored(self) -> dict[str, bytes]:
        ends = np.array([b for _, b in self.spans], np.int64)
        parts = {"rows": self.rows, "ids": self.ids, "vectors": self.vectors, "ends": ends, "centers": self.centers}
        parts |= {"radius": self.radius, "to_center": self.to_center}
        return {k: np.ascontiguousarray(x).tobytes() for k, x in parts.items()}

    @classmethod
    def loaded(cls, one: dict) -> Shard:
        rows, ids, ends = (np.frombuffer(one[k], "<i8") for k in ("rows", "ids", "ends"))
        centers, radius, to_center = (np.frombuffer(one[k], "<f8") for k in ("centers", "radius", "to_center"))
        return cls(
            rows, ids, np.frombuffer(one["vectors"], "<i8").reshape(len(rows), -1), ends,
            centers.reshape(len(ends), -1), radius, to_center,
        )

    def search(self, queries: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, square: int):
        """Best k (scores, ids) of each query, own row excluded, among objects that can reach `bound`.

        bound: the score of a known k-th best, or the least integer. A query takes the leaves nearest first and
        stops at the first leaf that can't hold an object as good as its k-th best.
        """
        n = len(queries)
        points = np.hstack([queries.astype(np.float64), np.zeros((n, 1))])
        norms = (points * points).sum(1)
        scores, ids = np.full((n, k), _LEAST), np.full((n, k), _NO_ID)
        to_leaf = distances(points, self.centers)
        least = to_leaf - self.radius[None]
        order = np.argsort(least, axis=1, kind="stable")
        kth, active = bound.copy(), np.arange(n)
        for step in range(len(self.spans)):
            reach = np.sqrt(np.maximum(square + norms[active] - 2.0 * kth[active], 0)) * (1 + _SLACK) + slack(square)
            page = order[active, step]
            going = least[active, page] <= reach
            active, page, reach = active[going], page[going], reach[going]
            if not len(active):
                break
            for leaf in np.unique(page):
                here = page == leaf
                who, (a, b) = active[here], self.spans[leaf]
                gap = np.abs(to_leaf[who, leaf][:, None] - self.to_center[a:b][None])
                objects = np.flatnonzero((gap <= reach[here][:, None]).any(0)) + a
                if not len(objects):
                    continue
                got = products(queries[who], self.vectors[objects])
                got[self.rows[objects][None] == rows[who][:, None]] = _LEAST
                both = np.hstack([scores[who], got])
                names = np.hstack([ids[who], np.broadcast_to(self.ids[objects], got.shape)])
                best = np.lexsort((names, -both), axis=1)[:, :k]
                scores[who] = np.take_along_axis(both, best, 1)
                ids[who] = np.take_along_axis(names, best, 1)
            kth = np.maximum(kth, scores[:, -1])
        return scores, ids


def _quantised(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """row (unique), vec_id, v: array<long> floor(scale * x); rows with null or non-finite components left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(embedding).cast("array<double>")
    usable = df.filter(F.col(embedding).isNotNull()).filter(~F.exists(v, bad))
    return usable.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")
    )


def _assign(pivots: np.ndarray, square: int, d: int):
    """Each vector's cell (nearest pivot) and its distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            far = distances(lifted(x, square), pivots)
            cell = far.argmin(1)
            yield batch(
                _ASSIGNED,
                [rows.column("row"), rows.column("vec_id"), [v.astype("<i8").tobytes() for v in x], cell.astype(np.int32), far[np.arange(len(x)), cell]],
            )

    return run


def _build(square: int, k: int, shard_rows: int):
    """Rings of consecutive objects of one cell. The queries among a ring's rows find their first bound in it.

    A task holds one ring and one batch of rows.
    """

    def ring(rows: pd.DataFrame) -> dict:
        vectors = _matrix(list(rows["v"]))
        shard = Shard.build(rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), vectors, square)
        asking = np.flatnonzero(rows["asks"].to_numpy(bool))
        own = rows["row"].to_numpy(np.int64)[asking]
        scores, _ = shard.search(vectors[asking], own, np.full(len(asking), _LEAST), k, square)
        # The k-th best is the least integer where the ring holds fewer other rows.
        asks = [
            {"row": int(r), "vec_id": int(rows["vec_id"].iloc[i]), "v": rows["v"].iloc[i], "bound": int(s)}
            for r, i, s in zip(own, asking, scores[:, -1])
        ]
        first = {"cell": rows["cell"].iloc[0], "low": rows["off"].min(), "high": rows["off"].max(), "asks": asks}
        return {**first, **shard.stored()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            cells = [g for _, g in held.groupby("cell", sort=False)]
            for i, group in enumerate(cells):
                full = len(group) // shard_rows * shard_rows if i == len(cells) - 1 else len(group)
                for start in range(0, full, shard_rows):
                    yield pd.DataFrame([ring(group.iloc[start : min(full, start + shard_rows)])])
                held = group.iloc[full:]
        if held is not None and len(held):
            yield pd.DataFrame([ring(held)])

    return run


def _visit(k: int, square: int):
    """Queries of a block in a shard: the candidates that reach each query's bound."""

    def run(stored: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(queries):
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        shard = Shard.loaded(stored.iloc[0].to_dict())
        rows, bound = queries["row"].to_numpy(np.int64), queries["bound"].to_numpy(np.int64)
        scores, ids = shard.search(_matrix(list(queries["v"])), rows, bound, k, square)
        good = (scores > _LEAST) & (scores >= bound[:, None])
        at, _ = np.nonzero(good)
        names = pd.array(ids[good], dtype="Int64")
        names[ids[good] == _NO_ID] = pd.NA
        return pd.DataFrame(
            {"query_id": queries["vec_id"].to_numpy(np.int64)[at], "row": rows[at], "vec_id": names, "score": scores[good]}
        )

    return run


def _route(pivots: np.ndarray, radius: list[float], square: int):
    """The cells that may hold an object as good as a query's bound, with the query's distance from the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            q = _matrix(rows.column("v").to_pylist()).astype(np.float64)
            own, bound = rows.column("row").to_numpy(), rows.column("bound").to_numpy()
            points = np.hstack([q, np.zeros((len(q), 1))])
            reach = np.sqrt(np.maximum(square + (q * q).sum(1) - 2.0 * bound, 0)) * (1 + _SLACK) + 2 * slack(square)
            away = distances(points, pivots)
            at, cell = np.nonzero(away - np.array(radius)[None] <= reach[:, None])
            yield batch(_ROUTED, [own[at], bound[at], cell.astype(np.int32), away[at, cell], reach[at]])

    return run


def _least_hashes(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """The `wanted` of n rows with the least hashes of their numbers.

    A task sends its least ones to the driver; of those only about twice as many as are wanted pass, whatever the tasks.
    """
    place = F.xxhash64("row", F.lit(seed))
    passing = 2 * wanted + 64  # fewer than wanted would be eight standard deviations away
    least = rows if passing >= n else rows.filter(place < F.lit((passing << 64) // n - (1 << 63)))
    return least.orderBy(place, "row").limit(wanted)


def _search(rows: DataFrame, every: int, k: int, n_pivots: int, shard_rows: int, query_block: int, seed: int) -> DataFrame:
    d = len(rows.first()["v"])
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    square, n = rows.agg(F.max(norm), F.count(F.lit(1))).first()
    square = int(square)
    # A bounded number of pivots, drawn by hash: the only vectors that reach the driver.
    wanted = max(n_pivots, min(_MOST_PIVOTS, n // shard_rows))
    drawn = _least_hashes(rows, n, wanted, seed).collect()
    pivots = lifted(np.array([r["v"] for r in drawn], np.int64).reshape(len(drawn), d), square)
    assigned = materialized(
        rows.mapInArrow(_assign(pivots, square, d), "row long, vec_id long, v binary, cell int, off double"), "mtree-assigned"
    )
    # Ordered over all tasks: a cell with most of the vectors, equal ones included, lies in many of them.
    tasks = max(shuffle_partitions(rows.sparkSession), n // (16 * shard_rows))
    asks = F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False)).alias("asks")
    ordered = assigned.select("row", F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "v", "cell", "off", asks)
    ordered = ordered.repartitionByRange(tasks, "cell", "off", "row").sortWithinPartitions("cell", "off", "row")
    stored = ordered.mapInPandas(_build(square, k, shard_rows), _STORED).withColumn("shard", F.monotonically_increasing_id())
    shards = materialized(stored, "mtree-shards")
    rings = shards.select("shard", "cell", "low", "high")
    queries = shards.select(F.inline("asks"))
    far = {r["cell"]: r["radius"] for r in rings.groupBy("cell").agg(F.max("high").alias("radius")).collect()}
    radius = [far.get(c, -np.inf) for c in range(len(pivots))]
    routed = queries.mapInArrow(_route(pivots, radius, square), "row long, bound long, cell int, away double, reach double")
    meets = (F.col("low") - F.col("away") <= F.col("reach")) & (F.col("away") - F.col("high") <= F.col("reach"))
    # Numbers only: vectors join when it is known who visits what.
    visits = materialized(routed.join(rings, "cell").filter(meets).select("shard", "row", "bound"), "mtree-visits")
    parts = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int").alias("part")
    # Visits and vectors grow with the table, and far beyond their compressed files: neither goes through the driver.
    asked = visits.join(parts, "shard", "left").select("shard", part, "row", "bound")
    asked = asked.join(queries.drop("bound").hint("merge"), "row")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    payload = [c for c in shards.columns if c not in ("cell", "low", "high", "asks")]
    copies = shards.select(*payload).join(parts, "shard").select(*payload, each)
    key = ["shard", "part"]
    hits = "query_id long, row long, vec_id long, score long"
    found = copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_visit(k, square), hits)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(
    df: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256,
    pivots: int = 32, shard_rows: int = 4096, query_block: int = 4096, seed: int = 5,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k best other rows.

    Score: inner product of components floor(scale * x), as whole numbers; ties go to the smaller vec_id. Rows with
    a null vector, or a null or non-finite component, take no part; a null id is a candidate, last among ties, and
    asks nothing. Repeated ids: each row is a query and a candidate of its own, and excludes only itself. Vectors of
    different lengths aren't compared: a query's candidates are those of its length. Extra columns are ignored.
    At least `pivots` cells, one more for each `shard_rows` rows up to 1,024, spread the work and change no result.
    """
    spark = df.sparkSession
    ship(spark)
    rows = materialized(
        _quantised(df, vec_id, embedding, scale).withColumn("row", F.monotonically_increasing_id()), "mtree-vectors"
    )
    parts = []
    # A table of embeddings has one length; others are searched apart.
    lengths = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    for d in lengths:
        parts.append(_search(rows.filter(F.size("v") == d), every, k, pivots, shard_rows, query_block, seed))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
