"""Skew-safe building blocks shared by the operators.

* `earliest` / `latest` pick one row per key with an aggregate, so copies of a hot key are
  combined before the shuffle; no group is ever gathered.
* `running` computes ordered running values per key in two levels: inside bounded chunks of
  the key's order, and over one row per chunk. A hot key is spread over its chunks.
* `keyed_join` shuffles a side with a row for every key, whatever its estimated size.
* `lookup_join` leaves hot join keys to adaptive execution, which splits those it measures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW = "_row"


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias(_ROW))
    return picked.select(*keys, *[F.col(f"{_ROW}.{c}").alias(c) for c in rest]).select(*df.columns)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the smallest order tuple per key."""
    return _pick(df, keys, order, F.min_by)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the largest order tuple per key."""
    return _pick(df, keys, order, F.max_by)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum / max / last non-null value per key in `order`.

    `chunk` must not decrease along `order` and should bound the rows one key can put into one
    chunk (a range of unique positions, or a time bucket). `order` must be total within a key, and
    key columns must not be null.
    `exclusive` leaves the current row out.
    """
    keys, order = list(keys), list(order)
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    inputs = {**sums, **maxes, **lasts}
    given = df.columns
    df = df.withColumns({f"_in_{n}": c for n, c in inputs.items()}).withColumn("_chunk", chunk)
    keyed = [*keys, "_chunk"]

    position = F.struct(*order)
    totals = df.groupBy(*keyed).agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes],
        *[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), position)).alias(f"_t_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keyed,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    within = (
        Window.partitionBy(*keyed)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    zero = F.lit(0)
    local = df.select(
        *given,
        "_chunk",
        *[F.sum(f"_in_{n}").over(within).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(within).alias(f"_l_{n}") for n in maxes],
        *[F.last(f"_in_{n}", ignorenulls=True).over(within).alias(f"_l_{n}") for n in lasts],
    )
    return local.join(carried, keyed, "left").select(
        *given,
        *[(F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in sums],
        *[F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def value_chunk(df: DataFrame, column: str, chunks: int = 256, sample: int = 8192) -> Column:
    """A chunk for `running` over all rows by one column: cut at sampled values, so chunks are about equal in size.

    The sample is the `sample` values of smallest hash, found with a bounded number a task; it decides how rows are
    spread, not any result. Values that share long prefixes, or lie close together, are spread all the same.
    """
    drawn = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column)).limit(sample)
    ordered = drawn.agg(F.array_sort(F.collect_list(column)).alias("all"))
    step = F.greatest(F.floor(F.size("all") / chunks).cast("int"), F.lit(1))
    places = F.sequence(step, F.greatest(F.size("all"), step), step)
    bounds = ordered.select(F.transform(places, lambda i: F.get("all", i - 1)).alias("bounds")).scalar()
    # A scalar can't stand inside a lambda function; the place among the sorted bounds needs none.
    return F.array_position(F.sort_array(F.array_append(bounds, F.col(column))), F.col(column))


def lookup_join(many: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join of `many` with the row or rows that `few` has for a key, however hot the key.

    Nothing is copied: Spark broadcasts `few` where its measured size is below the session's threshold, and
    else shuffles both sides; a hot key of `many` is then split by adaptive execution's skew join.
    """
    return many.join(few, list(on), how)


def keyed_join(many: DataFrame, keyed: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join with a side that has a row for every key, and so grows with the data: both sides are shuffled and sorted.

    Such a side is never broadcast. What Spark estimates for it may be far below its size (rows that a generator adds
    don't count), and a table of all keys would lie whole in the driver and in every executor.
    """
    return many.join(keyed.hint("merge"), list(on), how)


def value_positions(counts: DataFrame, keys: Sequence[str], value: str, n: str, chunk: Column) -> DataFrame:
    """Adds `upto` (rows at or below each distinct value) to a table of (keys, value, n)."""
    return running(counts, keys, [value], chunk, sums={"upto": F.col(n)})
