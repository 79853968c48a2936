"""Catalog paging, facets, vector search and dimension builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine_distance
from ..model import KEY, LOCATIONS
from .keyed import running, value_chunk

SORT_MODES = {
    "name": lambda: [F.asc("name")],
    "name_desc": lambda: [F.desc("name")],
    "price": lambda: [F.asc("price")],
    "price_desc": lambda: [F.desc("price")],
}


def catalog_filter(
    items: DataFrame,
    name_prefix: str | None = None,
    type_ids: Sequence[int] | None = None,
    brand_ids: Sequence[int] | None = None,
    ids: Sequence[int] | None = None,
) -> DataFrame:
    """Filters are joined by AND; the values of one filter by OR. Names compare by case."""
    if name_prefix:
        items = items.filter(F.col("name").startswith(name_prefix))
    for column, values in (("type_id", type_ids), ("brand_id", brand_ids), ("id", ids)):
        if values:
            items = items.filter(F.col(column).isin(*values))
    return items


def catalog_page(items: DataFrame, page_index: int = 0, page_size: int = 10, sort: str = "name") -> DataFrame:
    """One page, with the count of all matching items; an index past the end gives no rows.

    Sort and limit together are a top-k: each task keeps only the rows up to the page's end.
    """
    total = items.agg(F.count("*").alias("n")).select("n").scalar()
    page = (
        items.orderBy(*SORT_MODES[sort](), "id").offset(page_index * page_size).limit(page_size)
    )
    return page.withColumn("total_items", total)


def catalog_facets(items: DataFrame, type_ids: Sequence[int] | None = None,
                   brand_ids: Sequence[int] | None = None) -> DataFrame:
    """Brand counts inside the type filter and type counts inside the brand filter.

    One pass over the items: counts per (brand, type) first, both facets from those few rows.
    """
    cells = items.groupBy("brand_id", "type_id").agg(F.count("*").alias("n"))
    inside = lambda column, values: (
        F.col(column).isin(*values) if values else F.lit(True)
    )
    facet_rows = F.array(
        F.struct(
            F.lit("brand").alias("facet"), F.col("brand_id").alias("value_id"),
            F.when(inside("type_id", type_ids), F.col("n")).alias("n"),
        ),
        F.struct(
            F.lit("type").alias("facet"), F.col("type_id").alias("value_id"),
            F.when(inside("brand_id", brand_ids), F.col("n")).alias("n"),
        ),
    )
    facets = (
        cells.select(F.inline(facet_rows))
        .filter(F.col("n").isNotNull())
        .groupBy("facet", "value_id")
        .agg(F.sum("n").alias("items"))
    )
    # Totals are one row each, 0 where nothing matches.
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    none = F.lit(None).cast(facets.schema["value_id"].dataType)
    totals = cells.agg(
        count(inside("type_id", type_ids)).alias("brand_total"), count(inside("brand_id", brand_ids)).alias("type_total")
    ).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(t).alias("facet"), none.alias("value_id"), F.col(t).alias("items")) for t in ("brand_total", "type_total")]
            )
        )
    )
    return facets.unionByName(totals)


def semantic_top_k(items: DataFrame, query: Column, vector: str, id_column: str,
                   page_size: int = 10, page_index: int = 0) -> DataFrame:
    """Nearest items by cosine distance, with the count of all items (null vectors included).

    `query` is the one vector that is searched for: an array literal or a scalar subquery.
    """
    total = items.agg(F.count("*").alias("n")).select("n").scalar()
    return (
        items.filter(F.col(vector).isNotNull())
        .withColumn("_query", query)
        .withColumn("distance", cosine_distance(F.col(vector), F.col("_query")))
        .drop("_query")
        .orderBy("distance", id_column)
        .offset(page_index * page_size)
        .limit(page_size)
        .withColumn("total_items", total)
    )


def dimension_list(dimension: DataFrame, name: str) -> DataFrame:
    return dimension.select(name).distinct().orderBy(name)


def with_brand(items: DataFrame, brands: DataFrame) -> DataFrame:
    """Brand name included; the dimension is small and Spark broadcasts it by its size."""
    return items.join(brands, "brand_id", "left")


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows per key in `order`; without keys, of the whole table.

    A rank filter limits each task's rows per key before the shuffle.
    """
    if not keys:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def surrogate_ids(values: DataFrame, name: str, id_name: str) -> DataFrame:
    """Distinct non-null values numbered 1..n in binary order, without a one-task sort."""
    distinct = values.select(name).filter(F.col(name).isNotNull()).distinct()
    numbered = running(distinct, [], [name], value_chunk(distinct, name), sums={id_name: F.lit(1)})
    return numbered.withColumn(id_name, F.col(id_name).cast("int"))


def build_dims(source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, brands, types): items without name, brand or type are dropped."""
    usable = source.filter(
        F.col("name").isNotNull() & F.col("brand").isNotNull() & F.col("type").isNotNull()
    )
    brands = surrogate_ids(usable, "brand", "brand_id")
    types = surrogate_ids(usable, "type", "type_id")
    items = usable.join(brands, "brand").join(types, "type")
    return items, brands, types


def price_changes(versions: DataFrame, chunk: Column | None = None) -> DataFrame:
    """(product, new price, old price) where a new version changed the price."""
    chunk = F.floor(F.col("version") / 65536) if chunk is None else chunk
    compared = running(
        versions, ["product_id"], ["version"], chunk, lasts={"old_price": F.col("price")}, exclusive=True
    )
    return compared.filter(F.col("old_price").isNotNull() & (F.col("price") != F.col("old_price"))).select(
        "product_id", "version", F.col("price").alias("new_price"), "old_price"
    )


def seed_balances(skus: DataFrame, existing: DataFrame | None = None,
                  locations: Sequence[str] = LOCATIONS) -> DataFrame:
    """Opening balance of every sku at every location that has none yet."""
    grid = skus.select(
        "sku_id",
        F.posexplode(F.array(*[F.lit(c) for c in locations])).alias("_index", "location_code"),
    )
    safety = 10 + F.col("sku_id") % 5
    on_hand = 60 + F.col("sku_id") % 41 + 10 * F.col("_index")
    seeded = (
        grid.withColumn("on_hand", on_hand.cast("int"))
        .withColumn("safety_stock", safety.cast("int"))
        .withColumn("reorder_point", (safety + 20).cast("int"))
        .select(
            *KEY, "on_hand", F.lit(0).alias("reserved"), F.col("on_hand").alias("available"),
            "safety_stock", "reorder_point",
            F.greatest(F.col("on_hand") + 50, F.col("reorder_point") + 50).alias("max_stock"),
            F.lit(1).cast("long").alias("version"),
        )
    )
    if existing is None:
        return seeded
    return seeded.join(existing.select(*KEY).distinct(), KEY, "left_anti")
