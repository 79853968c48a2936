"""Query registration and the text form of result columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import CTES, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a function of Views; `views` names the WITH entries its SQL reads."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(Views(spark, sf_dir)))
        if sql is not None:
            SQL[name] = with_views(sql, views.split())
        return build

    return register


def with_views(sql: str, views: list[str]) -> str:
    """Prepends the named views and whatever they read from."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for other in CTES:
            if other != name and _mentions(CTES[name], other):
                visit(other)
        needed.append(name)

    for view in views:
        visit(view)
    if not needed:
        return sql
    prefix = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {prefix},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {prefix},\n{text[5:]}"
    return f"WITH {prefix}\n{text}"


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def plain(df: DataFrame) -> DataFrame:
    """Result columns both engines print alike: text times and lists, doubles to six digits."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)
