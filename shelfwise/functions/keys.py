"""Keys, identifiers and calendar names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 OID namespace.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_location(code: Column | str) -> Column:
    return F.upper(F.trim(_col(code), F.lit(" \t\r\n")))


def sku_location_key(sku: Column | str = "sku_id", location: Column | str = "location_code") -> Column:
    return F.concat(_col(sku).cast("string"), F.lit(":"), normalize_location(location))


def uuid_v5(text: Column | str) -> Column:
    """RFC 4122 name-based UUID in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(_col(text), "UTF-8")))
    # The variant nibble keeps its two low bits: 0,4,8,c -> 8 ... 3,7,b,f -> b.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def order_event_key(event_id, order_id, sku, location, quantity) -> Column:
    """The event's own id, else a key built from what it says."""
    derived = F.concat(
        F.lit("order-stock-confirmed:"),
        F.concat_ws(":", _col(order_id), _col(sku), normalize_location(location), _col(quantity)),
    )
    return F.coalesce(_col(event_id), derived)


def sanitize_topic(topic: Column | str) -> Column:
    return F.regexp_replace(_col(topic), "[^A-Za-z0-9._-]", "_")


def short_type_name(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", -1)


def weekday_name(at: Column | str) -> Column:
    return F.upper(F.date_format(_col(at), "E"))


def weekday_index(at: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_col(at))


def month_bucket(at: Column | str) -> Column:
    """Year and month as yyyyMM, by which facts are filed."""
    return F.date_format(_col(at), "yyyyMM")
