"""Change envelopes -> typed movements and balances, with a reason for every reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let, normalize_location, strict_json
from ..model import BALANCE, BALANCE_TABLE, MOVEMENT, MOVEMENT_TABLE, MOVEMENT_TYPES, OPERATIONS
from .quality import balance_invariants_hold

# Reject classes and accepted text forms.
MALFORMED = "MalformedJson"
UNSUPPORTED_TABLE = "UnsupportedTable"
UNSUPPORTED_OPERATION = "UnsupportedOperation"
MISSING_ROW = "MissingRow"
MOVEMENT_UPDATE = "UnexpectedMovementUpdate"
INVALID_BALANCE = "InvalidBalance"
_UUID = (
    r"^(urn:uuid:)?\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$"
    r"|^[0-9a-fA-F]{32}$"
)
_CANONICAL_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"
# End of fixed values.

# Row images. Integers are typed, so a quoted or fractional number makes the record corrupt; text
# that has no pattern of its own is read as a variant, so that a bare number is not taken for text.
_MOVEMENT_ROW = (
    "movement_id string, source_event_id string, sku_id int, location_code variant, order_id int, "
    "movement_type string, quantity int, occurred_at string, recorded_at string, "
    "balance_version_after bigint, reason variant"
)
_BALANCE_ROW = (
    "sku_id int, location_code variant, on_hand int, reserved int, safety_stock int, "
    "reorder_point int, max_stock int, version bigint, updated_at string"
)


def _envelope(row: str) -> str:
    fields = row.replace(" ", ":").replace(",:", ",")
    return (
        f"before struct<{fields}>, after struct<{fields}>, source struct<lsn:bigint>, "
        "_corrupt_record string"
    )


def _parse(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _is_text(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node) == "STRING", F.lit(False))


def _text(node: Column) -> Column:
    return F.when(_is_text(node), F.try_variant_get(node, "$", "string"))


def _uuid(value: Column) -> Column:
    """Lower-case hyphenated form; text that has it already is passed on."""
    bare = F.lower(F.regexp_replace(value, r"^urn:uuid:|[{}-]", ""))
    spelled = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(value.rlike(_CANONICAL_UUID), value).otherwise(spelled)


def _instant(value: Column) -> Column:
    return F.when(value.rlike(_TIMESTAMP), F.upper(value).try_cast("timestamp"))


def _all(*conditions: Column) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return F.coalesce(result, F.lit(False))


def _movement_row(raw: Column) -> Column:
    return F.struct(
        _uuid(raw["movement_id"]).alias("movement_id"),
        _uuid(raw["source_event_id"]).alias("source_event_id"),
        raw["sku_id"].alias("sku_id"),
        normalize_location(_text(raw["location_code"])).alias("location_code"),
        raw["order_id"].alias("order_id"),
        raw["movement_type"].alias("movement_type"),
        raw["quantity"].alias("quantity"),
        _instant(raw["occurred_at"]).alias("occurred_at"),
        _instant(raw["recorded_at"]).alias("recorded_at"),
        raw["balance_version_after"].alias("resulting_balance_version"),
        _text(raw["reason"]).alias("reason"),
    )


def _movement_valid(raw: Column, row: Column) -> Column:
    """The required fields are there and every text has its form."""
    reason = raw["reason"]
    return _all(
        raw["movement_id"].rlike(_UUID),
        raw["source_event_id"].rlike(_UUID),
        raw["movement_type"].isin(*MOVEMENT_TYPES),
        reason.isNull() | F.is_variant_null(reason) | _is_text(reason),
        *[
            row[c].isNotNull()
            for c in ("sku_id", "location_code", "quantity", "occurred_at", "recorded_at",
                      "resulting_balance_version")
        ],
    )


def _balance_row(raw: Column) -> Column:
    return F.struct(
        raw["sku_id"].alias("sku_id"),
        normalize_location(_text(raw["location_code"])).alias("location_code"),
        raw["on_hand"].alias("on_hand"),
        raw["reserved"].alias("reserved"),
        (raw["on_hand"] - raw["reserved"]).alias("available"),
        raw["safety_stock"].alias("safety_stock"),
        raw["reorder_point"].alias("reorder_point"),
        raw["max_stock"].alias("max_stock"),
        raw["version"].alias("version"),
        _instant(raw["updated_at"]).alias("updated_at"),
    )


def _balance_valid(raw: Column, row: Column) -> Column:
    names = (
        "sku_id", "location_code", "on_hand", "reserved", "safety_stock", "reorder_point",
        "max_stock", "version", "updated_at",
    )
    return _all(*[row[c].isNotNull() for c in names])


def _absent(schema: str) -> Column:
    return F.lit(None).cast(schema)


_RESULT = (
    "event_kind", "operation", "movement", "balance", "deleted_movement_id", "source_lsn", "decode_error"
)
_MOVEMENT_TYPE, _BALANCE_TYPE = MOVEMENT.simpleString(), BALANCE.simpleString()


def _result(**given: Column) -> Column:
    empty = {
        "event_kind": "string", "operation": "string", "movement": _MOVEMENT_TYPE,
        "balance": _BALANCE_TYPE, "deleted_movement_id": "string", "source_lsn": "bigint",
        "decode_error": "string",
    }
    return F.struct(
        *[given.get(n, F.lit(None)).cast(empty[n]).alias(n) for n in _RESULT]
    )


def _operation(op: Column) -> Column:
    result = F.lit(None).cast("string")
    for code, name in OPERATIONS.items():
        result = F.when(op == code, name).otherwise(result)
    return result


def _decode_rows(text: Column, op: Column, schema: str, row, valid, finish) -> Column:
    """Parses the two images of a record and applies the checks shared by both tables."""

    def images(doc: Column) -> Column:
        def checked(raw: Column) -> Column:
            return let(row(raw), lambda r: F.struct(raw.isNotNull().alias("present"), valid(raw, r).alias("ok"), r.alias("row")))

        return let(
            F.struct(checked(doc["before"]).alias("before"), checked(doc["after"]).alias("after")),
            lambda both: finish_checked(doc, both),
        )

    def finish_checked(doc: Column, both: Column) -> Column:
        before, after = both["before"], both["after"]
        shaped = (
            doc["_corrupt_record"].isNull()
            & op.isNotNull()
            & (~before["present"] | before["ok"])
            & (~after["present"] | after["ok"])
        )
        wanted = F.when(op == "d", before["present"]).otherwise(after["present"])
        return finish(F.coalesce(shaped, F.lit(False)), wanted, before["row"], after["row"], doc["source"]["lsn"])

    return let(_parse(text, schema), images)


def _decode_movement(text: Column, op: Column) -> Column:
    def finish(shaped, wanted, before, after, lsn):
        error = (
            F.when(~shaped, MALFORMED)
            .when(~op.isin(*OPERATIONS), UNSUPPORTED_OPERATION)
            .when(op == "u", MOVEMENT_UPDATE)
            .when(~wanted, MISSING_ROW)
        )
        deleting = op == "d"
        return let(
            error,
            lambda e: F.when(e.isNotNull(), _result(decode_error=e)).when(
                deleting,
                _result(
                    event_kind=F.lit("movement_delete"), operation=_operation(op), source_lsn=lsn,
                    deleted_movement_id=before["movement_id"],
                ),
            ).otherwise(
                _result(event_kind=F.lit("movement"), operation=_operation(op), source_lsn=lsn, movement=after)
            ),
        )

    return _decode_rows(text, op, _envelope(_MOVEMENT_ROW), _movement_row, _movement_valid, finish)


def _decode_balance(text: Column, op: Column) -> Column:
    def finish(shaped, wanted, before, after, lsn):
        deleting = op == "d"
        error = (
            F.when(~shaped, MALFORMED)
            .when(~op.isin(*OPERATIONS), UNSUPPORTED_OPERATION)
            .when(~wanted, MISSING_ROW)
            .when(~deleting & ~balance_invariants_hold(after), INVALID_BALANCE)
        )
        key_only = F.struct(
            before["sku_id"].alias("sku_id"), before["location_code"].alias("location_code"),
            *[F.lit(None).cast("int").alias(c) for c in (
                "on_hand", "reserved", "available", "safety_stock", "reorder_point", "max_stock")],
            before["version"].alias("version"), F.lit(None).cast("timestamp").alias("updated_at"),
        )
        return let(
            error,
            lambda e: F.when(e.isNotNull(), _result(decode_error=e)).when(
                deleting,
                _result(
                    event_kind=F.lit("balance_delete"), operation=_operation(op), source_lsn=lsn,
                    balance=key_only,
                ),
            ).otherwise(
                _result(event_kind=F.lit("balance"), operation=_operation(op), source_lsn=lsn, balance=after)
            ),
        )

    return _decode_rows(text, op, _envelope(_BALANCE_ROW), _balance_row, _balance_valid, finish)


def _member(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _decode_text(text: Column) -> Column:
    """Routes one JSON text by its table; the change is the `payload` member where there is one."""

    def change(doc: Column) -> Column:
        payload = _member(doc, "$.payload")
        bare = payload.isNull()
        return F.struct(
            F.when(bare, text).otherwise(payload.cast("string")).alias("text"),
            F.when(bare, doc).otherwise(payload).alias("doc"),
        )

    def named(inner: Column) -> Column:
        return F.struct(
            inner["text"].alias("text"),
            _text(_member(inner["doc"], "$.source.table")).alias("table"),
            _text(_member(inner["doc"], "$.op")).alias("op"),
        )

    def routed(n: Column) -> Column:
        return (
            F.when(n["table"].isNull(), _result(decode_error=F.lit(MALFORMED)))
            .when(n["table"] == MOVEMENT_TABLE, _decode_movement(n["text"], n["op"]))
            .when(n["table"] == BALANCE_TABLE, _decode_balance(n["text"], n["op"]))
            .otherwise(_result(decode_error=F.lit(UNSUPPORTED_TABLE)))
        )

    return let(strict_json(text), lambda doc: let(change(doc), lambda inner: let(named(inner), routed)))


def decode_changes(log: DataFrame) -> DataFrame:
    """Adds event_kind, operation, movement, balance, source_lsn, deleted ids and decode_error.

    The reject order is JSON, table, row shape, operation, then the operation's own rule. A null
    value is a tombstone. Location codes are normalized here, once.

    The result comes out of a generator, whose columns Catalyst cannot copy into later filters:
    each record is parsed once, whatever is asked about it afterwards.
    """
    tombstone = _result(event_kind=F.lit("tombstone"), operation=F.lit("TOMBSTONE"))
    text = F.col("value").cast("string")
    decoded = F.when(F.col("value").isNull(), tombstone).otherwise(_decode_text(text))
    return log.select("*", F.inline(F.array(decoded)))


def movements_of(decoded: DataFrame) -> DataFrame:
    """Typed movement facts with their position in the log."""
    return decoded.filter(F.col("event_kind") == "movement").select(
        "movement.*", "topic", "partition", "offset", "source_lsn"
    )


def balances_of(decoded: DataFrame) -> DataFrame:
    """Typed balance changes with operation and position in the log."""
    return decoded.filter(F.col("event_kind") == "balance").select(
        "balance.*", "operation", "topic", "partition", "offset", "source_lsn"
    )
