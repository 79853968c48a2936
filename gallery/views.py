"""Canonical inventory views over the given tables: once for Spark, once as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.model import BALANCE_TOPIC, LOCATIONS, MOVEMENT_TOPIC
from shelfwise.operators.catalog import seed_balances

AS_OF = "2024-01-20 12:00:00"
HISTORY_AS_OF = "1998-09-02 00:00:00"
INGESTED_AT = "2024-02-01 00:00:00"


def loc(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in LOCATIONS]), (key % 4 + 1).cast("int"))


def sql_loc(key: str) -> str:
    return f"(['NCR','BLR','BOM','HYD'])[CAST(({key}) % 4 AS INTEGER) + 1]"


def recurring(n: Column, keys: int, copies: int) -> Column:
    """A key that comes back: each stretch of keys * copies numbers has `keys` keys of its own, `copies` times each.

    The number of keys grows with the data, the rows of one key do not.
    """
    return n - n % (keys * copies) + n % keys


def sql_recurring(n: str, keys: int, copies: int) -> str:
    return f"({n} - {n} % {keys * copies} + {n} % {keys})"


def lineitem_type() -> Column:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        F.when(flag == "N", "Sale")
        .when((flag == "A") & (status == "O"), "Reserve")
        .when(flag == "A", "Release")
        .when(status == "O", "Restock")
        .otherwise("Return")
    )


SQL_LINEITEM_TYPE = (
    "CASE WHEN l_returnflag = 'N' THEN 'Sale' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Reserve' "
    "WHEN l_returnflag = 'A' THEN 'Release' WHEN l_linestatus = 'O' THEN 'Restock' ELSE 'Return' END"
)
EVENT_TYPES = {"purchase": "Sale", "click": "Reserve", "view": "Release", "signup": "Restock", "error": "Return"}
SQL_EVENT_TYPE = (
    "CASE event_type WHEN 'purchase' THEN 'Sale' WHEN 'click' THEN 'Reserve' WHEN 'view' THEN 'Release' "
    "WHEN 'signup' THEN 'Restock' WHEN 'error' THEN 'Return' END"
)


def event_type() -> Column:
    result = F.lit(None).cast("string")
    for given, kind in EVENT_TYPES.items():
        result = F.when(F.col("event_type") == given, kind).otherwise(result)
    return result


def cents() -> Column:
    """The price keeps apart the few lines that share order, number, part and supplier."""
    return F.round(F.col("l_extendedprice") * 100).cast("long")


SQL_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def minutes(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), count.cast("int"))


class Views:
    """Lazily built views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # The files carry zoneless times; they are read as UTC instants.
        zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    @cached_property
    def movements(self) -> DataFrame:
        version = F.floor(F.unix_seconds("occurred_at") / 60).cast("long") - 13148640
        return (
            self.table("lineitem")
            .withColumn(
                "occurred_at",
                F.col("l_shipdate") + F.make_dt_interval(
                    F.lit(0), F.col("l_linenumber"), F.col("l_suppkey").cast("int")
                ),
            )
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents()).alias("movement_id"),
                F.concat(F.lit("evt-"), F.col("l_orderkey")).alias("source_event_id"),
                (F.col("l_partkey") + 1).cast("int").alias("sku_id"),
                loc(F.col("l_suppkey")).alias("location_code"),
                (F.col("l_orderkey") + 1).cast("int").alias("order_id"),
                lineitem_type().alias("movement_type"),
                F.floor("l_quantity").cast("int").alias("quantity"),
                "occurred_at",
                (F.col("occurred_at") + F.expr("interval 5 seconds")).alias("recorded_at"),
                version.alias("resulting_balance_version"),
                F.lit(None).cast("string").alias("reason"),
            )
        )

    @cached_property
    def live(self) -> DataFrame:
        """The same movements dated into the fourteen days before AS_OF."""
        age = (
            F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729
            + F.col("l_linenumber") * 31 + F.col("l_suppkey") * 13
        ) % 20160
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents()).alias("movement_id"),
            (F.col("l_partkey") + 1).cast("int").alias("sku_id"),
            loc(F.col("l_suppkey")).alias("location_code"),
            (F.col("l_orderkey") + 1).cast("int").alias("order_id"),
            lineitem_type().alias("movement_type"),
            F.floor("l_quantity").cast("int").alias("quantity"),
            (F.lit(AS_OF).cast("timestamp") - minutes(age)).alias("occurred_at"),
        )

    @cached_property
    def event_movements(self) -> DataFrame:
        return self.table("events").select(
            F.format_string("00000000-0000-4000-8000-%012x", F.col("event_id")).alias("movement_id"),
            (F.col("user_id") % 25 + 1).cast("int").alias("sku_id"),
            loc(F.col("event_id")).alias("location_code"),
            (F.col("event_id") + 1).cast("int").alias("order_id"),
            event_type().alias("movement_type"),
            (1 + F.floor("value") % 10).cast("int").alias("quantity"),
            F.col("ts").alias("occurred_at"),
            F.col("event_id").alias("arrival"),
        )

    @cached_property
    def area_movements(self) -> DataFrame:
        """Event movements of all skus together, so that short windows hold several events."""
        return self.event_movements.withColumn("sku_id", F.lit(1))

    @cached_property
    def skus(self) -> DataFrame:
        return self.table("part").select((F.col("p_partkey") + 1).cast("int").alias("sku_id"))

    @cached_property
    def balances(self) -> DataFrame:
        reserved = F.col("sku_id") % 7
        return seed_balances(self.skus).select(
            "sku_id", "location_code", "on_hand",
            reserved.alias("reserved"), (F.col("on_hand") - reserved).alias("available"),
            "safety_stock", "reorder_point", "max_stock",
            (F.col("sku_id") % 5 + 1).cast("long").alias("version"),
            F.lit("2024-01-20 00:00:00").cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def balance_changes(self) -> DataFrame:
        on_hand = (20 + F.col("event_id") % 80).cast("int")
        reserved = (F.col("event_id") % 15).cast("int")
        return self.table("events").select(
            (F.col("user_id") % 25 + 1).cast("int").alias("sku_id"),
            loc(F.col("event_id")).alias("location_code"),
            on_hand.alias("on_hand"), reserved.alias("reserved"), (on_hand - reserved).alias("available"),
            F.lit(10).alias("safety_stock"), F.lit(30).alias("reorder_point"), F.lit(150).alias("max_stock"),
            (1 + F.col("event_id") * 7 % 997).alias("version"),
            F.col("ts").alias("updated_at"),
            F.when(F.col("event_id") % 400 == 3, "SNAPSHOT").otherwise("UPDATE").alias("operation"),
            F.col("event_id").alias("offset"),
        )

    @cached_property
    def change_log(self) -> DataFrame:
        """JSON change envelopes with every kind of bad record among them."""
        n, kind = F.col("event_id"), F.col("event_id") % 50
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        sku, place = F.col("user_id") % 25 + 1, loc(n)
        q = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
        uid = F.format_string("00000000-0000-4000-8000-%012x", n)
        movement = F.concat(
            F.lit('{"movement_id":'), q(uid), F.lit(',"source_event_id":'), q(uid),
            F.lit(',"sku_id":'), F.when(kind == 8, q(sku)).otherwise(sku.cast("string")),
            F.lit(',"location_code":'),
            q(F.when(kind == 10, F.concat(F.lit(" "), F.lower(place), F.lit(" "))).otherwise(place)),
            F.lit(',"order_id":'), F.when(kind == 20, F.lit("null")).otherwise((n + 1).cast("string")),
            F.lit(',"movement_type":"'), F.when(kind == 11, F.lit("Gift")).otherwise(event_type()),
            F.lit('","quantity":'), (1 + F.floor("value") % 10).cast("string"),
            F.when(kind == 9, ".5").otherwise(""),
            F.lit(',"occurred_at":'), q(stamp), F.lit(',"recorded_at":'), q(stamp),
            F.lit(',"balance_version_after":'), (n + 1).cast("string"),
            F.lit(',"reason":null,"shelf_hint":1}'),
        )
        on_hand = F.when(kind == 14, F.lit(2)).otherwise(20 + n % 80)
        reserved = F.when(kind == 14, F.lit(9)).otherwise(n % 15)
        balance = F.concat(
            F.lit('{"sku_id":'), sku.cast("string"), F.lit(',"location_code":'), q(place),
            F.lit(',"on_hand":'), on_hand.cast("string"), F.lit(',"reserved":'), reserved.cast("string"),
            F.lit(',"safety_stock":10,"reorder_point":30,"max_stock":150,"version":'), (n + 1).cast("string"),
            F.lit(',"updated_at":'), q(stamp), F.lit("}"),
        )
        is_balance = kind.between(12, 15)
        image = F.col("_image")
        deleting = kind.isin(3, 15)
        table = F.when(is_balance, "inventory_balances").when(kind == 5, "orders").otherwise("inventory_movements")
        op = (
            F.when(kind.isin(2, 12), "u").when(kind.isin(3, 15), "d").when(kind == 6, "x")
            .when(kind == 13, "r").otherwise("c")
        )
        envelope = F.col("_envelope")
        enveloped = F.concat(
            F.lit('{"before":'), F.when(deleting, image).otherwise("null"),
            F.lit(',"after":'), F.when(deleting | (kind == 7), "null").otherwise(image),
            F.lit(',"source":{"table":"'), table, F.lit('","lsn":'), n.cast("string"),
            F.lit('},"op":"'), op, F.lit('"}'),
        )
        value = (
            F.when(kind == 0, F.lit(None).cast("string"))
            .when(kind == 1, "not-json")
            .when(kind == 4, F.concat(F.lit('{"schema":{},"payload":'), envelope, F.lit("}")))
            .when(kind == 21, F.concat(envelope, F.lit(" trailing")))
            .when(kind == 22, F.concat(envelope, envelope))
            .when(kind == 23, F.translate(envelope, '"', "'"))
            .when(kind == 24, F.concat(envelope, F.lit("],["), envelope))
            .otherwise(envelope)
        )
        key = F.concat(F.lit('{"sku_id":'), sku.cast("string"), F.lit(',"location_code":'), q(place), F.lit("}"))
        # Texts that are used more than once are columns of their own; spelled out they outgrow a compiled method.
        events = self.table("events").withColumn("_image", F.when(is_balance, balance).otherwise(movement))
        return events.withColumn("_envelope", enveloped).select(
            F.when(is_balance, BALANCE_TOPIC).otherwise(MOVEMENT_TOPIC).alias("topic"),
            (n % 3).cast("int").alias("partition"),
            n.alias("offset"),
            F.when(n % 20 != 11, F.col("ts")).alias("timestamp"),
            F.encode(key, "UTF-8").alias("key"),
            F.encode(value, "UTF-8").alias("value"),
            F.when(
                n % 5 == 0,
                F.array(F.struct(F.lit("origin").alias("key"), F.encode(F.lit("cdc"), "UTF-8").alias("value"))),
            )
            .otherwise(F.array().cast("array<struct<key:string,value:binary>>"))
            .alias("headers"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "Shipped")
            .when(F.col("o_orderstatus") == "P", "Paid")
            .otherwise("Submitted")
        )
        return self.table("orders").select(
            (F.col("o_orderkey") + 1).cast("int").alias("order_id"),
            (F.col("o_custkey") + 1).cast("int").alias("buyer_id"),
            F.col("o_orderdate").alias("order_date"), status.alias("status"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Products are folded to 40 per order, so that some lines of an order share a product."""
        return self.table("lineitem").select(
            (F.col("l_orderkey") + 1).cast("int").alias("order_id"),
            (F.col("l_partkey") % 40 + 1).cast("int").alias("product_id"),
            F.concat(F.lit("product-"), F.col("l_partkey") % 40 + 1).alias("product_name"),
            F.floor("l_quantity").cast("int").alias("units"),
            (F.floor(F.col("l_extendedprice") * 4 / F.col("l_quantity")) / 4).alias("unit_price"),
            (F.col("l_discount") * 100).alias("discount"),
            F.col("l_linenumber").alias("line_number"),
            F.concat_ws("-", "l_partkey", "l_suppkey", cents()).alias("line_id"),
        )

    @cached_property
    def buyers(self) -> DataFrame:
        return self.table("customer").select(
            (F.col("c_custkey") + 1).cast("int").alias("buyer_id"), F.col("c_name").alias("buyer_name")
        )

    @cached_property
    def source_items(self) -> DataFrame:
        return self.table("part").select(
            (F.col("p_partkey") + 1).cast("int").alias("id"), F.col("p_name").alias("name"),
            F.when(F.col("p_partkey") % 101 != 7, F.col("p_brand")).alias("brand"),
            F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """Items with the numbers at the end of their brand and type hash as ids."""
        return self.table("part").select(
            (F.col("p_partkey") + 1).cast("int").alias("id"), F.col("p_name").alias("name"),
            F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand_id"),
            (F.length("p_type") % 6).cast("int").alias("type_id"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        n = F.col("n_nationkey")
        start = F.date_add(F.lit("2024-01-01").cast("date"), n * 4)
        return self.table("nation").select(
            F.format_string("cal-%03d", n).alias("event_id"),
            F.when(n % 5 == 0, "ALL").otherwise(loc(n)).alias("location_code"),
            F.col("n_name").alias("event_name"),
            start.alias("start_date"), F.date_add(start, n % 9).alias("end_date"),
            F.when(n % 3 == 0, "HIGH").when(n % 3 == 1, "MEDIUM").otherwise("LOW").alias("expected_demand_impact"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """One signal per supplier about one sku, and one per nation about all skus."""
        base = F.lit("2024-01-01 00:00:00").cast("timestamp")

        def rows(df: DataFrame, n: Column, label: str, sku: Column) -> DataFrame:
            reported = base + F.make_dt_interval(F.lit(0), (n * 5 % 480).cast("int"))
            return df.select(
                F.concat(F.lit(label), n.cast("string")).alias("signal_id"),
                sku.cast("int").alias("sku_id"),
                F.when(n % 6 == 0, "ALL").otherwise(loc(n)).alias("location_code"),
                F.when(n % 2 == 0, "DELAY").otherwise("SHORTAGE").alias("signal_type"),
                reported.alias("reported_at"),
                F.when(n % 3 == 0, reported + F.expr("interval 2 days")).alias("resolved_at"),
            )

        return rows(self.table("supplier"), F.col("s_suppkey"), "sup-", F.col("s_suppkey") + 1).unionByName(
            rows(self.table("nation"), F.col("n_nationkey"), "nat-", F.lit(None))
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Load-run requests out of events."""
        n = F.col("event_id")
        latency = F.floor(F.col("value") * 8) / 8
        outcome = (
            F.when(n % 17 == 0, "DROPPED").when(n % 13 == 0, "TIMEOUT").when(n % 11 == 0, "HTTP_FAILURE")
            .otherwise("ACCEPTED")
        )
        return self.table("events").select(
            F.when(n % 19 == 0, n - n % 38).otherwise(n).alias("request_id"),
            loc(n).alias("location_code"), (1 + n % 5).cast("int").alias("lines"),
            (1 + n % 7).cast("int").alias("units"), outcome.alias("outcome"),
            F.when(outcome == "ACCEPTED", 200).when(outcome == "HTTP_FAILURE", 500).alias("status"),
            F.when(outcome != "DROPPED", latency).alias("latency_ms"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (1 + F.floor("value") % 90).cast("int"))).alias("ended_at"),
        )


# The same views in SQL.
CTES = {
    "v_movement": f"""
  SELECT *, occurred_at + INTERVAL 5 SECOND AS recorded_at,
         CAST(floor(epoch(occurred_at) / 60) AS BIGINT) - 13148640 AS resulting_balance_version
  FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {SQL_CENTS}) AS movement_id,
               'evt-' || l_orderkey AS source_event_id, CAST(l_partkey + 1 AS INTEGER) AS sku_id,
               {sql_loc('l_suppkey')} AS location_code, CAST(l_orderkey + 1 AS INTEGER) AS order_id,
               {SQL_LINEITEM_TYPE} AS movement_type, CAST(floor(l_quantity) AS INTEGER) AS quantity,
               l_shipdate + to_hours(l_linenumber) + to_minutes(l_suppkey) AS occurred_at
        FROM lineitem)""",
    "v_live": f"""
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {SQL_CENTS}) AS movement_id,
         CAST(l_partkey + 1 AS INTEGER) AS sku_id, {sql_loc('l_suppkey')} AS location_code,
         CAST(l_orderkey + 1 AS INTEGER) AS order_id, {SQL_LINEITEM_TYPE} AS movement_type,
         CAST(floor(l_quantity) AS INTEGER) AS quantity,
         TIMESTAMP '{AS_OF}' - to_minutes((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31
           + l_suppkey * 13) % 20160) AS occurred_at
  FROM lineitem""",
    "v_event_movement": f"""
  SELECT format('00000000-0000-4000-8000-{{:012x}}', event_id) AS movement_id,
         CAST(user_id % 25 + 1 AS INTEGER) AS sku_id, {sql_loc('event_id')} AS location_code,
         CAST(event_id + 1 AS INTEGER) AS order_id, {SQL_EVENT_TYPE} AS movement_type,
         CAST(1 + CAST(floor(value) AS BIGINT) % 10 AS INTEGER) AS quantity, ts AS occurred_at,
         event_id AS arrival
  FROM events""",
    "v_balance": """
  SELECT sku_id, location_code, on_hand, CAST(sku_id % 7 AS INTEGER) AS reserved,
         CAST(on_hand - sku_id % 7 AS INTEGER) AS available, safety_stock, reorder_point,
         greatest(on_hand + 50, reorder_point + 50) AS max_stock, CAST(sku_id % 5 + 1 AS BIGINT) AS version
  FROM (SELECT CAST(p_partkey + 1 AS INTEGER) AS sku_id, code AS location_code,
               CAST(60 + (p_partkey + 1) % 41 + 10 * idx AS INTEGER) AS on_hand,
               CAST(10 + (p_partkey + 1) % 5 AS INTEGER) AS safety_stock,
               CAST(30 + (p_partkey + 1) % 5 AS INTEGER) AS reorder_point
        FROM part, (VALUES (0, 'NCR'), (1, 'BLR'), (2, 'BOM'), (3, 'HYD')) AS l(idx, code))""",
    "v_balance_change": f"""
  SELECT CAST(user_id % 25 + 1 AS INTEGER) AS sku_id, {sql_loc('event_id')} AS location_code,
         CAST(20 + event_id % 80 AS INTEGER) AS on_hand, CAST(event_id % 15 AS INTEGER) AS reserved,
         CAST(20 + event_id % 80 - event_id % 15 AS INTEGER) AS available, 10 AS safety_stock,
         30 AS reorder_point, 150 AS max_stock, 1 + event_id * 7 % 997 AS version, ts AS updated_at,
         CASE WHEN event_id % 400 = 3 THEN 'SNAPSHOT' ELSE 'UPDATE' END AS operation, event_id AS "offset"
  FROM events""",
    "v_change_log": f"""
  SELECT event_id, event_id % 50 AS kind, ts, user_id % 25 + 1 AS sku, {sql_loc('event_id')} AS place,
         {SQL_EVENT_TYPE} AS mtype, 1 + CAST(floor(value) AS BIGINT) % 10 AS qty,
         CASE WHEN event_id % 50 BETWEEN 12 AND 15 THEN '{BALANCE_TOPIC}' ELSE '{MOVEMENT_TOPIC}' END AS topic,
         CAST(event_id % 3 AS INTEGER) AS "partition", event_id AS "offset",
         CASE WHEN event_id % 20 <> 11 THEN ts END AS event_timestamp,
         format('00000000-0000-4000-8000-{{:012x}}', event_id) AS uid,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
  FROM events""",
    "v_envelope": """
  SELECT *, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'not-json'
              WHEN 4 THEN '{"schema":{},"payload":' || envelope || '}' WHEN 21 THEN envelope || ' trailing'
              WHEN 22 THEN envelope || envelope WHEN 23 THEN replace(envelope, '"', '''')
              WHEN 24 THEN envelope || '],[' || envelope ELSE envelope END AS value_text,
         '{"sku_id":' || sku || ',"location_code":"' || place || '"}' AS key_text
  FROM (SELECT *, '{"before":' || CASE WHEN kind IN (3, 15) THEN image ELSE 'null' END || ',"after":'
          || CASE WHEN kind IN (3, 15, 7) THEN 'null' ELSE image END || ',"source":{"table":"'
          || CASE WHEN kind BETWEEN 12 AND 15 THEN 'inventory_balances' WHEN kind = 5 THEN 'orders'
                  ELSE 'inventory_movements' END || '","lsn":' || event_id || '},"op":"'
          || CASE WHEN kind IN (2, 12) THEN 'u' WHEN kind IN (3, 15) THEN 'd' WHEN kind = 6 THEN 'x'
                  WHEN kind = 13 THEN 'r' ELSE 'c' END || '"}' AS envelope
        FROM (SELECT *, CASE WHEN kind BETWEEN 12 AND 15 THEN
            '{"sku_id":' || sku || ',"location_code":"' || place || '","on_hand":'
            || CASE WHEN kind = 14 THEN 2 ELSE 20 + event_id % 80 END || ',"reserved":'
            || CASE WHEN kind = 14 THEN 9 ELSE event_id % 15 END
            || ',"safety_stock":10,"reorder_point":30,"max_stock":150,"version":' || (event_id + 1)
            || ',"updated_at":"' || stamp || '"}'
          ELSE '{"movement_id":"' || uid || '","source_event_id":"' || uid || '","sku_id":'
            || CASE WHEN kind = 8 THEN '"' || sku || '"' ELSE CAST(sku AS VARCHAR) END
            || ',"location_code":"' || CASE WHEN kind = 10 THEN ' ' || lower(place) || ' ' ELSE place END
            || '","order_id":' || CASE WHEN kind = 20 THEN 'null' ELSE CAST(event_id + 1 AS VARCHAR) END
            || ',"movement_type":"' || CASE WHEN kind = 11 THEN 'Gift' ELSE mtype END || '","quantity":' || qty
            || CASE WHEN kind = 9 THEN '.5' ELSE '' END || ',"occurred_at":"' || stamp
            || '","recorded_at":"' || stamp || '","balance_version_after":' || (event_id + 1)
            || ',"reason":null,"shelf_hint":1}' END AS image FROM v_change_log))""",
    "v_decoded": """
  SELECT *, CASE WHEN kind = 0 THEN 'tombstone' WHEN kind = 3 THEN 'movement_delete'
              WHEN kind IN (12, 13) THEN 'balance' WHEN kind = 15 THEN 'balance_delete'
              WHEN kind IN (1, 2, 5, 6, 7, 8, 9, 11, 14, 21, 22, 23, 24) THEN NULL ELSE 'movement' END AS event_kind,
         CASE WHEN kind IN (1, 8, 9, 11, 21, 22, 23, 24) THEN 'MalformedJson' WHEN kind = 2 THEN 'UnexpectedMovementUpdate'
              WHEN kind = 5 THEN 'UnsupportedTable' WHEN kind = 6 THEN 'UnsupportedOperation'
              WHEN kind = 7 THEN 'MissingRow' WHEN kind = 14 THEN 'InvalidBalance' END AS decode_error,
         CASE WHEN kind = 0 THEN 'TOMBSTONE' WHEN kind IN (3, 15) THEN 'DELETE' WHEN kind = 12 THEN 'UPDATE'
              WHEN kind = 13 THEN 'SNAPSHOT' WHEN kind IN (1, 2, 5, 6, 7, 8, 9, 11, 14, 21, 22, 23, 24) THEN NULL
              ELSE 'CREATE' END AS operation
  FROM v_change_log""",
    "v_silver": """
  SELECT topic || ':' || "partition" || ':' || "offset" AS event_id, topic AS source_topic,
         "partition" AS source_partition, "offset" AS source_offset, operation AS cdc_operation,
         CASE event_kind WHEN 'movement' THEN 'INVENTORY_MOVEMENT' WHEN 'balance' THEN 'INVENTORY_BALANCE'
              WHEN 'movement_delete' THEN 'INVENTORY_MOVEMENT_DELETE'
              WHEN 'balance_delete' THEN 'INVENTORY_BALANCE_DELETE' ELSE 'KAFKA_TOMBSTONE:' || topic END AS event_type,
         CASE WHEN event_kind IN ('movement', 'balance', 'balance_delete') THEN CAST(sku AS INTEGER) END AS sku_id,
         CASE WHEN event_kind IN ('movement', 'balance', 'balance_delete') THEN place END AS location_code,
         CASE WHEN event_kind = 'movement' THEN mtype END AS movement_type,
         CASE WHEN event_kind = 'movement' THEN CAST(qty AS INTEGER) END AS quantity,
         CASE WHEN event_kind IN ('movement', 'balance') THEN ts END AS occurred_at,
         CASE WHEN event_kind IN ('movement', 'balance', 'balance_delete') THEN "offset" + 1 END AS balance_version,
         CASE WHEN event_kind = 'balance' THEN CAST(20 + "offset" % 80 AS INTEGER) END AS on_hand,
         CASE WHEN event_kind = 'balance' THEN CAST("offset" % 15 AS INTEGER) END AS reserved,
         CASE WHEN event_kind = 'balance' THEN CAST(20 + "offset" % 80 - "offset" % 15 AS INTEGER) END AS available,
         'silver-inventory-event-v1' || CASE WHEN event_kind = 'movement_delete' THEN ':' || uid ELSE '' END AS schema_version
  FROM v_decoded WHERE decode_error IS NULL""",
    "v_order": """
  SELECT CAST(o_orderkey + 1 AS INTEGER) AS order_id, CAST(o_custkey + 1 AS INTEGER) AS buyer_id,
         o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'Shipped' WHEN 'P' THEN 'Paid' ELSE 'Submitted' END AS status
  FROM orders""",
    "v_order_item": f"""
  SELECT CAST(l_orderkey + 1 AS INTEGER) AS order_id, CAST(l_partkey % 40 + 1 AS INTEGER) AS product_id,
         'product-' || (l_partkey % 40 + 1) AS product_name, CAST(floor(l_quantity) AS INTEGER) AS units,
         floor(l_extendedprice * 4 / l_quantity) / 4 AS unit_price, l_discount * 100 AS discount,
         l_linenumber AS line_number, concat_ws('-', l_partkey, l_suppkey, {SQL_CENTS}) AS line_id
  FROM lineitem""",
    "v_buyer": "SELECT CAST(c_custkey + 1 AS INTEGER) AS buyer_id, c_name AS buyer_name FROM customer",
    "v_source_item": """
  SELECT CAST(p_partkey + 1 AS INTEGER) AS id, p_name AS name,
         CASE WHEN p_partkey % 101 <> 7 THEN p_brand END AS brand, p_type AS type, p_retailprice AS price
  FROM part""",
    "v_catalog": """
  SELECT CAST(p_partkey + 1 AS INTEGER) AS id, p_name AS name,
         CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS brand_id,
         CAST(length(p_type) % 6 AS INTEGER) AS type_id, p_retailprice AS price
  FROM part""",
    "v_calendar": f"""
  SELECT format('cal-{{:03d}}', n_nationkey) AS event_id,
         CASE WHEN n_nationkey % 5 = 0 THEN 'ALL' ELSE {sql_loc('n_nationkey')} END AS location_code,
         n_name AS event_name, DATE '2024-01-01' + n_nationkey * 4 AS start_date,
         DATE '2024-01-01' + n_nationkey * 4 + n_nationkey % 9 AS end_date,
         CASE n_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS expected_demand_impact
  FROM nation""",
    "v_signal": f"""
  SELECT label || n AS signal_id, sku_id, CASE WHEN n % 6 = 0 THEN 'ALL' ELSE {sql_loc('n')} END AS location_code,
         CASE WHEN n % 2 = 0 THEN 'DELAY' ELSE 'SHORTAGE' END AS signal_type,
         TIMESTAMP '2024-01-01' + to_hours(CAST(n * 5 % 480 AS INTEGER)) AS reported_at,
         CASE WHEN n % 3 = 0 THEN TIMESTAMP '2024-01-03' + to_hours(CAST(n * 5 % 480 AS INTEGER)) END AS resolved_at
  FROM (SELECT 'sup-' AS label, s_suppkey AS n, CAST(s_suppkey + 1 AS INTEGER) AS sku_id FROM supplier
        UNION ALL SELECT 'nat-', n_nationkey, NULL FROM nation)""",
    "v_request": f"""
  SELECT CASE WHEN event_id % 19 = 0 THEN event_id - event_id % 38 ELSE event_id END AS request_id,
         {sql_loc('event_id')} AS location_code, CAST(1 + event_id % 5 AS INTEGER) AS lines,
         CAST(1 + event_id % 7 AS INTEGER) AS units, outcome,
         CASE outcome WHEN 'ACCEPTED' THEN 200 WHEN 'HTTP_FAILURE' THEN 500 END AS status,
         CASE WHEN outcome <> 'DROPPED' THEN floor(value * 8) / 8 END AS latency_ms, ts AS started_at,
         ts + to_minutes(CAST(1 + CAST(floor(value) AS BIGINT) % 90 AS INTEGER)) AS ended_at
  FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'DROPPED' WHEN event_id % 13 = 0 THEN 'TIMEOUT'
                       WHEN event_id % 11 = 0 THEN 'HTTP_FAILURE' ELSE 'ACCEPTED' END AS outcome FROM events)""",
}
