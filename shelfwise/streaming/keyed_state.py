"""Operator state per key, held by Spark in RocksDB: balances, rolling units and order lifecycles.

The serving jobs of `jobs` keep their state in tables; these keep it in the query, so a batch costs what its own keys
cost. A query needs the RocksDB store (`use_rocksdb`) and emits a row for each change; `newest_table` keeps the newest.
State may start from a table: a new query goes on where recovered rows end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import KEY, ORDER_STATUSES
from ..operators.demand import RETENTION_DAYS
from ..operators.orders import FAILING_STEPS, STEPS
from ..operators.state import latest_by
from ..sources.serving import ServingTable
from .jobs import start

# Processors travel with their query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions of waiting order events that are stored together, a byte each.
_STRETCH = 4096
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LEVELS = ["on_hand", "reserved", "available", "safety_stock", "reorder_point", "max_stock"]
_HELD = [*_LEVELS, "version", "updated_us", "model", "incoming"]
_HELD_SCHEMA = ", ".join(f"{c} int" for c in _LEVELS) + ", version bigint, updated_us bigint, model string, incoming int"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def newest_table(spark: SparkSession, path: str, keys: list[str]) -> ServingTable:
    """Rows that a stateful query emits, the newest of each key."""
    return ServingTable(spark, path, lambda rows: latest_by(rows, keys, "batch", "batch"))


def keep_newest(states: DataFrame, table: ServingTable, checkpoint: str, **how) -> StreamingQuery:
    """Stores what a stateful query emits."""
    return start(states, lambda df, n: table.write_batch(df, n), checkpoint, mode="update", **how)


def state_rows(query: StreamingQuery) -> int:
    """Entries that the query's state held after its last batch."""
    progress = query.lastProgress
    return sum(o["numRowsTotal"] for o in progress["stateOperators"]) if progress else 0


def _plain(value):
    """A pandas cell as Python's own value, null as None."""
    if value is None or value is pd.NaT or (not isinstance(value, str) and pd.isna(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


class _Balances(StatefulProcessor):
    """One value a key: the balance, and the model and open replenishment that recovery brought along."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("balance", _HELD_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.value.update(tuple(_held(row[c], c) for c in _HELD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows come in any order, a part at a time. Kept are those that a later one doesn't beat: if a snapshot comes up
        # at any place, the winner from there on is among them.
        alive, reset = None, -1
        for part in rows:
            snapshots = part.loc[part["operation"] == "SNAPSHOT", "position"]
            reset = max(reset, int(snapshots.max())) if len(snapshots) else reset
            both = part if alive is None else pd.concat([alive, part])
            both = both[both["position"] >= reset].sort_values("position", ascending=False, kind="stable")
            alive = both[both["version"] >= both["version"].cummax()]
        if alive is None or alive.empty:
            return
        best = alive.sort_values(["version", "position"], ascending=[False, True]).iloc[0]
        stored = self.value.get()
        had = dict(zip(_HELD, stored)) if stored is not None else dict.fromkeys(_HELD)
        if reset < 0 and had["version"] is not None and int(best["version"]) <= had["version"]:
            return
        now = {**had, **{c: _held(best[c], c) for c in (*_LEVELS, "version", "updated_us")}}
        self.value.update(tuple(now[c] for c in _HELD))
        yield pd.DataFrame([[*key, *(now[c] for c in _HELD)]], columns=[*KEY, *_HELD])

    def close(self) -> None:
        pass


def _held(value, column: str):
    value = _plain(value)
    return value if value is None or column == "model" else int(value)


def balance_states(changes: DataFrame, recovered: DataFrame | None = None, position: str = "offset") -> DataFrame:
    """Streaming balance changes -> the current balance of each key a batch changes, with model and incoming.

    A higher version replaces the stored one, a snapshot whatever is stored; `position` orders a key's changes. recovered:
    `recovery_state`, from which a new query's state starts; a key without a balance there takes the first that comes.
    """
    given = changes.select(
        *KEY, *_LEVELS, "version", F.unix_micros("updated_at").alias("updated_us"), "operation", F.col(position).cast("long").alias("position")
    )
    initial = None
    if recovered is not None:
        kept = recovered.select(*KEY, *_LEVELS, "version", F.unix_micros("updated_at").alias("updated_us"), "model", F.col("incoming").cast("int"))
        initial = kept.groupBy(*KEY)
    schema = f"sku_id int, location_code string, {_HELD_SCHEMA}"
    states = given.groupBy(*KEY).transformWithStateInPandas(_Balances(), schema, "Update", "None", initial)
    return states.select("*", F.timestamp_micros("updated_us").alias("updated_at")).drop("updated_us")


class _Rolling(StatefulProcessor):
    """A list a key and time bucket: units of each instant that the bucket's windows can see."""

    def __init__(self, columns: dict[str, tuple[str, int]], bucket_us: int):
        self.columns, self.bucket_us = columns, bucket_us
        self.kinds = sorted({kind for kind, _ in columns.values()})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.list = handle.getListState("instants", "us bigint, " + ", ".join(f"u{i} bigint" for i in range(len(self.kinds))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *name, bucket = key
        names = ["us", *(f"u{i}" for i in range(len(self.kinds)))]
        new = []
        for part in rows:
            units = {f"u{i}": part["quantity"].where(part["movement_type"] == kind, 0) for i, kind in enumerate(self.kinds)}
            new.append(pd.DataFrame({"us": part["us"], **units}).groupby("us", as_index=False).sum())
        stored = list(self.list.get())
        if not stored:
            # Nothing visits the bucket once the watermark is behind its end.
            self.handle.registerTimer(int(bucket + 1) * self.bucket_us // 1000)
        fresh = np.unique(np.concatenate([p["us"].to_numpy(np.int64) for p in new]))
        held = pd.concat([pd.DataFrame(stored, columns=names), *new]).astype("int64").groupby("us", as_index=False).sum()
        self.list.put([tuple(int(x) for x in r) for r in held.itertuples(index=False)])
        us = held["us"].to_numpy()
        widest = max(m for _, m in self.columns.values()) * 60_000_000
        # Instants of this bucket within a window behind a new one.
        near = fresh[np.maximum(np.searchsorted(fresh, us, side="right") - 1, 0)]
        touched = (us // self.bucket_us == bucket) & (near <= us) & (us - near <= widest)
        if not touched.any():
            return
        out = {KEY[0]: name[0], KEY[1]: name[1], "us": us[touched]}
        for column, (kind, minutes) in self.columns.items():
            total = np.concatenate([[0], np.cumsum(held[f"u{self.kinds.index(kind)}"].to_numpy())])
            low = np.searchsorted(us, us[touched] - minutes * 60_000_000, side="left")
            out[column] = total[np.flatnonzero(touched) + 1] - total[low]
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.list.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_states(movements: DataFrame, columns: dict[str, tuple[str, int]], retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Streaming facts -> rolling units of every instant that a batch adds or corrects, late facts included.

    State is cut by key and time bucket, at least an hour long, so a hot key is as many states as it has hours; a fact
    near a bucket's end visits the next one too. A bucket goes when the watermark, `retention_days` behind the newest
    fact, has passed it; older facts are not counted any more. Facts without a time are left out.
    """
    widest = max(m for _, m in columns.values())
    bucket = max(60, widest) * 60_000_000
    us = F.unix_micros("occurred_at")
    own = F.floor(us / bucket)
    near_end = (own + 1) * bucket - us <= widest * 60_000_000
    seen = movements.filter("occurred_at is not null").withWatermark("occurred_at", f"{retention_days} days")
    visits = seen.select(
        *KEY, "occurred_at", us.alias("us"), "movement_type", F.col("quantity").cast("long").alias("quantity"),
        F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("bucket"),
    )
    schema = "sku_id int, location_code string, us bigint, " + ", ".join(f"{c} bigint" for c in columns)
    rolled = visits.groupBy(*KEY, "bucket").transformWithStateInPandas(_Rolling(columns, bucket), schema, "Update", "EventTime")
    return rolled.select(*KEY, F.timestamp_micros("us").alias("occurred_at"), *columns)


class _Lifecycle(StatefulProcessor):
    """The order's status after its events so far without a gap, and the events that wait for an earlier one.

    Waiting events are one byte a position, in stretches of positions: that of the next event lies beside the status, so
    an order of ordinary length costs one read and one write a batch, and the others in a map.
    """

    def __init__(self, first: int):
        self.first = first
        self.moves = [{ORDER_STATUSES.index(a): ORDER_STATUSES.index(b) for a, b in moves.items()} for moves in STEPS.values()] + [{}]
        self.failing = [name in FAILING_STEPS for name in STEPS] + [False]
        self.codes = {name: i for i, name in enumerate(STEPS, 1)}  # 0: no event; after the last: a step that moves nothing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("status", "next bigint, status int, errors bigint, held bigint, near binary")
        self.waiting = handle.getMapState("waiting", "stretch bigint", "steps binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        expected, status, errors, n, near = self.at.get() or (self.first, 0, 0, 0, b"")
        loaded, stored, changed = {expected // _STRETCH: bytearray(near)}, set(), set()

        def stretch(place: int) -> bytearray:
            if place not in loaded:
                found = bool(had) and self.waiting.containsKey((place,))
                loaded[place] = bytearray(self.waiting.getValue((place,))[0]) if found else bytearray()
                if found:
                    stored.add(place)
            return loaded[place]

        had = n
        for row in rows:
            position = int(row["position"])
            if position < expected:
                continue
            code = self.codes.get(row["step"], len(self.codes) + 1)
            if position > expected:
                steps, at = stretch(position // _STRETCH), position % _STRETCH
                if at >= len(steps):
                    steps.extend(bytes(at + 1 - len(steps)))
                if not steps[at]:
                    steps[at] = code
                    changed.add(position // _STRETCH)
                    n += 1
                continue
            while code:
                moves = self.moves[code - 1]
                errors += self.failing[code - 1] and status not in moves
                status = moves.get(status, status)
                expected += 1
                steps, at = stretch(expected // _STRETCH) if n else b"", expected % _STRETCH
                code = steps[at] if at < len(steps) else 0
                n -= code > 0
        home = expected // _STRETCH
        near = bytes(stretch(home)) if n else b""
        for place, steps in loaded.items():
            if place > home and place in changed:
                self.waiting.updateValue((place,), (bytes(steps),))
            elif place <= home and place in stored:
                self.waiting.removeKey((place,))
        self.at.update((expected, status, errors, n, near))
        yield Row(order_id=key[0], status=ORDER_STATUSES[status], illegal_moves=int(errors), applied=expected - self.first, waiting=int(n))

    def close(self) -> None:
        pass


def lifecycle_states(events: DataFrame, position: str = "seq", first: int = 0) -> DataFrame:
    """Streaming order events in any order -> order_id, status, illegal_moves, applied, waiting.

    `position` counts an order's events from `first` on without gaps. An event that comes before an earlier one waits
    for it in the state, also across batches; a position that comes again is ignored.
    """
    kind = events.schema["order_id"].dataType.simpleString()
    schema = f"order_id {kind}, status string, illegal_moves bigint, applied bigint, waiting bigint"
    given = events.select("order_id", F.col(position).cast("long").alias("position"), "step")
    return given.groupBy("order_id").transformWithState(_Lifecycle(first), schema, "Update", "None")
