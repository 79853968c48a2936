"""The recent-rate average: live rates sampled at most once a minute, folded in time order.

Which samples count depends on the one accepted before, so the fold is sequential along a key.
It still runs split: ticks are range-partitioned by (key, time), so a hot key covers many
partitions. Each partition folds its stretch once for every way the sampling can enter it (the
ticks of its first minute), streaming over Arrow batches; a stretch is then a map, one row an entry,
from entry tick to exit tick and an affine change of the average. A key inside one partition is
finished there. Only keys that touch a partition's edge go on: the maps of neighbouring partitions
are composed pairwise in rounds that halve their number. Entries stay rows, ordered by a window
that can spill; none are gathered, however many ticks a minute has.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recent_rate_step
from ..model import KEY
from .demand import RETENTION_DAYS, _retention_start, at, live_rate, rolling_units, with_velocities
from .lookups import evaluated_movements

# The fold travels with its job, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Least distance of two samples, weight of a new one.
SAMPLE_GAP_US = 60_000_000
NEW_WEIGHT = 0.35
# End of fixed values.

_STRETCH = (
    "sku_id int, location_code string, part int, entry_us bigint, exit_us bigint, "
    "samples bigint, scale double, shift double, fresh double"
)
#: The part of stretches that hold all ticks of their keys.
_WHOLE = -1


class _Stretch:
    """Folds one key's ticks of one partition for all its entries at once."""

    def __init__(self, key: tuple[int, str], may_continue: bool, start: int):
        self.key, self.start, self.may_continue, self.open = key, start, may_continue, True
        self.entry = np.empty(0, np.int64)
        self.last = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.scale, self.shift, self.fresh = (np.empty(0) for _ in range(3))

    def _enter(self, at_us: np.ndarray, rate: np.ndarray) -> None:
        self.entry = np.concatenate([self.entry, at_us])
        self.last = np.concatenate([self.last, at_us])
        self.count = np.concatenate([self.count, np.ones(len(at_us), np.int64)])
        self.scale = np.concatenate([self.scale, np.full(len(at_us), 1.0 - NEW_WEIGHT)])
        self.shift = np.concatenate([self.shift, NEW_WEIGHT * rate])
        self.fresh = np.concatenate([self.fresh, rate])

    def add(self, at_us: np.ndarray, rate: np.ndarray) -> None:
        if self.open:
            if self.may_continue:
                # An earlier sample can block at most the first minute, so the ticks of that
                # minute and the first one after it are all possible entries.
                stop = int(np.searchsorted(at_us, self.start + SAMPLE_GAP_US, side="left"))
                take = min(stop + 1, len(at_us))
                self.open = stop >= len(at_us)
            else:
                take, self.open = 1, False
            self._enter(at_us[:take], rate[:take])
        active = np.arange(len(self.entry))
        while len(active):
            place = np.searchsorted(at_us, self.last[active] + SAMPLE_GAP_US, side="left")
            inside = place < len(at_us)
            active, place = active[inside], place[inside]
            taken = rate[place]
            self.last[active] = at_us[place]
            self.count[active] += 1
            self.scale[active] *= 1.0 - NEW_WEIGHT
            self.shift[active] = NEW_WEIGHT * taken + (1.0 - NEW_WEIGHT) * self.shift[active]
            before = self.fresh[active]
            self.fresh[active] = np.where(
                before == 0.0, taken, NEW_WEIGHT * taken + (1.0 - NEW_WEIGHT) * before
            )

    def columns(self, part: int) -> list[np.ndarray]:
        n = len(self.entry)
        return [
            np.full(n, self.key[0], np.int32), np.full(n, self.key[1], object),
            np.full(n, part, np.int32), self.entry, self.last, self.count,
            self.scale, self.shift, self.fresh,
        ]


_NAMES = ["sku_id", "location_code", "part", "entry_us", "exit_us", "samples", "scale", "shift", "fresh"]


def _whole_keys(batch: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Folds keys that begin and end inside one batch, all of them side by side."""
    us, rate = batch["at_us"].to_numpy(), batch["rate"].to_numpy()
    # One rising number per row: the key's ordinal, then its time, leaves room for the gap.
    base = us[starts[0]:ends[-1]].min()
    span = us[starts[0]:ends[-1]].max() - base + 2 * SAMPLE_GAP_US
    ordinal = np.repeat(np.arange(len(starts)), ends - starts)
    line = ordinal * span + (us[starts[0]:ends[-1]] - base)
    begin = starts - starts[0]
    stop = ends - starts[0]
    times, rates = us[starts[0]:ends[-1]], rate[starts[0]:ends[-1]]
    place, fresh = begin.copy(), rates[begin].copy()
    count = np.ones(len(starts), np.int64)
    scale = np.full(len(starts), 1.0 - NEW_WEIGHT)
    shift = NEW_WEIGHT * fresh
    active = np.arange(len(starts))
    while len(active):
        following = np.searchsorted(line, line[place[active]] + SAMPLE_GAP_US, side="left")
        inside = following < stop[active]
        active, following = active[inside], following[inside]
        taken = rates[following]
        place[active] = following
        count[active] += 1
        scale[active] *= 1.0 - NEW_WEIGHT
        shift[active] = NEW_WEIGHT * taken + (1.0 - NEW_WEIGHT) * shift[active]
        fresh[active] = np.where(
            fresh[active] == 0.0, taken, NEW_WEIGHT * taken + (1.0 - NEW_WEIGHT) * fresh[active]
        )
    sku, location = batch["sku_id"].to_numpy(), batch["location_code"].to_numpy(object)
    return [
        sku[starts], location[starts], np.full(len(starts), _WHOLE, np.int32), times[begin], times[place], count, scale, shift, fresh,
    ]


def _frame(parts: list[list[np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({name: np.concatenate(column) for name, column in zip(_NAMES, zip(*parts))})


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, part = None, TaskContext.get().partitionId()
    for batch in batches:
        if batch.empty:
            continue
        sku, place = batch["sku_id"].to_numpy(), batch["location_code"].to_numpy(object)
        us, rate = batch["at_us"].to_numpy(), batch["rate"].to_numpy()
        change = np.flatnonzero((sku[1:] != sku[:-1]) | (place[1:] != place[:-1])) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(batch)]])
        finished = []
        first_key = (int(sku[0]), place[0])
        if current is None:
            # Only the first key of a partition can have ticks in the partition before.
            current = _Stretch(first_key, True, int(us[0]))
        elif current.key != first_key:
            finished.append(current.columns(part if current.may_continue else _WHOLE))
            current = _Stretch(first_key, False, int(us[0]))
        current.add(us[: ends[0]], rate[: ends[0]])
        if len(starts) > 1:
            finished.append(current.columns(part if current.may_continue else _WHOLE))
            if len(starts) > 2:
                finished.append(_whole_keys(batch, starts[1:-1], ends[1:-1]))
            # The last key may go on in the next batch.
            low = starts[-1]
            current = _Stretch((int(sku[low]), place[low]), False, int(us[low]))
            current.add(us[low:], rate[low:])
        if finished:
            yield _frame(finished)
    if current is not None:
        yield _frame([current.columns(part)])


def recent_rate_ewma(ticks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Average, number of samples and last sample time per key from (key, at, rate) ticks.

    `ticks` must hold one row per key and instant.
    """
    ordered = ticks.select(*KEY, F.unix_micros("at").alias("at_us"), F.col("rate").cast("double"))
    columns = [*KEY, "at_us"]
    spread = (
        ordered.repartitionByRange(partitions, *columns) if partitions else ordered.repartitionByRange(*columns)
    )
    stretches = spread.sortWithinPartitions(*columns).mapInPandas(_fold_partition, _STRETCH)
    most = partitions or int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps = stretches.filter(F.col("part") != _WHOLE)
    for _ in range((most - 1).bit_length()):
        maps = _composed(maps)
    # The first sample of a key is its first tick: the earliest entry of what is composed of all its stretches.
    value = F.struct("exit_us", "samples", "fresh")
    split = maps.groupBy(*KEY).agg(F.min_by(value, "entry_us").alias("_s")).select(*KEY, "_s.*")
    whole = stretches.filter(F.col("part") == _WHOLE).select(*KEY, "exit_us", "samples", "fresh")
    return whole.unionByName(split).select(
        *KEY,
        F.col("fresh").alias("recent_rate_ewma"),
        "samples",
        F.timestamp_micros("exit_us").alias("last_sample_at"),
    )


def _composed(maps: DataFrame) -> DataFrame:
    """Maps of parts 2i and 2i + 1 of a key as one map of part i; a map without a neighbour stays what it is.

    A left entry goes on at the right part's first entry that is a gap or more behind the left exit; if there is
    none, the left exit is the exit of both. A sample before both parts blocks a minute at most, so right entries
    matter by themselves only where the left ones span less.
    """
    pair = [*KEY, "_pair"]
    left = F.col("part") % 2 == 0
    events = maps.select(
        "*", (F.col("part") / 2).cast("int").alias("_pair"), left.alias("_left"),
        F.when(left, F.col("exit_us") + SAMPLE_GAP_US).otherwise(F.col("entry_us")).alias("_at"),
    )
    # From the last to the first instant; a right entry comes before the left exits that just reach it.
    back = Window.partitionBy(*pair).orderBy(F.desc("_at"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    whole, left_entry = Window.partitionBy(*pair), F.when(F.col("_left"), F.col("entry_us"))
    values = F.struct("exit_us", "samples", "scale", "shift", "fresh")
    met = events.select(
        "*",
        F.last(F.when(~F.col("_left"), values), ignorenulls=True).over(back).alias("_r"),
        (F.max(left_entry).over(whole) - F.min(left_entry).over(whole)).alias("_span"),
    )
    met = met.filter(F.col("_left") | F.col("_span").isNull() | (F.col("_span") < SAMPLE_GAP_US))
    on = F.col("_left") & F.col("_r").isNotNull()

    def blend(left_value: str) -> Column:
        return F.col("_r.scale") * F.col(left_value) + F.col("_r.shift")

    return met.select(
        *KEY,
        F.col("_pair").alias("part"),
        "entry_us",
        F.when(on, F.col("_r.exit_us")).otherwise(F.col("exit_us")).alias("exit_us"),
        F.when(on, F.col("samples") + F.col("_r.samples")).otherwise(F.col("samples")).alias("samples"),
        F.when(on, F.col("_r.scale") * F.col("scale")).otherwise(F.col("scale")).alias("scale"),
        F.when(on, blend("shift")).otherwise(F.col("shift")).alias("shift"),
        F.when(on, F.when(F.col("fresh") == 0.0, F.col("_r.fresh")).otherwise(blend("fresh")))
        .otherwise(F.col("fresh"))
        .alias("fresh"),
    )


def rate_ticks(movements: DataFrame) -> DataFrame:
    """The live rate at every evaluated movement's instant."""
    rolled = rolling_units(
        evaluated_movements(movements),
        {"sale_units_5m": ("Sale", 5), "sale_units_15m": ("Sale", 15), "sale_units_1h": ("Sale", 60)},
    )
    return with_velocities(rolled).select(*KEY, F.col("occurred_at").alias("at"), live_rate().alias("rate"))


def recent_rates_at(movements: DataFrame, as_of, retention_days: int | None = RETENTION_DAYS) -> DataFrame:
    """The average per key after the evaluation at `as_of`, which is itself a sample.

    An evaluation without sales nearby observes rate 0; one less than a minute after the last
    sample observes nothing.
    """
    end = at(as_of)
    seen = movements.filter(F.col("occurred_at") <= end)
    if retention_days is not None:
        seen = seen.filter(F.col("occurred_at") >= _retention_start(end, retention_days))
    ticks = rate_ticks(seen)
    history = recent_rate_ewma(ticks)
    # A tick exactly at `as_of` is already in the history.
    due = F.unix_micros(end) - F.unix_micros("last_sample_at") >= SAMPLE_GAP_US
    hour = seen.filter(
        (F.col("movement_type") == "Sale") & (F.col("occurred_at") >= end - F.expr("interval 1 hour"))
    )
    sold = lambda minutes: F.coalesce(
        F.sum(
            F.when(F.col("occurred_at") >= end - F.expr(f"interval {minutes} minutes"), F.col("quantity"))
        ),
        F.lit(0),
    )
    now = with_velocities(
        hour.groupBy(*KEY).agg(
            sold(5).alias("sale_units_5m"), sold(15).alias("sale_units_15m"), sold(60).alias("sale_units_1h")
        )
    ).select(*KEY, live_rate().alias("_now"))
    rate = F.coalesce("_now", F.lit(0.0))
    stepped = F.when(due, recent_rate_step(F.col("recent_rate_ewma"), rate)).otherwise(
        F.col("recent_rate_ewma")
    )
    return history.join(now, KEY, "left").select(
        *KEY, stepped.alias("recent_rate_ewma"), "samples", "last_sample_at"
    )
