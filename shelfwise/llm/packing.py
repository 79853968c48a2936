"""Best-fit packing by a grouping genetic algorithm.

Documents are cut into pieces of at most one sequence. Pieces that fill a sequence alone need no search.
The others are dealt at random into shards of bounded size, each a bin-packing problem of its own. On
every shard several islands evolve packings: crossover injects well-filled sequences of one parent whole
into the other, drops the other's sequences that hold any injected piece, and puts the displaced pieces
back by best fit. Between epochs each island's elite migrates to the next island, through a shuffle.
Sequences that stay badly filled are opened again and packed across shards, level by level, until one
shard is left, so all shards together waste about as much as one.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import batch, materialized, ship
from shelfwise.llm.encode import encoder

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, cache_words: int = 300_000, carried: str | None = None
) -> DataFrame:
    """Token pieces of whole texts, each text closed by end_id: doc_id, piece, start, length, ids_crc32.

    Only a document over `capacity` is cut; its pieces are full but for the first. Null text is empty.
    cache_words: words whose ids a worker keeps, about 200 bytes each. carried: a long column that pieces take along.
    """
    ship(docs.sparkSession)
    extra = [carried] if carried else []
    schema = pa.schema([*_PIECES, *[(c, pa.int64()) for c in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer, cache_words), np.uint32(end_id).tobytes()
        for rows in batches:
            found = []
            for doc_id, text, *more in zip(rows.column("doc_id").to_pylist(), rows.column("text"), *[rows.column(c).to_pylist() for c in extra]):
                ids = known.ids(text.as_py()) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    found.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), *more))
            if found:
                yield batch(schema, list(zip(*found)))

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("long").alias(c) for c in extra])
    return chosen.mapInArrow(run, ", ".join([_PIECES_DDL, *[f"{c} long" for c in extra]]))


class Packing:
    """Pieces in sequences: a list of piece lists, with loads; best fit by a sorted list of loads."""

    def __init__(self, lengths: list[int], capacity: int, bins=(), loads=()):
        self.lengths, self.capacity = lengths, capacity
        self.bins, self.loads = [list(b) for b in bins], list(loads)
        if not self.loads:
            self.loads = [sum(lengths[i] for i in b) for b in self.bins]

    def best_fit(self, pieces: list[int]) -> None:
        """Puts each piece, in the given order, into the fullest sequence that still takes it."""
        lengths, capacity, bins, loads = self.lengths, self.capacity, self.bins, self.loads
        free = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
        for i in pieces:
            at = bisect_left(free, (lengths[i], -1))
            if at < len(free):
                room, b = free.pop(at)
                bins[b].append(i)
                loads[b] += lengths[i]
                room -= lengths[i]
            else:
                b, room = len(bins), capacity - lengths[i]
                bins.append([i])
                loads.append(lengths[i])
            if room:
                insort(free, (room, b))

    def fitness(self) -> tuple[int, float]:
        """Fewer sequences first; among equals, fuller ones (mean square of the fill)."""
        return -len(self.bins), sum(x * x for x in self.loads) / max(1, len(self.loads))

    def labels(self) -> bytes:
        out = np.zeros(len(self.lengths), "<u4")
        for b, pieces in enumerate(self.bins):
            out[pieces] = b
        return out.tobytes()

    @classmethod
    def from_labels(cls, lengths: list[int], capacity: int, labels: bytes) -> Packing:
        of = np.frombuffer(labels, "<u4")
        bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
        for i, b in enumerate(of.tolist()):
            bins[b].append(i)
        return cls(lengths, capacity, bins)


def decreasing(lengths: list[int], noise: float, rng: random.Random) -> list[int]:
    """Piece order for best fit: longest first, blurred by the given share."""
    key = [n * (1 + noise * rng.random()) for n in lengths]
    return sorted(range(len(lengths)), key=lambda i: -key[i])


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """b's well-filled sequences whole into a; a's sequences with any of their pieces go; displaced pieces best fit."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.loads[k])
    share = ranked[: max(1, len(ranked) * 2 // 3)]
    injected = [k for k in share if rng.random() < 0.5] or share[:1]
    taken = {i for k in injected for i in b.bins[k]}
    kept = [k for k, pieces in enumerate(a.bins) if taken.isdisjoint(pieces)]
    child = Packing(
        a.lengths, a.capacity, [*(b.bins[k] for k in injected), *(a.bins[k] for k in kept)],
        [*(b.loads[k] for k in injected), *(a.loads[k] for k in kept)],
    )
    stays = {i for k in kept for i in a.bins[k]} | taken
    displaced = [i for i in range(len(a.lengths)) if i not in stays]
    child.best_fit(sorted(displaced, key=lambda i: -a.lengths[i]))
    return child


def mutate(one: Packing, rng: random.Random) -> Packing:
    """Opens the emptiest sequences and a few others; their pieces go back by best fit."""
    ranked = sorted(range(len(one.bins)), key=lambda k: one.loads[k])
    opened = set(ranked[:2]) | {k for k in ranked if rng.random() < 0.02}
    kept = [k for k in range(len(one.bins)) if k not in opened]
    child = Packing(one.lengths, one.capacity, [one.bins[k] for k in kept], [one.loads[k] for k in kept])
    loose = [i for k in opened for i in one.bins[k]]
    child.best_fit(sorted(loose, key=lambda i: -one.lengths[i] * (1 + 0.2 * rng.random())))
    return child


def evolve(
    lengths: list[int], capacity: int, population: list[Packing], size: int, generations: int, rng: random.Random
) -> list[Packing]:
    """Fills the population up to `size` and evolves it; ends early at the lower bound on sequences. Best first."""
    least = -(-sum(lengths) // capacity)
    while len(population) < size and not any(len(p.bins) <= least for p in population):
        packing = Packing(lengths, capacity)
        packing.best_fit(decreasing(lengths, 0.0 if not population else rng.choice((0.05, 0.2, 0.5)), rng))
        population.append(packing)
    population.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if len(population[0].bins) <= least:
            break
        parents = [max(rng.sample(population, 2), key=Packing.fitness) for _ in range(2)] if len(population) > 1 else population * 2
        child = crossover(*parents, rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        population.append(child)
        population.sort(key=Packing.fitness, reverse=True)
        del population[max(size, 1) :]
    return population


def _island_epoch(capacity: int, size: int, generations: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        lengths = np.frombuffer(first["lengths"], "<u4").tolist()
        shard, island = int(first["shard"]), int(first["island"])
        rng = random.Random(f"{seed}/{shard}/{island}")
        population = [Packing.from_labels(lengths, capacity, p) for p in sorted({p for p in rows["packing"] if p is not None})]
        best = evolve(lengths, capacity, population, size, generations, rng)
        return pd.DataFrame(
            {
                "shard": shard, "island": island, "place": range(len(best)), "lengths": first["lengths"],
                "packing": [p.labels() for p in best], "bins": [len(p.bins) for p in best],
                "fitness": [p.fitness()[1] for p in best],
            }
        )

    return run


_STATE = "shard long, island int, place int, lengths binary, packing binary, bins int, fitness double"


def _pack_shards(
    pieces: DataFrame, capacity: int, shards: int, islands: int, epochs: int, size: int, generations: int, seed: int
) -> DataFrame:
    """pieces (item, length; items unique; shard where they are dealt already) -> item, length, shard, bin."""
    if "shard" not in pieces.columns:
        pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(shards)).cast("long"))
    dealt = materialized(pieces, "packing-dealt")

    def problem(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        lengths = rows["length"].to_numpy("<u4").tobytes()
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "lengths": [lengths]})

    # A shard has a bounded number of pieces, so a group stays small whatever the input.
    problems = dealt.select("shard", "item", "length").groupBy("shard").applyInPandas(problem, "shard long, lengths binary")
    state = problems.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        "lengths", F.lit(None).cast("binary").alias("packing"),
    )
    for epoch in range(epochs):
        evolved = state.groupBy("shard", "island").applyInPandas(
            _island_epoch(capacity, size, generations, seed + epoch), _STATE
        )
        if epoch < epochs - 1:
            # Each island keeps its population; its elite goes to the next island as well.
            homes = F.when(
                (F.col("place") == 0) & F.lit(islands > 1),
                F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")),
            ).otherwise(F.array("island"))
            state = materialized(
                evolved.withColumn("island", F.explode(homes)).select("shard", "island", "lengths", "packing"),
                "packing-epoch",
            )
    best = evolved.groupBy("shard").agg(
        F.max_by("packing", F.struct(-F.col("bins"), F.col("fitness"), -F.col("island"), -F.col("place"))).alias("packing")
    )

    def placed(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        return rows.assign(bin=np.frombuffer(found["packing"].iloc[0], "<u4").astype("int64"))

    together = dealt.groupBy("shard").cogroup(best.groupBy("shard"))
    return together.applyInPandas(placed, "item long, length long, shard long, bin long")


def _along(pieces: DataFrame, shards: int, shard_items: int, seed: int) -> DataFrame:
    """pieces (item, length, place) -> with the shard of their stretch of places; an overfull stretch is split by hash."""
    places = pieces.agg(F.max("place")).first()[0] + 1
    spread = F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)
    stretch = F.least(F.floor((F.col("place") + spread) * F.lit(shards) / F.lit(places)), F.lit(shards - 1)).cast("long")
    along = pieces.withColumn("shard", stretch)
    parts = along.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * shard_items)).alias("parts"))
    part = F.pmod(F.xxhash64("item", F.lit(seed + 1)), F.col("parts"))
    return along.join(parts, "shard").select("item", "length", (F.col("shard") + part * F.lit(shards)).cast("long").alias("shard"))


def pack(
    pieces: DataFrame, capacity: int, shard_items: int = 2048, islands: int = 2, epochs: int = 2, size: int = 6,
    generations: int = 12, reopen_below: float = 0.97, seed: int = 7, along: str | None = None,
) -> DataFrame:
    """Places rows with a `length` of 1 to capacity into sequences; adds sequence_id and offset (from 0, gapless).

    All other columns come back as they were (except ones named like the two that are added, which are
    replaced); every row is placed, repeated rows each on their own. Which sequence, and the order in it, is
    unspecified. No rows give no rows. sequence_id is unique and not dense.

    along: a column with the place of a row, from 0 (null: 0). A sequence then holds rows of one stretch of places, about
    shard_items rows long; only what would leave a sequence badly filled is packed across stretches.
    """
    spark = pieces.sparkSession
    ship(spark)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = materialized(
        pieces.select(
            F.struct(*kept).alias("row"), F.col("length").cast("long").alias("length"),
            *([F.coalesce(F.col(along).cast("long"), F.lit(0)).alias("place")] if along else []),
        ).withColumn(
            "item", F.monotonically_increasing_id()
        ),
        "packing-pieces",
    )
    done = [
        numbered.filter(F.col("length") >= capacity).select(
            "item", (F.col("item") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    ]
    replaced = None  # the sequences whose pieces a round packs again
    open_pieces, level = numbered.filter(F.col("length") < capacity).select("item", "length", *(["place"] if along else [])), 0
    count = open_pieces.count()
    while count:
        shards = -(-count // shard_items)
        if along and not level:
            open_pieces = _along(open_pieces, shards, shard_items, seed)
        placed = materialized(
            _pack_shards(open_pieces, capacity, shards, islands, epochs, size, generations, seed + 100 * level),
            "packing-level",
        )
        loads = placed.groupBy("shard", "bin").agg(F.sum("length").alias("load"))
        bad = loads.filter(F.col("load") < reopen_below * capacity).select("shard", "bin")
        reopened = placed.join(bad, ["shard", "bin"], "left_semi").select("item", "length")
        again = 0 if shards == 1 else reopened.count()
        # A round that hardly saves a sequence is the last; its result is no worse than what it replaced.
        stuck = replaced is not None and loads.count() > replaced - max(1, replaced // 1000)
        last = again == 0 or stuck
        replaced = bad.count()
        done.append(_with_offsets(placed if last else placed.join(bad, ["shard", "bin"], "left_anti"), level))
        if last:
            break
        open_pieces, count, level = materialized(reopened, "packing-open"), again, level + 1
    places = done[0]
    for part in done[1:]:
        places = places.unionByName(part)
    return numbered.join(places, "item").select("row.*", "sequence_id", "offset")


def _with_offsets(placed: DataFrame, level: int) -> DataFrame:
    """Places inside a sequence: a running sum over the few pieces of one sequence."""
    sequence = (F.lit(level).cast("long") * F.lit(1 << 56)) + F.shiftleft(F.col("shard"), 20) + F.col("bin")
    rows = placed.select("length", "item", sequence.alias("sequence_id"))
    before = F.sum("length").over(
        Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.select("item", "sequence_id", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
